"""The link graph against a plain queue on a small graph."""

from __future__ import annotations

import random

import pytest

from shelfmark.operators import graph as G


def crawl(edges, root):
    """URLs in the order in which a queue finds them, with their depth."""
    out = {}
    for src, _, dst in sorted(edges, key=lambda e: e[1]):
        out.setdefault(src, []).append(dst)
    depth, queue = {root: 0}, [root]
    for url in queue:
        for dst in out.get(url, ()):
            if dst not in depth:
                depth[dst] = depth[url] + 1
                queue.append(dst)
    return [(u, depth[u], i) for i, u in enumerate(queue)]


@pytest.fixture(scope="module")
def graph():
    rnd = random.Random(11)
    names = [f"n{i}" for i in range(60)]
    # every third link goes to one page
    return [(rnd.choice(names), i, "n0" if i % 3 == 0 else rnd.choice(names)) for i in range(110)]


@pytest.mark.parametrize("limit", [None, 1, 7])
def test_reachable_is_a_queue(spark, graph, limit):
    edges = spark.createDataFrame(graph, "src_url string, pos bigint, dst_url string")
    got = sorted((tuple(r) for r in G.reachable(edges, "n1", limit).collect()), key=lambda r: r[2])
    assert got == crawl(graph, "n1")[:limit]


def test_order_does_not_depend_on_partitions(spark, graph, monkeypatch):
    monkeypatch.setattr(G, "MERGE_EVERY", 1)  # the visited set is written anew every level
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    edges = spark.createDataFrame(graph, "src_url string, pos bigint, dst_url string").repartition(5)
    ordered = sorted((tuple(r) for r in G.reachable(edges, "n1").collect()), key=lambda r: r[2])
    plain = G.reachable(edges, "n1", ordered=False)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert ordered == crawl(graph, "n1")
    assert sorted((r.url, r.depth) for r in plain.collect()) == sorted(r[:2] for r in ordered)


@pytest.mark.parametrize("ordered", [True, False])
def test_a_stopped_crawl_goes_on(spark, graph, tmp_path, monkeypatch, ordered):
    monkeypatch.setattr(G, "MERGE_EVERY", 2)
    edges = spark.createDataFrame(graph, "src_url string, pos bigint, dst_url string")
    state = f"file://{tmp_path}/state"
    want = [r if ordered else (r[0], r[1], r[1]) for r in crawl(graph, "n1")]
    for _ in range(4):  # each call takes some levels more
        part = G.reachable(edges, "n1", ordered=ordered, state=state, max_levels=4)
    assert sorted(tuple(r) for r in part.collect()) == sorted(want)
    assert G.Crawl.saved(spark, state).done
    assert sorted(tuple(r) for r in G.reachable(edges, "n1", state=state).collect()) == sorted(want)


def test_a_broken_off_level_is_not_read(spark, graph, tmp_path):
    edges = spark.createDataFrame(graph, "src_url string, pos bigint, dst_url string")
    state = f"file://{tmp_path}/state"
    half = G.Crawl(spark, "n1", state)
    half.advance(edges)
    # the next level comes into the table, its row of the manifest does not
    save, half.save = half.save, lambda: None
    half.advance(edges)
    half.add(spark.createDataFrame([("wrong", half.depth, 99, half.depth)], "url string, depth int, ord bigint, wave int"))
    half.found()
    got = G.reachable(edges, "n1", state=state)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[2]) == crawl(graph, "n1")


def test_a_level_moves_neither_links_nor_visited(spark, graph):
    edges = spark.createDataFrame(graph, "src_url string, pos bigint, dst_url string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = G.cut_by(edges, "src_url")
        crawl_ = G.Crawl(spark, "n1")
        crawl_.advance(links)
        level = G.expand_frontier(crawl_.frontier, links, crawl_.visited)
        plan = level._jdf.queryExecution().sparkPlan().toString()
        physical = level._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("FileScan") == 3
    assert physical.count("Exchange hashpartitioning") == 1  # the targets that the level finds
    assert "Bucketed: false" not in physical


def test_a_limit_needs_the_order(spark, graph):
    edges = spark.createDataFrame(graph, "src_url string, pos bigint, dst_url string")
    with pytest.raises(ValueError, match="order"):
        G.reachable(edges, "n1", 5, ordered=False)


PAGE = (
    '<a href="b#x">1</a><a href="/c">2</a><a href="https://www.a.es/d">other site</a>'
    '<a href="/e.pdf">file</a><a href="/f?skip=1">needle</a><a href="/g">ignored</a><a href="mailto:x@a.es">m</a>'
)


def test_link_edges(spark):
    pages = spark.createDataFrame([(1, "https://a.es/p/q", PAGE)], "page_id bigint, url string, html string")
    ignore = spark.createDataFrame([("https://a.es/g",)], "value string")

    def targets(**how):
        return [(r.pos, r.dst_url) for r in G.link_edges(pages, **how).orderBy("pos").collect()]

    common = {"ignore": ignore, "needle": "skip"}
    assert targets(root="https://a.es/", **common) == [(0, "https://a.es/b"), (1, "https://a.es/c")]
    assert targets(base="page", **common) == [(0, "https://a.es/p/b"), (1, "https://a.es/c")]
    assert len(targets()) == 4
    assert targets(root="https://other.es/") == []


def test_discovered_urls(spark, rows):
    edges = spark.createDataFrame(
        [(1, "s", 0, "x"), (0, "r", 1, "x"), (0, "r", 0, "y")], "page_id bigint, src_url string, pos bigint, dst_url string"
    )
    assert rows(G.discovered_urls(edges)) == [("x", 0, 1), ("y", 0, 0)]
