"""Pages built from a table of one file are cut up by many tasks; streams read a batch of many files as one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import graph as G
from shelfmark.operators import html as H
from shelfmark.operators.catalog import CATALOG_SCHEMA
from shelfmark.operators.selection import rule_select
from shelfmark.plans import jobs as J
from shelfmark.plans import registry, shop
from shelfmark.plans.queries_flow import write_batch
from shelfmark.session import cut, empty_table

registry.load()
SF = "/root/testdata/sf0.01"


@pytest.fixture
def few_pages_a_task(monkeypatch):
    monkeypatch.setattr(shop, "PAGES_PER_TASK", 250)


def partitions(df) -> int:
    return df.select(F.spark_partition_id()).distinct().count()


@pytest.mark.parametrize("name", ["is_js_heavy_all", "is_js_heavy", "first_by_class", "link_edges_shop"])
def test_pages_are_dealt_to_tasks(spark, rows, few_pages_a_task, name):
    dealt = registry.QUERIES[name](spark, SF)
    assert partitions(dealt) == 8


def test_dealt_pages_are_the_same(spark, rows, monkeypatch):
    whole = rows(shop.shop_pages(spark, SF, "og_title"))
    monkeypatch.setattr(shop, "PAGES_PER_TASK", 250)
    assert rows(shop.shop_pages(spark, SF, "og_title")) == whole


def test_scripts_are_read_once(spark):
    page = "<script>a < b</script ><script src=x></SCRIPT><style></script></style><script>open <"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    found = H.script_stats(pages)
    assert [tuple(r) for r in found.orderBy("page_id").collect()] == [(1, 1, 11, False), (2, None, None, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(html") == 1


def test_filters_do_not_find_titles_again(spark):
    pages = spark.createDataFrame([(1, "u", "<h1 class='h1 page-title'>A</h1>")], "page_id int, url string, html string")
    fields = H.extract_fields(pages)

    def searches(df) -> int:
        return df._jdf.queryExecution().optimizedPlan().toString().count("h1 h1 page-title")

    chosen = rule_select(fields.filter("title is not null"))
    assert searches(chosen) == searches(fields) > 0
    assert [r.title for r in chosen.collect()] == ["A"]


@pytest.mark.parametrize("kept", ["true", "page_id < 2", "false"])
def test_a_batch_has_its_files(spark, tmp_path, kept):
    pages, folder = spark.range(20).selectExpr("id as page_id").repartition(5), str(tmp_path / "pages")
    for batch in range(2):
        write_batch(pages.filter(kept), folder, 3, 3 * batch)
        assert len(spark.read.schema("page_id long").parquet(folder).inputFiles()) == 3 * (batch + 1)


def test_a_resumed_crawl_cuts_pages_up_once(spark, rows, tmp_path, monkeypatch):
    parts = spark.range(40).selectExpr(
        "id as p_partkey", "concat('n', id) as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size", "1.5d as p_retailprice"
    )
    parts.write.parquet(str(tmp_path / "part.parquet"))
    plans, reach = [], G.reachable

    def seen(edges, *args, **how):
        plans.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return reach(edges, *args, **how)

    monkeypatch.setattr(G, "reachable", seen)
    got = rows(registry.QUERIES["reachable_resumed"](spark, str(tmp_path)))
    assert len(plans) == 2 and not any("regexp_extract_all" in p for p in plans)
    assert got == rows(reach(G.link_edges(shop.shop_pages(spark, str(tmp_path)), shop.ROOT), shop.ROOT))


@pytest.mark.parametrize(
    "name",
    ["page_title_v1", "page_title_no_og", "page_price_text_v1", "page_description", "page_description_v1", "page_title", "page_price_text"],
)
def test_page_fields_are_dealt_to_tasks(spark, rows, few_pages_a_task, name):
    assert partitions(registry.QUERIES[name](spark, SF)) == 8


def write_parts(spark, folder, count):
    parts = spark.range(count).selectExpr(
        "id as p_partkey", "concat('n', id) as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size", "1.5d as p_retailprice"
    )
    parts.write.parquet(f"{folder}/part.parquet")


def test_wanted_pages_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    write_parts(spark, tmp_path, 400)
    monkeypatch.setattr(shop, "PAGES_PER_TASK", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a long list
    try:
        pages = shop.shop_pages(spark, str(tmp_path))
        kept = J.only_wanted(pages, cut(pages.select("url", "page_id").filter("page_id < 300")), ["page_id"])
        cut_up = H.with_tokens(kept)
        assert partitions(cut_up) == 15
        assert cut_up.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("per_task", [4000, 1])
def test_wanted_pages_may_lack_what_places_them(spark, rows, monkeypatch, per_task):
    monkeypatch.setattr(shop, "PAGES_PER_TASK", per_task)
    found = [("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", None, "z"), (None, 3, "w"), (None, None, "v"), ("c", 1, "x"), ("a", 1, "x")]
    pages = spark.createDataFrame(found * 2, "url string, page_id int, html string")
    listed = [("a", 1), ("b", None), (None, 3), ("a", 1), *[(f"u{n}", n) for n in range(20)]]
    wanted = cut(spark.createDataFrame(listed, "url string, page_id int"))
    got = rows(J.only_wanted(pages, wanted, ["page_id"]))
    assert got == sorted([("a", 1, "x")] * 4 + [("b", None, "z"), (None, 3, "w")] * 2, key=lambda r: tuple((x is not None, str(x)) for x in r))
    urls = cut(spark.createDataFrame([("a",), (None,), ("u",)], "url string"))
    assert J.only_wanted(pages, urls).count() == 12


def test_a_run_after_a_log_reads_first_snapshots_only(spark, monkeypatch):
    title = "<meta property='og:title' content='{}'>"
    found = [("u", None, "F"), ("u", 1, "A"), ("u", 2, "B"), ("v", 5, "C"), ("v", 4, "D"), ("w", 1, "E")]
    pages = spark.createDataFrame([(u, p, title.format(t)) for u, p, t in found], "url string, page_id int, html string")
    log = spark.createDataFrame([("w", "E")], "url string, title string")
    read, titles = [], J.extract_titles

    def seen(pages, rules):
        read.extend(pages.select("url", "page_id").collect())
        return titles(pages, rules)

    monkeypatch.setattr(J, "extract_titles", seen)
    result = J.catalog_job(pages, empty_table(spark, CATALOG_SCHEMA), log)
    assert sorted(tuple(r) for r in result.log.collect()) == [("u", "F"), ("v", "D")]
    assert len(read) == 2 and {tuple(r) for r in read} == {("u", None), ("v", 4)}
