"""Whole jobs on hand-written pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.catalog import CATALOG_COLUMNS, CATALOG_COLUMNS_V1, CATALOG_SCHEMA, to_catalog
from shelfmark.operators.dedup import dedupe_first
from shelfmark.operators.graph import link_edges
from shelfmark.operators.html import (
    Rules,
    Selector,
    elements,
    extract_fields,
    extract_fields_v1,
    extract_links,
    is_js_heavy,
    product_details,
    strict_og,
)
from shelfmark.plans import jobs as J
from shelfmark.plans import queries_tables as QT
from shelfmark.session import empty_table

SCHEMA = "page_id bigint, url string, html string"


def page(title, price="1,00 €", body=""):
    head = f'<meta property="og:title" content="{title}">' if title is not None else ""
    return f'<head>{head}</head><body><h1>{title}</h1><p class="price">{price}</p>{body}</body>'


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"https://a.es/{i}", h) for i, h in enumerate(htmls)], SCHEMA)


def test_catalog_job(spark, rows):
    stored = pages(spark, page("Held"), page(" Lamp "), page("Lamp"), page(None), page("Contacto"), page("Chair", "gratis"))
    again = stored.union(stored.filter("page_id = 1"))  # one page is stored twice
    held = spark.createDataFrame([("Held", "d", "p", "u", "i", "Held")], CATALOG_SCHEMA)
    for materialize in (True, False):
        result = J.catalog_job(again, held, materialize=materialize)
        assert result.catalog.columns == CATALOG_COLUMNS
        assert rows(result.catalog.select("name", "price", "url")) == [
            ("Chair", "gratis", "https://a.es/5"),
            ("Held", "p", "u"),
            ("Lamp", "1.00€", "https://a.es/1"),
        ]
        # every URL once in the log; those without a kept title with the sentinel
        assert rows(result.log) == [
            ("https://a.es/0", "Held"),
            ("https://a.es/1", "Lamp"),
            ("https://a.es/2", "Title not found"),
            ("https://a.es/3", "Title not found"),
            ("https://a.es/4", "Contacto"),
            ("https://a.es/5", "Chair"),
        ]
        # what counts are rows, and only those that are there
        assert {r.stage: r.n_rows for r in result.counts().collect()} == {"read": 6, "titled": 4, "selected": 2, "saved": 3}


def test_catalog_job_runs_on_from_its_log(spark, rows):
    stored = pages(spark, page("A"), page("B"), page("C"))
    empty = empty_table(spark, CATALOG_SCHEMA)
    first = J.catalog_job(stored, empty, target=1)
    assert rows(first.catalog.select("name")) == [("A",)]
    log = first.log.filter("title = 'A'")
    second = J.catalog_job(stored, first.catalog, log, catalog_is_unique=True)
    assert rows(second.read.select("page_id")) == [(1,), (2,)]
    assert rows(second.catalog.select("name")) == [("A",), ("B",), ("C",)]


def test_pages_that_did_not_load_are_logged_only(spark, rows):
    stored = pages(spark, page("A"), page("B"), page("C")).withColumn("status", F.expr("if(page_id = 0, 200, 404)"))
    result = J.catalog_job(stored, empty_table(spark, CATALOG_SCHEMA))
    assert rows(result.catalog.select("name")) == [("A",)]
    assert [r[1] for r in rows(result.log)] == ["A", "Status code: 404", "Title not found"]


def test_selection_can_be_replaced_or_left_out(spark, rows):
    stored = pages(spark, page("Contacto"), page("B"))
    empty = empty_table(spark, CATALOG_SCHEMA)
    assert J.catalog_job(stored, empty, shop=None).catalog.count() == 2
    chosen = J.catalog_job(stored, empty, select=lambda t: t.filter("page_id = 0"))
    assert rows(chosen.catalog.select("name")) == [("Contacto",)]


def test_fixed_urls_job(spark, rows):
    stored = pages(spark, page("Contacto"), page("B"), page("B"), page("D"))
    urls = spark.createDataFrame([(f"https://a.es/{i}",) for i in (0, 1, 2, 9)], "url string")
    result = J.fixed_urls_job(urls, stored, empty_table(spark, CATALOG_SCHEMA))
    assert rows(result.catalog.select("name")) == [("B",), ("Contacto",)]  # no selection
    assert rows(result.log)[2:] == [("https://a.es/2", "Title not found"), ("https://a.es/9", "Title not found")]


def test_catalog_job_v1(spark, rows):
    home = page("Home", body='<a href="/1">1</a><a href="/2#x">2</a><a href="/3">3</a><a href="/4">4</a>')
    stored = pages(
        spark,
        home,
        page("Lamp | Shop", "El precio actual es: 2,5 €"),
        page("Lamp - other", "3"),
        page("Free", "0,00€"),
        page(None),
        page("Not linked"),
    )
    asked = []

    def reply(batches):
        asked.append(batches.count())
        wanted = batches.filter("title <> 'Home'").groupBy("batch_id")
        return wanted.agg(F.to_json(F.collect_list("url")).alias("reply")).withColumn("attempt", F.lit(1))

    got = J.catalog_job_v1(stored, "https://a.es/0", reply)
    assert asked == [4]  # reachable pages with an og:title
    assert got.columns == CATALOG_COLUMNS_V1
    assert rows(got.select("name", "price", "image_url", "description")) == [("Lamp", "2,50€", None, None)]
    assert got.first().cleaned_content.startswith("Lamp")


def test_rules_are_the_jobs_own(spark):
    rules = Rules(titles=(Selector("h2", "t"),), use_og_title=False)
    stored = pages(spark, page("A", body='<h2 class="x t">B</h2>'))
    assert J.catalog_job(stored, empty_table(spark, CATALOG_SCHEMA), rules=rules).catalog.first().name == "B"


# ---------------------------------------------------------------- plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(node):
    """All nodes of a physical plan, looking into adaptive plans."""
    if node.nodeName() == "AdaptiveSparkPlan":
        yield from nodes(node.executedPlan())
        return
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def shuffled_columns(df):
    """Names of the columns that any exchange of the plan moves."""
    moved = set()
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        if "Exchange" in node.nodeName():
            output = node.output()
            moved |= {output.apply(i).name() for i in range(output.size())}
    return moved


def below(plan, upper, lower):
    """Whether the first ``lower`` of a plan's text stands below its first ``upper``."""
    return 0 <= plan.find(upper) < plan.find(lower)


def test_only_wanted_pages_are_cut_up(spark, tmp_path):
    pages(spark, page("A"), page("B")).write.parquet(f"{tmp_path}/p")
    read = spark.read.parquet(f"{tmp_path}/p")
    wanted = spark.createDataFrame([("https://a.es/1", "t")], "url string, title string")
    wanted.write.parquet(f"{tmp_path}/w")
    wanted = spark.read.parquet(f"{tmp_path}/w")
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            details = product_details(read, wanted)
            fields = extract_fields(J.only_wanted(read, wanted))
            for df in (details, fields):
                assert below(plan_of(df), "Generate explode", "LeftSemi")
            if threshold != "-1":  # a short list is broadcast: HTML stays
                assert not shuffled_columns(fields) & {"html", "tokens", "metas"} - {"url"}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tokens_are_never_shuffled(spark, tmp_path):
    pages(spark, page("A"), page("B")).write.parquet(f"{tmp_path}/p")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if every table were large
    try:
        read = spark.read.parquet(f"{tmp_path}/p")
        log = spark.createDataFrame([("u", "t")], "url string, title string")
        held = to_catalog(QT.part_catalog(spark, "/root/testdata/sf0.001"))
        result = J.catalog_job(read, held, log, materialize=False)
        fixed = J.fixed_urls_job(log.select("url"), read, held)
        details = product_details(read, log)
        for df in (result.catalog, result.log, fixed.catalog, fixed.log, details, link_edges(read, ignore=log)):
            moved = shuffled_columns(df)
            assert moved
            assert not moved & {"tokens", "metas"}
            plan = plan_of(df)
            assert "CartesianProduct" not in plan
            assert "BroadcastNestedLoopJoin" not in plan
            assert "Python" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_extraction_needs_no_exchange(spark, tmp_path):
    pages(spark, page("A")).write.parquet(f"{tmp_path}/p")
    read = spark.read.parquet(f"{tmp_path}/p")
    for df in (extract_fields(read), extract_fields_v1(read), elements(read), extract_links(read), is_js_heavy(read)):
        assert shuffled_columns(df) == set()


def test_a_filter_on_a_field_does_not_cut_the_pages_up_again(spark, tmp_path):
    pages(spark, page("A")).write.parquet(f"{tmp_path}/p")
    read = spark.read.parquet(f"{tmp_path}/p")
    fields = extract_fields(read)
    for df in (
        fields.filter("title is not null and price like '1%'"),
        fields.select("url", "title"),
        strict_og(read),
        link_edges(read),
        extract_links(read).filter("href <> ''"),
    ):
        plan = plan_of(df)
        assert plan.count("regexp_extract_all(html") == 1
        assert plan.count("FileScan") == 1


def test_dedupe_combines_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id", "id % 3 as k")
    assert "partial_min_by" in plan_of(dedupe_first(df, "k", ["id"]))


def shop_page(i, links, title, price="1,00 €"):
    anchors = "".join(f'<a href="/{k}">x</a>' for k in links)
    return (i, f"https://a.es/{i}", f'<meta property="og:title" content="{title}"><p class="price">{price}</p>{anchors}')


CRAWLED = [
    shop_page(0, [1, 2], "Start"),
    shop_page(1, [3, 0], "Lamp"),
    shop_page(2, [4], "Table"),
    shop_page(3, [5], "Chair"),
    shop_page(4, [6, 7], "Lamp"),  # a name that an earlier batch has
    shop_page(5, [], "Shelf"),
    shop_page(6, [8], "Door"),
    shop_page(7, [], "Desk"),
    shop_page(8, [], "Roof"),
    shop_page(9, [], "Out of reach"),
]


def crawled(spark, target, **how):
    pages = spark.createDataFrame([*CRAWLED, (90, *CRAWLED[1][1:])], "page_id bigint, url string, html string")
    return J.crawl_until_target(pages, "https://a.es/0", target, shop=None, **how)


@pytest.mark.parametrize(("target", "batches", "products"), [(2, 2, 3), (99, 5, 8)])
def test_a_crawl_feeds_itself_until_the_target(spark, target, batches, products):
    result = crawled(spark, target)
    found = {r.name: r.batch for r in result.catalog.collect()}
    assert (result.products, len(found), max(found.values()) + 1) == (products, products, batches)
    levels = [["Start"], ["Lamp", "Table"], ["Chair"], ["Shelf", "Door", "Desk"], ["Roof"]]
    assert found == {n: b for b, names in enumerate(levels[:batches]) for n in names}
    logged = {r.url: r.title for r in result.log.collect()}
    assert logged.get("https://a.es/4") == ("Lamp" if batches > 2 else None)


def test_pages_beyond_the_target_are_not_read(spark, monkeypatch):
    seen = []
    links = J.link_edges
    monkeypatch.setattr(J, "link_edges", lambda wave, *a: seen.append(wave.count()) or links(wave, *a))
    crawled(spark, 4)
    assert seen == [1, 2]  # the third batch meets the target, so its links are not read


def test_a_stopped_crawl_keeps_its_products(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    assert crawled(spark, 2, state=state).products == 3
    result = crawled(spark, 99, state=state)
    want = crawled(spark, 99)
    for table in ("catalog", "log", "visited"):
        got, all_ = (sorted(map(tuple, getattr(r, table).collect())) for r in (result, want))
        assert got == all_, table
    assert crawled(spark, 99, state=state).products == 8  # nothing is left to find


def test_a_crawl_makes_its_pages_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def built(html):
        made.add(1)
        return html

    rows_ = [*CRAWLED, (90, *CRAWLED[1][1:]), (91, None, "<a href='/0'>0</a>")]
    pages = spark.createDataFrame(rows_, "page_id bigint, url string, html string").withColumn("html", built("html"))
    result = J.crawl_until_target(pages, "https://a.es/0", 99, shop=None)
    assert result.products == 8
    assert made.value <= len(rows_)  # not once a level


def test_a_level_moves_no_pages(spark, monkeypatch):
    plans = []
    cut_ = J.cut

    def seen(df, **options):
        if "ord" in df.columns and "html" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_(df, **options)

    monkeypatch.setattr(J, "cut", seen)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        crawled(spark, 99)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(plans) == 5 and not any("Exchange" in p for p in plans)


def test_a_crawl_without_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    result = J.crawl_until_target(pages, "https://a.es/0", 3)
    assert (result.products, result.catalog.count(), result.log.count(), result.visited.count()) == (0, 0, 0, 1)
