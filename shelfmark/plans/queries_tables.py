"""Queries over sources, sinks, deduplication, joins, the catalogue, counts and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import catalog as C
from ..operators import dedup as D
from ..operators import html as H
from ..operators import order as O
from ..operators import stats as A
from ..session import empty_table
from ..sources import readers as R
from ..sources import writers as W
from .queries_text import HTML_TITLE, LINKS_CTE, stored_pages
from .registry import fresh_folder, query, table
from .shop import shop_columns, shop_sql

SHOP = shop_sql()
TITLES_CTE = f"titles as (select page_id, url, {HTML_TITLE} as title from pages)"
SHOP_CATALOG = (
    "select title as name, description, price_text as price, url, image as image_url, title as keywords, page_id from shop"
)


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and ``<title>`` of the stored pages."""
    title = F.coalesce(H.html_title(F.col("html")), F.lit(H.NO_HTML_TITLE))
    return stored_pages(spark, sf_dir).select("page_id", "url", title.alias("title"))


def shop_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product details of the shop's pages."""
    wanted = ("page_id", "url", "title", "image", "description", "price_text")
    return shop_columns(spark, sf_dir, *wanted).withColumnRenamed("price_text", "price")


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products straight from ``part``: few names, each many times. Ordered by ``ord``."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as ord",
        "p_name as name",
        "p_type as description",
        "cast(cast(p_retailprice as decimal(18,2)) as string) as price",
        "concat('https://shop.example/p/', p_partkey) as url",
        "p_brand as image_url",
    )


PARTS_CTE = (
    "parts as (select p_partkey as ord, p_name as name, p_type as description, "
    "cast(cast(p_retailprice as decimal(18,2)) as varchar) as price, "
    "'https://shop.example/p/' || p_partkey as url, p_brand as image_url from part)"
)
_FIRST = "qualify row_number() over (partition by {key} order by {order}) = 1"

# ---------------------------------------------------------------- sources and sinks


@query("read_pages", "select page_id, url from pages where page_id % 10 <> 0 and page_id % 7 <> 0")
def _(spark, sf_dir):
    folder = fresh_folder(spark)
    pages = table(spark, sf_dir, "pages").withColumns(
        {
            "status": F.expr("if(page_id % 10 = 0, 404, 200)"),
            "content_type": F.expr("if(page_id % 7 = 0, 'image/png', 'text/html; charset=utf-8')"),
        }
    )
    pages.write.parquet(folder)
    return R.read_pages(spark, folder).select("page_id", "url")


@query("read_lines", "select url as value from pages")
def _(spark, sf_dir):
    folder = fresh_folder(spark)
    padded = table(spark, sf_dir, "pages").select(F.concat(F.lit("  "), F.col("url"), F.lit("\t ")).alias("url"))
    W.write_url_list(padded, folder)
    return R.read_lines(spark, folder)


@query(
    "read_catalog",
    f"with {SHOP} select trim(title) as name, description, price_text as price, url, image as image_url, "
    "trim(title) as keywords from shop",
)
def _(spark, sf_dir):
    folder = fresh_folder(spark)
    old = shop_products(spark, sf_dir).drop("page_id")
    old.write.option("header", True).option("escape", '"').csv(folder)
    return R.read_catalog(spark, folder, "csv")


_PRODUCT_TEXT = (
    "{name} || chr(10) || 'Precio: ' || {price} || chr(10) || chr(10) || {description} || chr(10) || chr(10) || "
    "'Información extraída de [' || {name} || '](' || {url} || ')' || chr(10) || chr(10)"
)
_SHOP_TEXT = _PRODUCT_TEXT.format(name="title", price="price_text", description="description", url="url")


@query(
    "read_product_records",
    f"with {SHOP}, r as (select title as name, trim({_SHOP_TEXT}, chr(10)) as record, "
    "row_number() over (order by title, page_id) - 1 as ord from shop) select name, record, ord from r",
)
def _(spark, sf_dir):
    """Records of several files of different sizes, in the order of the files and the places in them."""
    folder = fresh_folder(spark)
    products = shop_products(spark, sf_dir)
    products = products.repartitionByRange(5, "title", "page_id").sortWithinPartitions("title", "page_id")
    W.write_product_text(C.to_catalog(products), folder)
    records = R.read_product_records(spark, folder)
    return records.select("name", F.regexp_replace("record", r"^\n+|\n+$", "").alias("record"), "ord")


@query(
    "write_catalog",
    f"with {SHOP} select name, description, price, url, image_url, keywords, "
    "row_number() over (order by name, description nulls first, price nulls first, url, image_url nulls first) - 1 as place "
    f"from ({SHOP_CATALOG})",
)
def _(spark, sf_dir):
    """Written sorted: the rows of the files, in file order, are the rows in order of name."""
    folder = fresh_folder(spark)
    ordered = C.to_catalog(shop_products(spark, sf_dir)).select("name", "url", *C.CATALOG_COLUMNS[1:3], "image_url", "keywords")
    W.write_catalog(ordered, folder)
    place = {"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")}
    return O.row_index(spark.read.parquet(folder).select("*", *[c.alias(n) for n, c in place.items()]), list(place), "place").drop(*place)


@query("to_product_text", f"with {SHOP} select {_SHOP_TEXT} || '-------' || chr(10) || chr(10) as value from shop")
def _(spark, sf_dir):
    return W.to_product_text(C.to_catalog(shop_products(spark, sf_dir)))


@query(
    "to_product_text_iva",
    f"with {SHOP} select "
    + _PRODUCT_TEXT.format(
        name="title", price="price_text || ' (IVA incluido)'", description="description", url="url"
    )
    + " || '-------' || chr(10) as value from shop",
)
def _(spark, sf_dir):
    return W.to_product_text(C.to_catalog(shop_products(spark, sf_dir)), "iva")


@query("processed_log", f"with {TITLES_CTE} select title || ': ' || url as value from titles")
def _(spark, sf_dir):
    folder = fresh_folder(spark)
    titles = page_titles(spark, sf_dir)
    W.append_processed_log(titles.filter("page_id % 2 = 0"), folder)
    W.append_processed_log(titles.filter("page_id % 2 = 1"), folder)
    return W.log_lines(spark.read.parquet(folder))


@query("logged_titles", f"with {SHOP} select coalesce(og_title) as title from shop where og_title is not null")
def _(spark, sf_dir):
    titles = shop_columns(spark, sf_dir, "url", "og_title").select("url", F.col("og_title").alias("title"))
    return W.logged_titles(titles.fillna(H.SENTINELS["title"], ["title"]))


@query(
    "write_run_output",
    "select 'shop.example' as site, cast(1 + p_partkey % 2 as integer) as execution, count(*) as n from part group by all",
)
def _(spark, sf_dir):
    folder = fresh_folder(spark)
    parts = part_catalog(spark, sf_dir)
    for execution in (1, 2, 1):  # writing a run again replaces it
        W.write_run_output(parts.filter(F.col("ord") % 2 == execution - 1), folder, "shop.example", execution)
    return spark.read.parquet(folder).groupBy("site", "execution").agg(F.count(F.lit(1)).alias("n"))


@query(
    "next_execution",
    "select o_orderpriority as site, cast(max(o_custkey) + 1 as integer) as execution from orders group by 1",
)
def _(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority as site", "cast(o_custkey as int) as execution", "'{}' as config_json"
    )
    return W.next_execution(runs)


@query(
    "next_execution_fixed",
    "select o_orderpriority as site, cast(max(o_custkey) as integer) as execution from orders group by 1",
)
def _(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority as site", "cast(o_custkey as int) as execution", "'{}' as config_json"
    )
    return W.next_execution(runs, fixed=True)


@query(
    "run_config_row",
    "select '1-URGENT' as site, cast(coalesce(max(o_custkey), 0) + 1 as integer) as execution, "
    """'{"batch":30,"categories":["a","b"],"site":"1-URGENT"}' as config_json """
    "from orders where o_orderpriority = '1-URGENT'",
)
def _(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").selectExpr("o_orderpriority as site", "cast(o_custkey as int) as execution")
    site = "1-URGENT"
    config = {"site": site, "batch": 30, "categories": ["a", "b"]}
    return W.run_config_row(spark, site, W.execution_number(runs, site), config)


@query("select_available", f"with {PARTS_CTE} select name, url, description, image_url, price from parts")
def _(spark, sf_dir):
    return C.select_available(part_catalog(spark, sf_dir))


# ---------------------------------------------------------------- deduplication and joins


@query(
    "dedupe_first",
    f"with {TITLES_CTE} select * from titles " + _FIRST.format(key="title", order="page_id"),
)
def _(spark, sf_dir):
    return D.dedupe_first(page_titles(spark, sf_dir), "title", ["page_id"])


@query(
    "dedupe_first_null_titles",
    f"with {SHOP} select page_id, url, og_title as title from shop where og_title is null "
    "union all select * from (select page_id, url, og_title as title from shop where og_title is not null "
    + _FIRST.format(key="og_title", order="page_id")
    + ")",
)
def _(spark, sf_dir):
    titles = shop_columns(spark, sf_dir, "page_id", "url", "og_title").withColumnRenamed("og_title", "title")
    return D.dedupe_first(titles, "title", ["page_id"])


@query("dedupe_title_sorted", f"with {TITLES_CTE} select * from (select *, regexp_split_to_array(title, '\\s[-|]\\s')[1] as name from titles) " + _FIRST.format(key="name", order="page_id"))
def _(spark, sf_dir):
    """Stored pages: title, its head, first page of each, sorted."""
    from ..functions.text import title_head

    titles = page_titles(spark, sf_dir).withColumn("name", title_head(F.col("title")))
    return C.sort_by_name(D.dedupe_first(titles, "name", ["page_id"]))


@query("distinct_urls", f"with {LINKS_CTE} select distinct href as url from links")
def _(spark, sf_dir):
    return D.distinct_urls(H.extract_links(stored_pages(spark, sf_dir)).withColumnRenamed("href", "url"))


@query("exclude_processed_urls", "select page_id, url from pages where page_id % 3 <> 0")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return D.exclude_processed_urls(pages, pages.filter("page_id % 3 = 0"))


@query(
    "exclude_processed_titles",
    f"with {TITLES_CTE} select * from titles where title not in (select title from titles where page_id % 5 = 0)",
)
def _(spark, sf_dir):
    titles = page_titles(spark, sf_dir)
    return D.exclude_processed_titles(titles, titles.filter("page_id % 5 = 0"))


@query(
    "titles_missing_from_catalog",
    f"with {SHOP}, {PARTS_CTE} select page_id, title from shop where title not in (select name from parts)",
)
def _(spark, sf_dir):
    titles = shop_columns(spark, sf_dir, "page_id", "title")
    catalog = part_catalog(spark, sf_dir).withColumn("name", F.expr("if(ord % 2 = 0, null, name)"))
    return D.titles_missing_from_catalog(titles, catalog.unionByName(part_catalog(spark, sf_dir)))


_KEPT = f"kept as (select * from titles {_FIRST.format(key='title', order='page_id')})"


@query(
    "with_missing_titles",
    f"with {TITLES_CTE}, {_KEPT} select p.url, coalesce(k.title, 'Title not found') as title "
    "from pages p left join kept k on p.url = k.url",
)
def _(spark, sf_dir):
    titles = page_titles(spark, sf_dir)
    return D.with_missing_titles(titles, D.dedupe_first(titles, "title", ["page_id"]))


@query(
    "with_missing_titles_status",
    f"with {SHOP}, t as (select page_id, url, og_title as title from shop), "
    f"k as (select * from t where title is not null {_FIRST.format(key='title', order='page_id')}) "
    "select t.url, coalesce(k.title, 'Title not found') as title, case when k.title is not null then 'kept' "
    "when t.title is not null then 'duplicate' else 'missing' end as status from t left join k on t.url = k.url",
)
def _(spark, sf_dir):
    titles = shop_columns(spark, sf_dir, "page_id", "url", "og_title").withColumnRenamed("og_title", "title")
    kept = D.dedupe_first(titles, "title", ["page_id"], keep_null=False)
    return D.with_missing_titles(titles, kept, titles)


@query("keep_selected", f"with {TITLES_CTE} select page_id, url, title from titles where page_id % 3 = 1")
def _(spark, sf_dir):
    titles = page_titles(spark, sf_dir)
    chosen = titles.filter("page_id % 3 = 1").select("url")
    return D.keep_selected(titles, chosen.unionByName(chosen))


@query(
    "combine_catalogs",
    f"with {PARTS_CTE} select * from parts "
    + _FIRST.format(key="name", order="case when ord % 2 = 0 then 0 else 1 end, ord"),
)
def _(spark, sf_dir):
    parts = part_catalog(spark, sf_dir)
    return D.combine_catalogs(parts.filter("ord % 2 = 0"), parts.filter("ord % 2 = 1"), ["ord"])


@query(
    "combine_records",
    f"with {PARTS_CTE}, r as (select name, url as record, ord, ord % 2 as source from parts) "
    "select name, cast(min(source) as integer) as source, cast(arg_min(ord, source * 1000000000 + ord) as bigint) as ord, "
    "arg_max(record, source * 1000000000 + ord) as record from r group by name",
)
def _(spark, sf_dir):
    records = part_catalog(spark, sf_dir).select("name", F.col("url").alias("record"), "ord")
    return D.combine_records(records.filter("ord % 2 = 0"), records.filter("ord % 2 = 1"))


@query("drop_failed", f"with {SHOP} select page_id, og_title, og_image from shop where og_title is not null or og_image is not null")
def _(spark, sf_dir):
    return D.drop_failed(shop_columns(spark, sf_dir, "page_id", "og_title", "og_image"), "og_title", "og_image")


_UPSERT = (
    f"with {PARTS_CTE}, both_sides as (select *, ord % 2 as new from parts where ord % 2 = 0 or name is not null) "
    "select name, description, price, url, image_url, name as keywords from both_sides "
    "qualify row_number() over (partition by name order by new, {order}) = 1"
)


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = part_catalog(spark, sf_dir)
    # the new half has blanks around its names
    new = parts.filter("ord % 2 = 1").withColumn("name", F.concat(F.lit(" "), "name", F.lit("\n")))
    return C.upsert_catalog(parts.filter("ord % 2 = 0"), new, ["url"])


@query("upsert_catalog", _UPSERT.format(order="url"))
def _(spark, sf_dir):
    return _upsert(spark, sf_dir)


@query(
    "upsert_catalog_unique",
    f"with {SHOP}, c as ({SHOP_CATALOG}), held as (select * from c where page_id % 4 <> 1 "
    + _FIRST.format(key="name", order="page_id")
    + "), fresh as (select * from c where page_id % 4 = 1 and name not in (select name from held) "
    + _FIRST.format(key="name", order="page_id")
    + ") select name, description, price, url, image_url, keywords from (from held union all from fresh)",
)
def _(spark, sf_dir):
    """The case of a catalogue that an upsert has written: names are unique."""
    products = shop_products(spark, sf_dir)
    held = D.dedupe_first(products.filter("page_id % 4 <> 1"), "title", ["page_id"])
    return C.upsert_catalog(held, products.filter("page_id % 4 = 1"), ["page_id"], existing_is_unique=True)


# ---------------------------------------------------------------- counts, running values, order


@query(
    "stage_counts",
    f"with {LINKS_CTE}, {TITLES_CTE}, k as (select * from titles {_FIRST.format(key='title', order='page_id')}) "
    "select 'links' as stage, count(*) as n_rows, count(distinct href) as n_urls from links "
    "union all select 'titles', count(*), count(distinct url) from titles "
    "union all select 'kept', count(*), count(distinct url) from k",
)
def _(spark, sf_dir):
    titles = page_titles(spark, sf_dir)
    links = H.extract_links(stored_pages(spark, sf_dir)).select(F.col("href").alias("url"))
    return A.stage_counts(links=links, titles=titles, kept=D.dedupe_first(titles, "title", ["page_id"]))


_BATCHES_SQL = (
    "b as (select event_type as crawl_id, datediff('day', date '1970-01-01', cast(ts as date)) as batch_id, "
    "count(*) as n_urls, sum(cast(value as decimal(28,6))) as seconds from events group by all)"
)


@query(
    "batch_running_stats",
    f"with {_BATCHES_SQL} select crawl_id, cast(batch_id as bigint) as batch_id, "
    "count(*) over w as batch_number, cast(sum(n_urls) over w as bigint) as total_urls, "
    "cast(sum(seconds) over w as double) / count(*) over w as mean_seconds from b "
    "window w as (partition by crawl_id order by batch_id rows between unbounded preceding and current row)",
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("crawl_id"),
        F.unix_date(F.to_date("ts")).cast("bigint").alias("batch_id"),
        F.col("value").cast("decimal(28,6)").alias("value"),
    )
    batches = events.groupBy("crawl_id", "batch_id").agg(
        F.count(F.lit(1)).alias("n_urls"), F.sum("value").alias("seconds")
    )
    return A.batch_running_stats(batches, block=7)


@query("total_products", "select count(distinct p_name) as total_products from part")
def _(spark, sf_dir):
    return C.total_products(_upsert(spark, sf_dir))


@query(
    "sort_by_name",
    f"with {SHOP} select og_title as name, page_id from shop order by og_title nulls last, page_id",
)
def _(spark, sf_dir):
    return C.sort_by_name(shop_columns(spark, sf_dir, "page_id", "og_title").withColumnRenamed("og_title", "name"))


@query("last_n", "select page_id, url from pages order by page_id desc limit 5")
def _(spark, sf_dir):
    return O.last_n(table(spark, sf_dir, "pages").select("page_id", "url"), 5, ["page_id"])


@query("take_until", "select l_orderkey, l_linenumber, l_partkey from lineitem order by l_partkey, l_orderkey, l_linenumber limit 100")
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return O.take_until(lines, 100, ["l_partkey", "l_orderkey", "l_linenumber"])


@query(
    "row_index",
    "select page_id, row_number() over (order by url, page_id) - 1 as idx from pages",
)
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return O.row_index(pages, ["url", "page_id"]).drop("url")


@query("hosts", "select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as netloc, count(*) as n from pages group by 1")
def _(spark, sf_dir):
    """Pages per site."""
    pages = table(spark, sf_dir, "pages").select(U.netloc(F.col("url")).alias("netloc"))
    return pages.groupBy("netloc").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dedupe_first_equal_rows",
    "with t as (select case when p_partkey % 3 <> 0 then p_brand end as title, p_type as m from part) "
    "select title, min(m) as m from t where title is not null group by title union all select * from t where title is null",
)
def _(spark, sf_dir):
    """Rows without a title stay, also those that are equal in every column."""
    rows = table(spark, sf_dir, "part").selectExpr("if(p_partkey % 3 <> 0, p_brand, null) as title", "p_type as m")
    return D.dedupe_first(rows, "title", ["m"])


@query(
    "append_run",
    "select 'https://shop' as site, cast(n as integer) as execution, '{\"pages\":' || (select count(*) from pages) || '}' as config_json "
    "from range(1, 4) t(n)",
)
def _(spark, sf_dir):
    """Three runs, each numbered after those in the table."""
    folder = fresh_folder(spark)
    count = table(spark, sf_dir, "pages").count()
    runs = empty_table(spark, W.RUNS_SCHEMA)
    for _run in range(3):
        W.append_run(spark, folder, "https://shop", W.execution_number(runs, "https://shop"), {"pages": count})
        runs = spark.read.schema(W.RUNS_SCHEMA).parquet(folder)
    return runs
