"""Queries over selection, the link graph, streams and whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog as C
from ..operators import dedup as D
from ..operators import graph as G
from ..operators import html as H
from ..operators import selection as L
from ..session import cut, empty_table
from ..streaming import pages as R
from . import jobs as J
from .queries_tables import SHOP, SHOP_CATALOG, TITLES_CTE, page_titles
from .queries_text import LINKS_CTE, stored_pages
from .registry import fresh_folder, query, table
from .shop import ROOT, page_tasks, shop_columns, shop_pages

# ---------------------------------------------------------------- selection

_SIZE = L.BATCH_SIZE


def title_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.make_batches(page_titles(spark, sf_dir), _SIZE, ["page_id"])


BATCHES_CTE = (
    f"numbered as (select *, row_number() over (order by page_id) - 1 as i from titles), "
    f"batches as (select page_id, url, title, i // {_SIZE} as batch_id, i % {_SIZE} as place from numbered)"
)


@query("make_batches", f"with {TITLES_CTE}, {BATCHES_CTE} select * from batches")
def _(spark, sf_dir):
    return title_batches(spark, sf_dir)


@query(
    "selection_prompts",
    f"with {TITLES_CTE}, {BATCHES_CTE} select batch_id, count(*) as n_titles, "
    "cast(sum(length(url)) as bigint) as url_chars from batches group by 1",
)
def _(spark, sf_dir):
    prompts = L.selection_prompts(title_batches(spark, sf_dir))
    # read the listed rows back out of the prompt
    listed = F.from_json(F.element_at(F.split("prompt", "\n\n", 2), 2), "array<struct<url:string,title:string>>")
    chars = F.aggregate("rows", F.lit(0).cast("bigint"), lambda n, r: n + F.length(r["url"]))
    rows = prompts.select("batch_id", listed.alias("rows"))
    return rows.select("batch_id", F.size("rows").cast("bigint").alias("n_titles"), chars.alias("url_chars"))


_HEAD = L.prompt_head(L.ShopProfile()).replace("'", "''")


@query(
    "selection_prompts_text",
    f"with {TITLES_CTE}, {BATCHES_CTE} select batch_id, '{_HEAD}' || '[' || string_agg('{{\"url\":' || "
    "cast(to_json(url) as varchar) || ',\"title\":' || cast(to_json(title) as varchar) || '}', ',' order by place) "
    "|| ']' as prompt from batches group by batch_id",
)
def _(spark, sf_dir):
    return L.selection_prompts(title_batches(spark, sf_dir))


def replies(batches: DataFrame) -> DataFrame:
    """What a model might have answered: the URLs at even places, some attempts unusable.

    Batch by batch: a good first reply; a text first; three unusable replies; a good reply
    only at the fourth attempt, which is not looked at.
    """
    good = batches.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("place") % 2 == 0, F.col("url")))).alias("urls")
    )
    quoted = F.concat(F.lit("['"), F.array_join("urls", "', '"), F.lit("']"))
    attempts = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt")
    kind = F.col("batch_id") % 4
    text = (
        F.when((kind == 0) | ((kind == 1) & (F.col("attempt") > 1)), F.to_json("urls"))
        .when((kind == 2) & (F.col("attempt") == 3), quoted)
        .when((kind == 3) & (F.col("attempt") == 4), F.to_json("urls"))
        .when(F.col("attempt") == 1, "Here is the list:")
        .otherwise('{"urls": ["x"]}')
    )
    return good.select("batch_id", "urls", attempts).select("batch_id", "attempt", text.alias("reply"))


@query(
    "parse_selection",
    f"with {TITLES_CTE}, {BATCHES_CTE}, attempts as (select unnest([1, 2, 3, 4]) as attempt) "
    "select batch_id, cast(attempt as integer) as attempt, url from batches join attempts on "
    "(batch_id % 4 = 0 or (batch_id % 4 = 1 and attempt > 1) or (batch_id % 4 = 2 and attempt = 3) "
    "or (batch_id % 4 = 3 and attempt = 4)) where place % 2 = 0",
)
def _(spark, sf_dir):
    parsed = L.parse_selection(replies(cut(title_batches(spark, sf_dir))))
    return parsed.select("batch_id", "attempt", F.explode("urls").alias("url"))


@query(
    "first_valid_attempt",
    f"with {TITLES_CTE}, {BATCHES_CTE} select batch_id, "
    "cast(count(*) filter (batch_id % 4 <> 3 and place % 2 = 0) as bigint) as n_urls from batches group by 1",
)
def _(spark, sf_dir):
    batches = cut(title_batches(spark, sf_dir))
    chosen = L.first_valid_attempt(batches, replies(batches), L.MAX_ATTEMPTS)
    return chosen.select("batch_id", F.size("urls").cast("bigint").alias("n_urls"))


@query(
    "model_selection",
    f"with {TITLES_CTE}, {BATCHES_CTE} select page_id, url, title from batches where batch_id % 4 <> 3 and place % 2 = 0",
)
def _(spark, sf_dir):
    """Batches, replies, first valid attempt, and back to the titles."""
    batches = cut(title_batches(spark, sf_dir))
    chosen = L.selected_urls(L.first_valid_attempt(batches, replies(batches), L.MAX_ATTEMPTS))
    return D.keep_selected(batches.select("page_id", "url", "title"), chosen)


@query("rule_select_plain", f"with {SHOP} select page_id, title from shop where title <> 'SUDADERAS COMFY'")
def _(spark, sf_dir):
    """No titles of information pages are given."""
    return L.rule_select(shop_columns(spark, sf_dir, "page_id", "title"), L.ShopProfile(info_titles=()))


@query(
    "first_valid_attempt_urls",
    f"with {TITLES_CTE}, {BATCHES_CTE} select batch_id, url from batches where batch_id % 4 <> 3 and place % 2 = 0",
)
def _(spark, sf_dir):
    batches = cut(title_batches(spark, sf_dir))
    chosen = L.first_valid_attempt(batches, replies(batches), L.MAX_ATTEMPTS)
    return chosen.select("batch_id", F.explode("urls").alias("url"))


@query(
    "rule_select",
    f"with {SHOP} select page_id, title from shop where title not in ('Contacto', 'SUDADERAS COMFY')",
)
def _(spark, sf_dir):
    return L.rule_select(shop_columns(spark, sf_dir, "page_id", "title"))


@query(
    "keyword_prompts",
    f"with {SHOP} select page_id, 'Product: ' || title || chr(10) || 'Page text: ' || description || chr(10) || "
    "'Answer with the price and four keywords that fit only this product, separated by commas: "
    "price€, keyword1, keyword2, keyword3, keyword4' || chr(10) as prompt from shop",
)
def _(spark, sf_dir):
    products = shop_columns(spark, sf_dir, "page_id", "title", "description")
    return L.keyword_prompts(products).select("page_id", "prompt")


_VIDEO_TAIL = L.VIDEO_TEMPLATE.split("{description}")[1].replace("'", "''")


@query(
    "video_prompts",
    f"with {SHOP} select page_id, 'Video: ' || title || chr(10) || 'Description: ' || description || '{_VIDEO_TAIL}' "
    "as prompt from shop",
)
def _(spark, sf_dir):
    products = shop_columns(spark, sf_dir, "page_id", "title", "description")
    return L.keyword_prompts(products, L.VIDEO_TEMPLATE).select("page_id", "prompt")


_COMMA = "replace(cast(cast(p_retailprice as decimal(18,2)) as {T}), '.', ',')"


def keyword_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as key",
        f"concat({_COMMA.format(T='string')}, '€, ', p_name, ',', p_type, ' , Kit Camper, ', p_brand) as reply",
    )


@query(
    "parse_keywords",
    f"select cast(p_partkey as varchar) as key, {_COMMA.format(T='varchar')} || '€' as price, "
    "p_name || '|' || p_type || '|Kit Camper|' || p_brand as keywords from part",
)
def _(spark, sf_dir):
    parsed = L.parse_keywords(keyword_replies(spark, sf_dir), has_price=True)
    return parsed.select("key", "price", F.array_join("keywords", "|").alias("keywords"))


@query(
    "parse_keywords_many",
    "select cast(p_partkey as varchar) as key, p_name || '|' || p_type || '|' || p_brand || '|four|five|six' as keywords from part",
)
def _(spark, sf_dir):
    """All keywords of a reply, however many."""
    replies = table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as string) as key", "concat(p_name, ', ', p_type, ', ', p_brand, ',four,five , six') as reply"
    )
    parsed = L.parse_keywords(replies, has_price=False)
    return parsed.select("key", F.array_join("keywords", "|").alias("keywords"))


@query("banned_keywords", "select cast(p_partkey as varchar) as key, p_name || '|' || p_type || '|' || p_brand as keywords from part")
def _(spark, sf_dir):
    parsed = L.parse_keywords(keyword_replies(spark, sf_dir), has_price=True)
    return L.banned_keywords(parsed).select("key", F.array_join("keywords", "|").alias("keywords"))


def video_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to all parts' videos, metadata of two thirds of them, replies for those."""
    part = table(spark, sf_dir, "part")
    links = part.selectExpr("concat('https://www.youtube.com/watch?v=v', p_partkey) as value")
    known = part.filter("p_partkey % 3 <> 0")
    metadata = known.selectExpr(
        "concat('v', p_partkey) as video_id",
        "p_name as title",
        "p_type as description",
        "'2024-05-06T07:08:09Z' as publishedAt",
        "p_brand as channelTitle",
        "cast(p_partkey as string) as viewCount",
        "if(p_partkey % 2 = 0, 'N/A', cast(p_size as string)) as likeCount",
        "'N/A' as commentCount",
    )
    replies = known.selectExpr("concat('v', p_partkey) as key", "concat(p_name, ', ', p_brand, chr(10)) as reply")
    return links, metadata, replies


@query(
    "video_metadata",
    "select 'v' || p_partkey as video_id, p_partkey as viewCount, "
    "case when p_partkey % 2 = 1 then cast(p_size as bigint) end as likeCount, "
    "cast(null as bigint) as commentCount from part where p_partkey % 3 <> 0",
)
def _(spark, sf_dir):
    typed = L.typed_video_metadata(video_inputs(spark, sf_dir)[1])
    return typed.select("video_id", "viewCount", "likeCount", "commentCount")


_VIDEO_SQL = (
    "select 'https://www.youtube.com/watch?v=v' || p_partkey as \"Link\", "
    "'https://www.youtube.com/embed/v' || p_partkey as \"Iframe Link\", p_name as \"Title\", "
    "p_name || ', ' || p_brand as \"Keywords\" from part where p_partkey % 3 <> 0"
)


@query("video_job", _VIDEO_SQL)
def _(spark, sf_dir):
    return J.video_job(*video_inputs(spark, sf_dir))


# ---------------------------------------------------------------- link graph


@query(
    "link_edges",
    f"with {LINKS_CTE} select page_id, src_url, pos, "
    "regexp_extract(src_url, '^[a-z]+://[^/?#]*', 0) || regexp_replace(href, '#.*$', '') as dst_url from links",
)
def _(spark, sf_dir):
    return G.link_edges(stored_pages(spark, sf_dir))


SHOP_EDGES = (
    "shop_edges as (select page_id, url as src_url, e.pos, e.dst_url from shop, "
    "lateral (select unnest([0, 1, 2]) as pos, unnest(['https://shop.example/contacto', "
    "'https://shop.example/p/' || cast((page_id * 2) % (select count(*) from part) as varchar), "
    "'https://shop.example/p/' || cast((page_id * 2 + 1) % (select count(*) from part) as varchar)]) as dst_url) e)"
)


@query("link_edges_shop", f"with {SHOP}, {SHOP_EDGES} select page_id, src_url, cast(pos as bigint) as pos, dst_url from shop_edges")
def _(spark, sf_dir):
    return G.link_edges(shop_pages(spark, sf_dir), ROOT)


@query(
    "discovered_urls",
    f"with {SHOP}, {SHOP_EDGES} select dst_url as url, page_id, cast(pos as bigint) as pos from shop_edges "
    "qualify row_number() over (partition by dst_url order by page_id, pos) = 1",
)
def _(spark, sf_dir):
    return G.discovered_urls(G.link_edges(shop_pages(spark, sf_dir), ROOT))


@query(
    "expand_frontier",
    # parts are the frontier, numbered by their key; suppliers divisible by 4 were visited
    "with f as (select l_partkey as src, l_suppkey as dst, l_orderkey * 10 + l_linenumber as pos from lineitem "
    "where l_partkey % 2 = 0 and l_suppkey % 4 <> 0) "
    "select cast(dst as varchar) as url, src as parent_ord, pos from f "
    "qualify row_number() over (partition by dst order by src, pos) = 1",
)
def _(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_partkey as string) as src_url",
        "cast(l_suppkey as string) as dst_url",
        "l_orderkey * 10 + l_linenumber as pos",
    )
    parts = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0")
    frontier = parts.selectExpr("cast(p_partkey as string) as url", "p_partkey as ord")
    visited = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").selectExpr("cast(s_suppkey as string) as url")
    return G.expand_frontier(frontier, edges, visited)


_REACH = (
    f"with recursive {SHOP}, {SHOP_EDGES}, walk(url, depth) as (select '{ROOT}', 0 union "
    "select e.dst_url, w.depth + 1 from walk w join shop_edges e on e.src_url = w.url where w.depth < 60) "
    "select url, cast(min(depth) as integer) as depth from walk group by url"
)


@query("reachable", _REACH)
def _(spark, sf_dir):
    edges = G.link_edges(shop_pages(spark, sf_dir), ROOT)
    return G.reachable(edges, ROOT, ordered=False).select("url", "depth")


# A queue finds the URLs of a level in the order of their parents and links. The order of the
# parents is that of the path of (parent, link) places down from the root, compared as a list.
_QUEUE = (
    f"{SHOP}, {SHOP_EDGES}, walk(url, depth, trail) as (select '{ROOT}', 0, [0] union all "
    "select e.dst_url, w.depth + 1, list_append(w.trail, e.pos) from walk w join shop_edges e on e.src_url = w.url "
    "where w.depth < {levels}), first as (select url, min(depth) as depth, arg_min(trail, (depth, trail)) as trail "
    "from walk group by url), queue as "
    "(select url, cast(depth as integer) as depth, row_number() over (order by depth, trail) - 1 as ord from first)"
)


# Levels after which a queue over the shop has found everything: a page links to twice its number and the next.
_ALL_LEVELS = "(select cast(2 * ceil(log2(count(*))) as integer) from part)"


@query("reachable_resumed", f"with recursive {_QUEUE.replace('{levels}', _ALL_LEVELS)} select url, depth, ord from queue")
def _(spark, sf_dir):
    """A crawl that is stopped after two levels and goes on from its folder, in order."""
    # both runs read the links from a table: pages are cut up for them once
    edges, state = cut(G.link_edges(shop_pages(spark, sf_dir), ROOT)), fresh_folder(spark)
    G.reachable(edges, ROOT, state=state, max_levels=2)
    return G.reachable(edges, ROOT, state=state)


@query("reachable_limited", f"with recursive {_QUEUE.replace('{levels}', '5')} select url, depth, ord from queue where ord < 20")
def _(spark, sf_dir):
    """The first URLs of the crawl in the order in which a queue would find them."""
    return G.reachable(G.link_edges(shop_pages(spark, sf_dir), ROOT), ROOT, max_urls=20)


# ---------------------------------------------------------------- streams

_FILES = 4


def page_files(spark: SparkSession, pages: DataFrame) -> str:
    """The pages in several files, and the first part of them a second time."""
    folder = fresh_folder(spark)
    pages.repartition(_FILES, "page_id").write.parquet(folder)
    pages.filter("page_id % 2 = 0").write.mode("append").parquet(folder)
    return folder


@query("stream_pages", "select page_id, url from pages union all select page_id, url from pages where page_id % 2 = 0")
def _(spark, sf_dir):
    source = page_files(spark, table(spark, sf_dir, "pages"))
    target = fresh_folder(spark)
    stream = R.stream_pages(spark, source, files_per_batch=2).select("page_id", "url")
    _drain(stream, target)
    return spark.read.parquet(target)


def _drain(stream: DataFrame, target: str) -> StreamingQuery:
    """Run a stream over what is there into parquet files."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{target}-state")
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    return query


@query("stream_dedupe", "select distinct url from pages")
def _(spark, sf_dir):
    source = page_files(spark, table(spark, sf_dir, "pages"))
    target = fresh_folder(spark)
    _drain(R.stream_dedupe(R.stream_pages(spark, source, 1).select("url")), target)
    return spark.read.parquet(target)


@query("stream_dedupe_watermark", "select distinct event_id from events")
def _(spark, sf_dir):
    """Events twice; the second copies arrive while the first are still remembered."""
    folder, target = fresh_folder(spark), fresh_folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    events.unionByName(events).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    _drain(R.stream_dedupe(stream, "event_id", "ts", "400 days").select("event_id"), target)
    return spark.read.parquet(target)


_DAY = "timestamp '2024-01-{day}' + (event_id % 3600) * interval '1 second'"


@query(
    "stream_dedupe_forgets",
    # -1 is the row that moves the time on; the last row counts the keys that are remembered at the end
    "select event_id, count(*) as n from (select distinct event_id from events union all select distinct event_id from events "
    "where event_id % 2 = 0 union all select -1) group by event_id "
    "union all select -2, count(distinct event_id) + 1 from events where event_id % 2 = 0",
)
def _(spark, sf_dir):
    """State that is given up: keys of the first day come back on the tenth, late rows do not count."""
    events = table(spark, sf_dir, "events").select("event_id")
    first = events.withColumn("ts", F.expr(_DAY.format(day="01")))
    later = spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.expr("timestamp '2024-01-10'").alias("ts"))
    again = events.filter("event_id % 2 = 0").withColumn("ts", F.expr(_DAY.format(day="10")))
    late = events.filter("event_id % 2 = 1").withColumn("ts", F.expr(_DAY.format(day="05")))
    folder, target = fresh_folder(spark), fresh_folder(spark)
    for batch in (first, later, again.unionByName(late)):
        batch.unionByName(batch).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("event_id bigint, ts timestamp").parquet(folder)
        query_ = _drain(R.stream_dedupe(stream, "event_id", "ts", "1 day").select("event_id"), target)
    held = query_.lastProgress["stateOperators"][0]["numRowsTotal"]
    seen = spark.read.parquet(target).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return seen.unionByName(spark.range(1).select(F.lit(-2).cast("bigint").alias("event_id"), F.lit(held).cast("bigint").alias("n")))


def batch_files(spark: SparkSession, sf_dir: str, batches: int) -> int:
    """Files of a batch, where the shop's pages are dealt to so many batches."""
    return page_tasks(table(spark, sf_dir, "part").count() // batches)


def write_batch(pages: DataFrame, folder: str, files: int, before: int = 0) -> None:
    """Write ``pages`` as ``files`` files, after ``before`` others: a stream that takes so many files at a time reads
    them as one batch, by as many tasks."""
    pages.coalesce(files).write.mode("append").parquet(folder)
    # a task without rows has written none
    for _ in range(before + files - len(pages.sparkSession.read.schema(pages.schema).parquet(folder).inputFiles())):
        pages.filter(F.lit(False)).write.mode("append").parquet(folder)


def _stream_catalog(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """A catalogue from a stream that was stopped once and went on from its checkpoint."""
    pages, files = shop_pages(spark, sf_dir), batch_files(spark, sf_dir, 2)
    folder, target, state = fresh_folder(spark), fresh_folder(spark), fresh_folder(spark)

    def products(batch: DataFrame) -> DataFrame:
        return L.rule_select(H.extract_fields(batch).filter("title is not null"))

    def start():
        return R.stream_upsert(R.stream_pages(spark, folder, files), products, target, state, ("page_id",))

    def catalog() -> DataFrame:
        return R.read_stream_catalog(spark, target)

    # first the lower half of the pages, then the rest: earlier pages win across batches
    half = "page_id < (select avg(page_id) from p)"
    pages.createOrReplaceTempView("p")
    write_batch(spark.sql(f"select * from p where {half}"), folder, files)
    R.run_until_target(start, catalog, 1)
    write_batch(spark.sql(f"select * from p where not {half}"), folder, files, files)
    spark.catalog.dropTempView("p")
    return target, R.run_until_target(start, catalog, 1_000_000_000)


@query(
    "stream_upsert",
    f"with {SHOP}, c as ({SHOP_CATALOG}) select name, url from c "
    "where name not in ('Contacto', 'SUDADERAS COMFY') "
    "qualify row_number() over (partition by name order by page_id) = 1",
)
def _(spark, sf_dir):
    target, _ = _stream_catalog(spark, sf_dir)
    return R.read_stream_catalog(spark, target).select("name", "url")


_FIRST_PRODUCTS = (
    "where name not in ('Contacto', 'SUDADERAS COMFY') qualify row_number() over (partition by name order by page_id) = 1"
)


@query("stream_two_writers", f"with {SHOP}, c as ({SHOP_CATALOG}) select name, url from c {_FIRST_PRODUCTS}")
def _(spark, sf_dir):
    """A second stream with a checkpoint of its own goes on in the folder of the first; nothing is lost."""
    pages, target = shop_pages(spark, sf_dir), fresh_folder(spark)
    middle = pages.agg(F.avg("page_id")).first()[0]
    for part, batches in ((F.col("page_id") < middle, 2), (F.lit(True), 1)):
        folder, files = fresh_folder(spark), batch_files(spark, sf_dir, batches)
        write_batch(pages.filter(part), folder, files)
        _upsert(spark, folder, target, fresh_folder(spark), files).awaitTermination()
    return R.read_stream_catalog(spark, target).select("name", "url")


def _upsert(spark, folder, target, state, files, goal=None):
    def products(batch: DataFrame) -> DataFrame:
        return L.rule_select(H.extract_fields(batch).filter("title is not null"))

    return R.stream_upsert(R.stream_pages(spark, folder, files), products, target, state, ("page_id",), target=goal)


@query(
    "stream_target",
    f"with {SHOP}, c as ({SHOP_CATALOG}) select name, url, 0 as run from c where page_id <= (select count(*) / 4 from part) "
    f"and {_FIRST_PRODUCTS.removeprefix('where ')} union all select name, url, 1 from c {_FIRST_PRODUCTS}",
)
def _(spark, sf_dir):
    """The run ends with the batch that meets the target and keeps all of it; the next one goes on."""
    pages = shop_pages(spark, sf_dir)
    count, files = table(spark, sf_dir, "part").count(), batch_files(spark, sf_dir, 4)
    folder, target, state = fresh_folder(spark), fresh_folder(spark), fresh_folder(spark)
    for part in range(4):  # a folder's files are read in the order in which they came
        some = pages.filter((F.col("page_id") > part * count / 4) & (F.col("page_id") <= (part + 1) * count / 4))
        write_batch(some, folder, files, part * files)
    R.run_until_target(lambda: _upsert(spark, folder, target, state, files, 1), lambda: R.read_stream_catalog(spark, target), 1)
    first = cut(R.read_stream_catalog(spark, target).select("name", "url", F.lit(0).alias("run")))
    _upsert(spark, folder, target, state, files).awaitTermination()
    return first.unionByName(R.read_stream_catalog(spark, target).select("name", "url", F.lit(1).alias("run")))


# ---------------------------------------------------------------- jobs

_PRICE = (
    "case when price_text = '0,00€' then '0.00€' when price_text like 'El%' then price_text "
    "else replace(replace(price_text, ',', '.'), ' ', '') end"
)
_EMPTY = C.CATALOG_SCHEMA


@query(
    "catalog_job",
    f"with {SHOP}, c as (select page_id, title as name, description, {_PRICE} as price, url, image as image_url from shop) "
    "select name, description, price, url, image_url, name as keywords from c "
    "where name not in ('Contacto', 'SUDADERAS COMFY') "
    "qualify row_number() over (partition by name order by page_id) = 1",
)
def _(spark, sf_dir):
    """Shop pages to the catalogue, selection by rule, sorted by name."""
    result = J.catalog_job(shop_pages(spark, sf_dir), empty_table(spark, _EMPTY), materialize=False)
    return C.sort_by_name(result.catalog)


@query(
    "crawl_until_target",
    f"with recursive {_QUEUE.replace('{levels}', _ALL_LEVELS)}, "
    f"n as (select title as name, description, {_PRICE} as price, url, image as image_url, title as keywords, depth from shop "
    "join queue using (url) where title not in ('Contacto', 'SUDADERAS COMFY') "
    "qualify row_number() over (partition by title order by ord) = 1), "
    "held as (select depth, sum(count(*)) over (order by depth) as n from n group by depth) "
    "select name, description, price, url, image_url, keywords, depth as batch from n "
    "where depth <= (select coalesce(min(depth), 1000) from held where n >= (select count(*) // 4 from part))",
)
def _(spark, sf_dir):
    """Batches whose pages feed the next one, until there is a product for every fourth part."""
    pages, target = shop_pages(spark, sf_dir), table(spark, sf_dir, "part").count() // 4
    return J.crawl_until_target(pages, ROOT, target).catalog


@query(
    "catalog_job_log",
    f"with {SHOP}, k as (select page_id, url, title from shop where page_id % 6 <> 0 "
    "qualify row_number() over (partition by title order by page_id) = 1) "
    "select s.url, coalesce(k.title, 'Title not found') as title from shop s left join k on s.url = k.url where s.page_id % 6 <> 0",
)
def _(spark, sf_dir):
    """The log of a second run: pages that the first one processed are left out."""
    processed = shop_columns(spark, sf_dir, "page_id", "url").filter("page_id % 6 = 0")
    log = processed.select("url", F.lit("earlier").alias("title"))
    return J.catalog_job(shop_pages(spark, sf_dir), empty_table(spark, _EMPTY), log).log


@query(
    "catalog_job_counts",
    f"with {SHOP}, t as (select * from shop qualify row_number() over (partition by title order by page_id) = 1), "
    "s as (select * from t where title not in ('Contacto', 'SUDADERAS COMFY')), "
    "l as (select * from s order by page_id limit 100) "
    "select 'read' as stage, count(*) as n_rows, count(distinct url) as n_urls from shop "
    "union all select 'titled', count(*), count(distinct url) from t "
    "union all select 'selected', count(*), count(distinct url) from l "
    "union all select 'saved', count(*), count(distinct url) from l",
)
def _(spark, sf_dir):
    empty = empty_table(spark, _EMPTY)
    return J.catalog_job(shop_pages(spark, sf_dir), empty, target=100).counts()


@query(
    "fixed_urls_job",
    f"with {SHOP}, w as (select * from shop where page_id % 3 = 1), held as (select p_name as name, p_type as description, "
    "p_brand as price, p_name as url, p_brand as image_url from part where p_partkey % 50 = 0 "
    "qualify row_number() over (partition by p_name order by p_name, p_type, p_brand) = 1), "
    f"n as (select title as name, description, {_PRICE} as price, url, image as image_url from w "
    "where title not in (select name from held) qualify row_number() over (partition by title order by page_id) = 1) "
    "select name, description, price, url, image_url, name as keywords from (from held union all from n)",
)
def _(spark, sf_dir):
    """A list of URLs into a catalogue that holds some names already."""
    urls = shop_columns(spark, sf_dir, "page_id", "url").filter("page_id % 3 = 1")
    held = table(spark, sf_dir, "part").filter("p_partkey % 50 = 0")
    held = held.selectExpr("p_name as name", "p_type as description", "p_brand as price", "p_name as url", "p_brand as image_url")
    held = held.withColumn("__order", F.struct("name", "description", "price"))
    held = D.dedupe_first(held, "name", ["__order"]).drop("__order")
    return J.fixed_urls_job(urls, shop_pages(spark, sf_dir), held).catalog


# the price as the first version prints it: two decimals, comma, thousands set off by a comma
_V1_PRICE = (
    "case when p like 'El precio actual%' or p like '%€ ' then p "
    "when regexp_matches(p, '^[0-9]+[.,][0-9][0-9]( ?€)?$') then "
    "regexp_replace(regexp_replace(replace(p, ' ', ''), '^([0-9]+)[.,]([0-9][0-9])€?$', '\\1,\\2€'), "
    "'^([0-9]+)([0-9]{3},[0-9]{2}€)$', '\\1,\\2') else p end"
)


def v1_sql(levels: str, limit: str) -> str:
    """The first version's products of a crawl of so many levels, of the URLs that ``limit`` lets through."""
    return (
        f"with recursive {_QUEUE.replace('{levels}', levels)}, "
        f"t as (select s.*, q.ord from shop s join queue q using (url) where {limit} and og_title is not null "
        "qualify row_number() over (partition by og_title order by q.ord) = 1), "
        "b as (select *, (row_number() over (order by ord) - 1) // 30 as batch_id, "
        "(row_number() over (order by ord) - 1) % 30 as place from t), "
        "c as (select b.*, p_name, p_type, p_size, p_brand, coalesce(case when price_text_v1 like '%El precio actual es: %' "
        "then split_part(price_text_v1, 'El precio actual es: ', 2) else price_text_v1 end, script_price) as p from b join part "
        "on p_partkey = page_id where batch_id % 4 <> 3 and place % 2 = 0), "
        "d as (select *, regexp_split_to_array(og_title, '\\s[-|]\\s')[1] as name from c where p is not null "
        "qualify row_number() over (partition by name order by ord) = 1) "
        "select name, url, p_name || ' of ' || p_brand as description, coalesce(og_image, 'none') as image_url, name as keywords, "
        f"case when regexp_matches(p, '^[0-9]+[.,][0-9][0-9]( ?€)?$') then {_V1_PRICE} else price_text_v1 end as price, "
        "p_name || chr(10) || price_text || chr(10) || p_type || ' size' || chr(10) || p_size || chr(10) || p_name || ' of ' "
        "|| p_brand || chr(10) || 'nextmore' as cleaned_content from d"
    )


@query("catalog_job_v1", v1_sql(_ALL_LEVELS, "true"))
def _(spark, sf_dir):
    """The whole rows of the whole crawl; replies are partly unusable."""
    products = J.catalog_job_v1(shop_pages(spark, sf_dir), ROOT, replies, max_attempts=L.MAX_ATTEMPTS)
    return products.fillna("none", ["image_url"])


@query("catalog_job_v1_limited", v1_sql("8", "q.ord < 100"))
def _(spark, sf_dir):
    """The same with the first version's limit on URLs, here 100."""
    products = J.catalog_job_v1(shop_pages(spark, sf_dir), ROOT, replies, url_limit=100, max_attempts=L.MAX_ATTEMPTS)
    return products.fillna("none", ["image_url"])
