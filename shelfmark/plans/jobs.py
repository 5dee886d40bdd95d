"""The jobs: from stored pages to the catalogue.

Only pages that a job wants are cut up, as that costs most: which they are is decided from their
addresses, and details are read of selected pages only. The list of them is a table of known size,
so a short one is broadcast and HTML stays where it lies; a long one moves HTML once, which costs
far less than cutting up what is not wanted. What several outputs share is written as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.catalog import (
    CATALOG_COLUMNS_V1,
    CATALOG_SCHEMA,
    extend_catalog,
    require_price,
    select_available,
    to_catalog,
)
from ..operators.dedup import (
    absent,
    dedupe_first,
    exclude_processed_titles,
    exclude_processed_urls,
    keep_selected,
    with_missing_titles,
)
from ..operators.graph import Crawl, link_edges, reachable
from ..operators.html import Rules, RulesV1, extract_fields, extract_fields_v1, extract_titles
from ..operators.order import take_until
from ..operators.selection import (
    BATCH_SIZE,
    ShopProfile,
    first_valid_attempt,
    make_batches,
    rule_select,
    selected_urls,
    video_catalog,
)
from ..operators.stats import stage_counts
from ..session import cut, cut_by, empty_table, shared_folder
from .shop import page_tasks

@dataclass(frozen=True)
class JobResult:
    """The tables of a job's stages."""

    read: DataFrame  # one row per URL, with its title
    titled: DataFrame  # first URL of each title
    log: DataFrame  # every URL with its title or the sentinel
    selected: DataFrame  # product pages among the new titles
    catalog: DataFrame  # the catalogue after the run
    added: DataFrame  # what the run has added to it

    def counts(self) -> DataFrame:
        return stage_counts(read=self.read, titled=self.titled, selected=self.selected, saved=self.catalog)


def catalog_job(
    pages: DataFrame,
    catalog: DataFrame,
    log: DataFrame | None = None,
    rules: Rules = Rules(),
    shop: ShopProfile | None = ShopProfile(),
    select: Callable[[DataFrame], DataFrame] | None = None,
    target: int | None = None,
    order_by: Sequence[str] = ("page_id",),
    materialize: bool = True,
    catalog_is_unique: bool = False,
) -> JobResult:
    """Pages to catalogue. ``select`` replaces the rule-based selection of product titles;
    without it and without ``shop`` every page is a product. Pages whose ``status`` says that
    they did not load are logged under it and are no products."""
    order = list(order_by)
    if log is not None:
        addresses = dedupe_first(pages.select("url", *[c for c in order if c != "url"]), "url", order, keep_null=False)
        pages = only_wanted(pages, cut(exclude_processed_urls(addresses, log)), order)
    read = dedupe_first(extract_titles(pages, rules), "url", order, keep_null=False)
    if materialize:
        read = cut(read)
    titled = dedupe_first(read.withColumn("title", strip(F.col("title"))), "title", order, keep_null=False)
    listed = with_missing_titles(read, titled)
    fresh = absent(titled, "title", catalog, "name")
    if log is not None:
        fresh = exclude_processed_titles(fresh, log)
    if "status" in fresh.columns:
        fresh = fresh.filter("coalesce(status, 200) = 200")  # not told: it loaded
    if select is not None:
        chosen = select(fresh)
    else:
        chosen = rule_select(fresh, shop) if shop is not None else fresh
    if target is not None:
        chosen = take_until(chosen, target, order)
    chosen = cut(chosen)
    detailed = with_details(chosen, only_wanted(pages, chosen, order), rules, order)
    saved = extend_catalog(catalog, detailed, catalog_is_unique)
    return JobResult(read, titled, listed, chosen, saved, to_catalog(detailed))


def only_wanted(pages: DataFrame, wanted: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """``pages`` whose URL is in ``wanted``, a stored table, and that agree with it in the columns ``also``.

    What follows costs by the page, so a long list is dealt to tasks by its length, and the pages with it: by
    their bytes, which pack well where pages are alike, they would be left to a few tasks.
    """
    keys = ["url", *[c for c in also if c != "url"]]

    def place(df: DataFrame) -> Column:  # in a struct, missing values are equal
        return F.struct(*[df[c].alias(c) for c in keys])

    tasks = page_tasks(wanted.count())
    if tasks > int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        wanted = wanted.repartition(tasks, place(wanted))
    return pages.join(wanted, place(pages) == place(wanted), "left_semi")


def with_details(titled: DataFrame, pages: DataFrame, rules: Rules, order: Sequence[str]) -> DataFrame:
    """``titled`` with image, description and price, read from its ``pages``."""
    fields = ["image", "description", "price", "price_amount"]
    read = extract_fields(pages, rules, titled=False).select("url", *fields, *[c for c in order if c != "url"])
    details = dedupe_first(read, "url", order, keep_null=False).select("url", *fields)
    return titled.join(details, "url")


def fixed_urls_job(
    urls: DataFrame,
    pages: DataFrame,
    catalog: DataFrame,
    rules: Rules = Rules(),
    order_by: Sequence[str] = ("page_id",),
    catalog_is_unique: bool = False,
) -> JobResult:
    """The same for a given list of URLs, with no selection. URLs without a page are logged."""
    wanted = cut(urls.select("url").distinct())
    order = list(order_by)
    read = cut(dedupe_first(extract_fields(only_wanted(pages, wanted), rules), "url", order, keep_null=False))
    titled = dedupe_first(read.withColumn("title", strip(F.col("title"))), "title", order, keep_null=False)
    fresh = absent(titled, "title", catalog, "name")
    saved = extend_catalog(catalog, fresh, catalog_is_unique)
    return JobResult(read, titled, with_missing_titles(wanted, titled), fresh, saved, to_catalog(fresh))


@dataclass(frozen=True)
class CrawlResult:
    """What a crawl has made; ``batch`` is the level that a row comes from."""

    catalog: DataFrame  # catalogue columns and batch
    log: DataFrame  # url, title (or the sentinel) and batch
    visited: DataFrame  # url, depth and ord of all URLs found
    products: int


def batch_parts(spark: SparkSession, folder: str, schema: str, before: int) -> DataFrame:
    """The parts of a crawl's batches below ``before``; empty where none is written."""
    schema = f"{schema}, batch int"
    try:
        return spark.read.schema(schema).parquet(folder).filter(F.col("batch") < before)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_table(spark, schema)


def crawl_until_target(
    pages: DataFrame,
    root: str,
    target: int,
    rules: Rules = Rules(),
    shop: ShopProfile | None = ShopProfile(),
    select: Callable[[DataFrame], DataFrame] | None = None,
    order_by: Sequence[str] = ("page_id",),
    base: str = "root",
    ignore: DataFrame | None = None,
    needle: str = "",
    state: str | None = None,
) -> CrawlResult:
    """A crawl that feeds the catalogue batch by batch until it holds ``target`` products.

    A batch is a level of the crawl: the pages of the frontier are read, their products go into the
    catalogue, their links make the next frontier. The pages are stored by their URL once, like the frontier,
    so that a level neither makes nor moves those of others; no page is cut up before the crawl comes to it.
    The batch that meets the target is kept whole. Of products
    of one name the first in the order of the crawl counts, over all batches. Ends too when a level
    finds nothing new.

    With ``state``, a folder, a crawl that was stopped goes on: it holds visited URLs and frontier (see
    ``Crawl``), and a part of catalogue and log for each batch. A batch that was broken off is done again
    and replaces its part.
    """
    spark, order = pages.sparkSession, list(order_by)
    crawl = Crawl(spark, root, state)
    folder = state or shared_folder(spark, "crawl")
    place = F.struct(*order)
    stored = cut_by(pages.filter("url is not null"), "url")
    # of several snapshots of a page the first counts
    addresses = cut_by(stored.groupBy("url").agg(F.min(place).alias("__first")), "url")
    log_schema = "url string, title string"
    held = batch_parts(spark, f"{folder}/products", CATALOG_SCHEMA, crawl.depth).count()
    while held < target and not crawl.done:
        # the side of the URLs is hashed, as a merge would sort the pages at each level
        wanted = crawl.frontier.join(addresses, "url").hint("shuffle_hash")
        wave = cut(stored.join(wanted, "url").filter(place <= F.col("__first")).select(*pages.columns, "ord"))
        known = batch_parts(spark, f"{folder}/products", CATALOG_SCHEMA, crawl.depth)
        job = catalog_job(wave, known, None, rules, shop, select, order_by=["ord"], catalog_is_unique=True)
        for part, rows in (("products", job.added), ("log", job.log)):
            rows.write.mode("overwrite").parquet(f"{folder}/{part}/batch={crawl.depth}")
        held = batch_parts(spark, f"{folder}/products", CATALOG_SCHEMA, crawl.depth + 1).count()
        if held >= target:
            break
        crawl.advance(link_edges(wave, root, base, ignore, needle))
    return CrawlResult(
        batch_parts(spark, f"{folder}/products", CATALOG_SCHEMA, crawl.depth + 1),
        batch_parts(spark, f"{folder}/log", log_schema, crawl.depth + 1),
        crawl.found(),
        held,
    )


def catalog_job_v1(
    pages: DataFrame,
    root: str,
    reply: Callable[[DataFrame], DataFrame],
    rules: RulesV1 = RulesV1(),
    url_limit: int | None = None,
    batch_size: int = BATCH_SIZE,
    max_attempts: int | None = None,
) -> DataFrame:
    """The first version: crawl from ``root``, ask about batches of titles, read the products.

    ``reply`` gets the batches (batch_id, place, url, title) and returns the replies
    (batch_id, attempt, reply).
    """
    found = cut(reachable(link_edges(pages, root), root, url_limit))
    # of several snapshots of a page the first counts
    first = dedupe_first(pages.select("url", "page_id"), "url", ["page_id"], keep_null=False)
    wanted = cut(first.join(found.select("url"), "url", "left_semi"))
    fields = extract_fields_v1(only_wanted(pages, wanted, ["page_id"]), rules)
    fields = cut(dedupe_first(fields, "url", ["page_id"], keep_null=False))
    titles = fields.filter("og_title is not null").select("url", F.col("og_title").alias("title"))
    listed = titles.join(found.select("url", "ord"), "url")
    unique = dedupe_first(listed, "title", ["ord"], keep_null=False)
    batches = cut(make_batches(unique, batch_size, ["ord"]))
    chosen = selected_urls(first_valid_attempt(batches, reply(batches), max_attempts))
    kept = keep_selected(batches.select("url", "ord"), chosen)
    products = require_price(fields.join(kept, "url"), rules.allow_no_price).filter("cleaned_content <> ''")
    first = dedupe_first(products, "name", ["ord"], keep_null=False)
    return select_available(first.withColumn("keywords", F.col("name")), CATALOG_COLUMNS_V1)


def video_job(links: DataFrame, metadata: DataFrame, responses: DataFrame) -> DataFrame:
    """Video links with their embed address, title and keywords."""
    return video_catalog(links, metadata, responses)
