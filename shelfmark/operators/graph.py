"""The link graph of stored pages: edges, one level of a crawl, everything in reach."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import cut_by, shared_folder
from .dedup import dedupe_first
from .html import extract_links
from .order import numbered
from .urls import exclude_containing, exclude_links, only_same_site

# Levels after which the visited set is written anew in fewer files.
MERGE_EVERY = 12


def link_edges(
    pages: DataFrame,
    root: str | None = None,
    base: str = "root",
    ignore: DataFrame | None = None,
    needle: str = "",
) -> DataFrame:
    """Edges page_id, src_url, pos, dst_url between pages of one site.

    ``base="root"`` resolves links against the site root, ``base="page"`` against the page
    that holds them. With ``root`` only the pages of its site are read; without it each page's
    own site is meant. Targets lose their fragment; other sites, files that are no pages, and
    ignored targets are left out.
    """
    if root is not None:
        pages = only_same_site(pages, root)
    links = extract_links(pages)
    src = F.col("src_url")
    if root is not None:
        site_root = F.lit(root)
    else:
        site_root = F.concat(U.scheme(src), F.lit("://"), U.netloc(src), F.lit("/"))
    target = U.defragment(U.resolve_url(site_root if base == "root" else src, F.col("href")))
    edges = links.select("page_id", "src_url", "pos", target.alias("dst_url"), site_root.alias("__root"))
    edges = edges.filter(U.same_site(F.col("dst_url"), F.col("__root")) & U.is_html_page(F.col("dst_url")))
    edges = exclude_containing(edges.drop("__root"), needle, "query", "dst_url")
    return exclude_links(edges, ignore, "dst_url") if ignore is not None else edges


def expand_frontier(frontier: DataFrame, edges: DataFrame, visited: DataFrame) -> DataFrame:
    """Targets of the frontier that were not visited: url, parent_ord, pos of the first link.

    ``visited`` has each URL once. A target that many links name is combined before the
    shuffle. The optimizer broadcasts the frontier or the visited set while their tables are
    small. The visited set is taken out by an outer join: an anti
    join would be moved below the aggregate, where it meets every edge instead of the few
    targets of this level.
    """
    found = edges.join(frontier.select(F.col("url").alias("src_url"), F.col("ord").alias("parent_ord")), "src_url")
    first = found.groupBy(F.col("dst_url").alias("url")).agg(F.min(F.struct("parent_ord", "pos")).alias("__first"))
    known = visited.select("url", F.lit(True).alias("__known"))
    new = first.join(known, "url", "left").filter("__known is null")
    return new.select("url", "__first.parent_ord", "__first.pos")


class Crawl:
    """The visited set and the frontier of a crawl, as one table that each level is added to.

    The table is laid out by URL like the links are by their source, so a level moves neither: only the
    targets that it finds are shuffled. A level is a part of the table (``wave``), which the next one reads
    as its frontier. After ``MERGE_EVERY`` levels the parts are written anew as one.

    With ``state``, a folder, the crawl can go on after a stop: after each level a row of the manifest there
    says which table holds the crawl, and how far it has come. A crawl on the same folder starts from
    the last such row; what a broken off level had added is not read. Without it the table lies in the
    checkpoint folder.
    """

    MANIFEST = "step bigint, folder string, depth int, count bigint, done boolean"

    def __init__(self, spark: SparkSession, root: str, state: str | None = None):
        self.spark, self.state, self.name = spark, state, ""
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        held = self.saved(spark, state) if state else None
        if held:
            self.step, self.depth, self.count, self.done = held.step, held.depth, held["count"], held.done
            rows = spark.read.parquet(held.folder).filter(F.col("depth") <= held.depth)
        else:
            self.step, self.depth, self.count, self.done = 0, 0, 1, False
            rows = spark.range(1).select(F.lit(root).alias("url"), F.lit(0).alias("depth"), F.col("id").alias("ord"))
        self.renew(rows)

    @staticmethod
    def saved(spark: SparkSession, state: str):
        """The last row of a folder's manifest, None where there is none."""
        try:
            return spark.read.schema(Crawl.MANIFEST).parquet(f"{state}/manifest").orderBy(F.desc("step")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def renew(self, rows: DataFrame) -> None:
        """Write the whole table anew: the last level as a part, all before as another."""
        old, self.name = self.name, f"crawl_{uuid.uuid4().hex}"
        self.folder = f"{self.state}/{self.name}" if self.state else shared_folder(self.spark, self.name)
        wave = F.when(F.col("depth") == self.depth, self.depth).otherwise(-1)
        self.add(rows.repartition(self.parts, "url").withColumn("wave", wave))
        self.waves = 1
        if old:
            self.spark.sql(f"drop table {old}")  # the name only: its files stay

    def add(self, rows: DataFrame) -> None:
        writer = rows.select("url", "depth", "ord", "wave").write.mode("append").partitionBy("wave")
        writer.bucketBy(self.parts, "url").option("path", self.folder).saveAsTable(self.name)

    @property
    def visited(self) -> DataFrame:
        """url, depth and ord of all URLs found."""
        return self.spark.table(self.name).select("url", "depth", "ord")

    @property
    def frontier(self) -> DataFrame:
        """url and ord of the last level."""
        return self.spark.table(self.name).filter(F.col("wave") == self.depth).select("url", "ord")

    def advance(self, edges: DataFrame, ordered: bool = True) -> int:
        """Add the next level, which is what ``edges`` lead to from the frontier; returns its size."""
        new, depth = expand_frontier(self.frontier, edges, self.visited), F.lit(self.depth + 1)
        if ordered:
            placed, size = numbered(new, ["parent_ord", "pos", "url"], "__n")
            self.add(placed.select("url", depth.alias("depth"), (F.col("__n") + self.count).alias("ord"), depth.alias("wave")))
            self.depth += 1
        else:
            place = depth.cast("bigint").alias("ord")
            self.add(new.select("url", depth.alias("depth"), place, depth.alias("wave")))
            self.depth += 1
            size = self.frontier.count()
        self.count += size
        self.waves += 1
        self.done = size == 0
        if self.waves > MERGE_EVERY:
            self.renew(self.visited)
        self.save()
        return size

    def save(self) -> None:
        self.step += 1
        if self.state:
            row = [(self.step, self.folder, self.depth, self.count, self.done)]
            self.spark.createDataFrame(row, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.state}/manifest")

    def found(self) -> DataFrame:
        """``visited`` for good: no level can be added after."""
        self.spark.sql(f"drop table {self.name}")
        return self.spark.read.schema("url string, depth int, ord bigint, wave int").parquet(self.folder).drop("wave")


def reachable(
    edges: DataFrame,
    root: str,
    max_urls: int | None = None,
    ordered: bool = True,
    state: str | None = None,
    max_levels: int | None = None,
) -> DataFrame:
    """Breadth-first closure from ``root``: url, depth and ``ord``, the place in the order.

    A URL is placed by the first link to it: by its parent's place, then by the link's. Each
    level is written to a table, so the plan stays small and a lost executor costs one level.
    Stops when a level finds nothing or ``max_urls`` different URLs are found. Without a limit
    the order can be left out (``ordered=False``), which saves sorting every level; ``ord`` is
    then the depth.

    With ``state``, a folder, a crawl that was stopped goes on where it was (see ``Crawl``), over the
    links as they are now. ``max_levels`` stops it after so many levels.
    """
    if max_urls is not None and not ordered:
        raise ValueError("a limit needs the order")
    crawl = Crawl(edges.sparkSession, root, state)
    # copies of a page repeat its links: combined before the shuffle, each link is kept once
    # and laid out by their source, by which every level joins them
    links = cut_by(edges.groupBy("src_url", "dst_url").agg(F.min("pos").alias("pos")), "src_url")
    levels = 0
    while not crawl.done and (max_urls is None or crawl.count < max_urls) and (max_levels is None or levels < max_levels):
        crawl.advance(links, ordered)
        levels += 1
    found = crawl.found()
    return found if max_urls is None else found.filter(F.col("ord") < max_urls)


def discovered_urls(edges: DataFrame) -> DataFrame:
    """Different targets in the order of discovery: url, page_id and pos of the first link."""
    seen = edges.select(F.col("dst_url").alias("url"), "page_id", "pos")
    return dedupe_first(seen, "url", ["page_id", "pos"], keep_null=False)
