"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import catalog as C
from shelfmark.operators import dedup as D
from shelfmark.operators import graph as G
from shelfmark.operators import html as H
from shelfmark.operators import stats as A
from shelfmark.plans import jobs as J
from shelfmark.plans import registry, shop
from shelfmark.plans.queries_tables import page_titles, part_catalog
from shelfmark.plans.shop import ROOT
from shelfmark.session import empty_table, local_session, run_folder

RUNS = 3


def cores(spark: SparkSession) -> int:
    """The tables lie in one file each; their rows are dealt to all cores."""
    return spark.sparkContext.defaultParallelism


def stored_pages(spark: SparkSession, sf: str) -> DataFrame:
    return registry.table(spark, sf, "pages").repartition(cores(spark), "page_id")


def shop_pages(spark: SparkSession, sf: str) -> DataFrame:
    return shop.shop_pages(spark, sf, parts=cores(spark))


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    parts = part_catalog(spark, sf)
    return C.upsert_catalog(parts.filter("ord % 2 = 0"), parts.filter("ord % 2 = 1"), ["url"])


def job(spark: SparkSession, sf: str) -> DataFrame:
    empty = empty_table(spark, C.CATALOG_SCHEMA)
    return C.sort_by_name(J.catalog_job(shop_pages(spark, sf), empty, materialize=False).catalog)


def running(spark: SparkSession, sf: str) -> DataFrame:
    lines = registry.table(spark, sf, "lineitem")
    batches = lines.selectExpr(
        "l_returnflag as crawl_id", "l_orderkey * 10 + l_linenumber as batch_id", "1 as n_urls", "l_tax as seconds"
    )
    return A.batch_running_stats(batches)


def reach(spark: SparkSession, sf: str) -> DataFrame:
    return G.reachable(G.link_edges(shop_pages(spark, sf), ROOT), ROOT, ordered=False)


def job_v1(spark: SparkSession, sf: str) -> DataFrame:
    """The whole crawl; every title is taken."""

    def reply(batches: DataFrame) -> DataFrame:
        every = batches.groupBy("batch_id").agg(F.to_json(F.collect_list("url")).alias("reply"))
        return every.withColumn("attempt", F.lit(1))

    return J.catalog_job_v1(shop_pages(spark, sf), ROOT, reply)


# Iterative and stateful ones take many small jobs, so one warm run tells enough.
ONCE = {
    "reachable": reach,
    "catalog_job_v1": job_v1,
    "stream_upsert": lambda s, d: registry.QUERIES["stream_upsert"](s, d),
}
QUERIES = {
    "elements": lambda s, d: H.elements(stored_pages(s, d)),
    "extract_links": lambda s, d: H.extract_links(stored_pages(s, d)),
    "title_dedupe": lambda s, d: D.dedupe_first(page_titles(s, d), "title", ["page_id"]),
    "page_text_cleaned": lambda s, d: H.page_text(stored_pages(s, d), cleaned=True),
    "shop_fields": lambda s, d: H.extract_fields(shop_pages(s, d)),
    "shop_fields_v1": lambda s, d: H.extract_fields_v1(shop_pages(s, d)),
    "shop_links": lambda s, d: G.link_edges(shop_pages(s, d), ROOT),
    "upsert_catalog": upsert,
    "catalog_job": job,
    "batch_running_stats": running,
}


def rows(df: DataFrame) -> int:
    """Compute every column of every row."""
    hashed = df.select(F.xxhash64(*df.columns).alias("h"))
    return hashed.agg(F.count(F.lit(1)), F.bit_xor("h")).first()[0]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    registry.load()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times, counts = {}, {}
    for name, query in {**QUERIES, **ONCE}.items():
        with run_folder(spark):
            counts[name] = rows(query(spark, sf))  # warm
        measured = []
        for _ in range(1 if name in ONCE else RUNS):
            with run_folder(spark):
                started = time.perf_counter()
                rows(query(spark, sf))
                measured.append(time.perf_counter() - started)
        times[name] = round(statistics.median(measured), 3)
    print(
        json.dumps(
            {
                "metric": "total of median warm times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows": counts,
                "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
