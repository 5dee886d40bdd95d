"""Counts per stage and running batch statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Batches per block of the running sums: what one task sorts at a time.
BLOCK = 100_000


def stage_counts(**stages: DataFrame) -> DataFrame:
    """Rows and different URLs of each named stage."""

    def counted(item: tuple[str, DataFrame]) -> DataFrame:
        name, df = item
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct("url").alias("n_urls")
        ).select(F.lit(name).alias("stage"), "n_rows", "n_urls")

    return reduce(DataFrame.unionByName, map(counted, stages.items()))


def batch_running_stats(batches: DataFrame, block: int = BLOCK) -> DataFrame:
    """Batch number, running URL total and running mean time of each crawl.

    Input: crawl_id, batch_id, n_urls, seconds. A long crawl is cut into blocks of batch
    numbers: totals per block are combined before the shuffle, summed up over the blocks, and
    each block then adds its own batches to what came before it. So no task holds a whole
    crawl. Times are summed as whole microseconds: the result does not depend on the grouping.
    """
    cut_up = batches.select(
        "crawl_id",
        "batch_id",
        "n_urls",
        F.round(F.col("seconds") * F.lit(1_000_000)).cast("bigint").alias("micros"),
        F.floor(F.col("batch_id") / F.lit(block)).alias("block"),
    )
    earlier = Window.partitionBy("crawl_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def before(name: str) -> Column:
        return F.coalesce(F.sum(name).over(earlier), F.lit(0))

    blocks = (
        cut_up.groupBy("crawl_id", "block")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_urls").alias("urls"), F.sum("micros").alias("micros"))
        .select(
            "crawl_id",
            "block",
            before("n").alias("n0"),
            before("urls").alias("urls0"),
            before("micros").alias("micros0"),
        )
    )
    here = Window.partitionBy("crawl_id", "block").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    number = F.col("n0") + F.count(F.lit(1)).over(here)
    micros = F.col("micros0") + F.sum("micros").over(here)
    return cut_up.join(blocks, ["crawl_id", "block"]).select(
        "crawl_id",
        "batch_id",
        number.alias("batch_number"),
        (F.col("urls0") + F.sum("n_urls").over(here)).alias("total_urls"),
        (micros / F.lit(1_000_000) / number).alias("mean_seconds"),
    )
