"""Order and position: exact row numbers without a single task, last rows, first n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

def row_index(df: DataFrame, order_by: Sequence[str], name: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2, … in the order of ``order_by``, which must be total.

    A global ``row_number`` would send every row to one task. Here the rows are sorted into
    ranges, each numbers its own, and the table is written; what is shared is one count per
    range. The ranges are read back from the table, so a lost task cannot shift them.
    """
    return numbered(df, order_by, name)[0]


def numbered(df: DataFrame, order_by: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """``row_index`` and the number of rows."""
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = cut(ranges.withColumn("__range", F.spark_partition_id()).withColumn("__own", own))
    sizes = dict(placed.groupBy("__range").agg(F.count(F.lit(1))).collect())  # one number per range
    starts, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        starts.append(str(total))
        total += sizes.get(i, 0)
    # one literal: the first number of each range
    start = F.get(F.split(F.lit(" ".join(starts) or "0"), " ").cast("array<bigint>"), F.col("__range"))
    return placed.select(*df.columns, (start + F.col("__own")).alias(name)), total


def last_n(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The last ``n`` rows; which rows these are is found like ``take_until``."""
    placed, total = numbered(df, order_by, "__idx")
    return placed.filter(F.col("__idx") >= total - n).orderBy(F.desc("__idx")).drop("__idx")


def take_until(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows, found by row numbers: however large ``n`` is, no task sorts them alone."""
    return row_index(df, order_by, "__idx").filter(F.col("__idx") < n).drop("__idx")
