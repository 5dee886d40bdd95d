"""What several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut

# A word of the contracts that count words: what ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[dict[str, pa.Array]], dict[str, list]]], schema: str
) -> DataFrame:
    """Rows of ``df`` through Python, an Arrow batch at a time and one row out for each row in.

    ``make`` runs once in each task and returns the function from the columns of a batch to the
    columns of the result.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for small in bounded(batch):
                columns = dict(zip(small.schema.names, small.columns, strict=True))
                done = work(columns)
                made = [done[f.name] for f in arrow]
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(arrow, made, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes, a single row at least."""
    rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``a``, ``b``: every linked node with the smallest of its component.

    Large-star and small-star rounds, each a group and a join on the shrinking list of links, written
    to the shared folder after each. Nothing but a count and a checksum of the links comes to the
    driver. Self-links and repeated links change nothing; a node without links is not returned.
    """
    links = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        links = cut(_small_star(_large_star(links)))
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = tuple(now)


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()
