"""Streams of page snapshots: source, deduplication, upsert, target, resume.

The catalogue of a stream is a folder with one part per batch, ``stream=<s>/batch=<id>``. A batch
writes only the products that no other part holds, so its cost does not grow with the
catalogue's rows, only with the names it is checked against. Running a batch again after a failure
replaces its own part and gives the same result. Streams with different checkpoints number their
batches from 0 each, so ``<s>`` is made from the checkpoint: they may share a folder, one after the
other, and lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import CATALOG_COLUMNS, CATALOG_SCHEMA, to_catalog
from ..operators.dedup import absent, dedupe_first
from ..session import empty_table
from ..sources.readers import PAGES_SCHEMA


TARGET_MET = "the catalogue holds its target of"


class TargetMet(Exception):
    """Ends a stream whose catalogue is large enough."""


def stream_pages(
    spark: SparkSession,
    folder: str,
    files_per_batch: int = 10,
    schema: str = PAGES_SCHEMA,
    glob: str | None = None,
) -> DataFrame:
    """Page files of a folder, a bounded number per batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def stream_dedupe(pages: DataFrame, key: str = "url", fetched: str | None = None, within: str = "1 day") -> DataFrame:
    """Each URL once over all batches.

    With a fetch time the state is bounded: a repeat is dropped as long as its key is remembered, which is
    ``within`` after the key's first row, in the time of the stream. Then the key is forgotten, and a row
    with it counts as new. The time of the stream is that of its latest row less ``within``, as of the
    batch before; rows older than that are late and dropped, whatever their key.
    Without one the state holds every key ever seen, because nothing says when to forget it.
    Whole rows are shuffled by the key, so extract what is needed and drop the HTML before.
    """
    if fetched is None:
        return pages.dropDuplicates([key])
    return pages.withWatermark(fetched, within).dropDuplicatesWithinWatermark([key])


def read_stream_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue that streams have written; empty before the first batch."""
    schema = f"{CATALOG_SCHEMA}, stream string, batch bigint"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_table(spark, schema)


def upsert_batch(
    new: DataFrame,
    batch_id: int,
    folder: str,
    order_by: tuple[str, ...] = ("url",),
    base: DataFrame | None = None,
    stream: str = "0",
) -> None:
    """Write the products of one batch that neither other batches nor ``base`` have."""
    spark = new.sparkSession
    own = (F.col("stream") == stream) & (F.col("batch") == batch_id)
    earlier = read_stream_catalog(spark, folder).filter(~own).select("name")
    if base is not None:
        earlier = earlier.unionByName(base.select("name"))
    order = [c for c in order_by if c not in CATALOG_COLUMNS]
    first = dedupe_first(to_catalog(new, *order), "name", order_by, keep_null=False)
    fresh = absent(first.select(*CATALOG_COLUMNS), "name", earlier, "name")
    fresh.write.mode("overwrite").parquet(f"{folder}/stream={stream}/batch={batch_id}")


def stream_upsert(
    pages: DataFrame,
    to_products: Callable[[DataFrame], DataFrame],
    folder: str,
    checkpoint: str,
    order_by: tuple[str, ...] = ("url",),
    base: DataFrame | None = None,
    target: int | None = None,
) -> StreamingQuery:
    """Run ``to_products`` on every batch of pages and add the result to the catalogue.

    With ``target``, no batch is begun when the catalogue holds that many products: the query ends
    with ``TargetMet``, keeps the whole of the batch that met it, and leaves later input to the
    next run.

    ``base`` is a catalogue that the stream's own parts come on top of, such as what
    ``compact`` has written of an earlier folder.
    ``checkpoint`` holds what was read: a query started again with it goes on where the last
    one ended.
    """

    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        if target is not None and read_stream_catalog(batch.sparkSession, folder).count() >= target:
            raise TargetMet(f"{TARGET_MET} {target}")
        upsert_batch(to_products(batch), batch_id, folder, order_by, base, stream)

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_until_target(
    start: Callable[[], StreamingQuery], catalog: Callable[[], DataFrame], target: int
) -> int:
    """Start the query until the target is met or a run finds no input; returns the product count.

    Each run of ``start`` handles what is available, at most up to its own target, and ends.
    """
    held = catalog().count()
    while held < target:
        query = start()
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            if TARGET_MET not in str(e):
                raise
        held = catalog().count()
        if not any(p["numInputRows"] for p in query.recentProgress):
            break
    return held


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """Write a stream's catalogue as one table sorted by name.

    After many batches, go on in a new folder with this table as ``base``: reading it is
    cheaper than reading many small parts.
    """
    held = read_stream_catalog(spark, folder).select(*CATALOG_COLUMNS)
    held.orderBy("name").write.mode("overwrite").parquet(target)
