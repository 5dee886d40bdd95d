"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.catalog import to_catalog
from ..operators.order import row_index

PAGES_SCHEMA = "page_id bigint, url string, html string"
RECORD_END = "-------\n"


def only_loaded(pages: DataFrame) -> DataFrame:
    """Pages that loaded as HTML, where the snapshot says how they loaded."""
    if "status" in pages.columns:
        pages = pages.filter("coalesce(status, 200) = 200")
    if "content_type" in pages.columns:
        pages = pages.filter(F.col("content_type").contains("text/html"))
    return pages


def read_pages(spark: SparkSession, path: str, loaded_only: bool = True) -> DataFrame:
    pages = spark.read.parquet(path)
    return only_loaded(pages) if loaded_only else pages


def read_lines(spark: SparkSession, path: str, drop_empty: bool = False) -> DataFrame:
    """One stripped value per line."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("value"))
    return lines.filter("value <> ''") if drop_empty else lines


def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A product table with catalogue columns, also from one with ``title`` and ``image``."""
    if fmt == "csv":
        raw = spark.read.option("multiLine", True).option("escape", '"').csv(path, header=True)
    else:
        raw = spark.read.format(fmt).load(path)
    return to_catalog(raw)


def read_product_records(spark: SparkSession, path: str) -> DataFrame:
    """Text records by their end line: name (the first line), record, ord.

    ``ord`` numbers the records of all files, by the files' names and the places in them, however the
    files are dealt to tasks.
    """
    raw = spark.read.option("lineSep", RECORD_END).text(path)
    # rows of a split follow each other in its task, so their own numbers are ordered
    place = {
        "__file": F.col("_metadata.file_path"),
        "__block": F.col("_metadata.file_block_start"),
        "__row": F.monotonically_increasing_id(),
    }
    placed = raw.select(F.col("value").alias("record"), *[c.alias(n) for n, c in place.items()])
    record = row_index(placed.filter(strip(F.col("record")) != ""), list(place), "ord")
    name = strip(F.element_at(F.split(strip(F.col("record")), "\n"), 1))
    return record.select(name.alias("name"), "record", "ord")
