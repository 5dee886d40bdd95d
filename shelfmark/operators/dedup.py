"""Deduplication and membership joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import SENTINELS

# Rows of the input among which equal rows without a key are counted.
PART = 65_536


def dedupe_first(df: DataFrame, key: str, order_by: Sequence[str], keep_null: bool = True) -> DataFrame:
    """The first row of each key in the order of ``order_by``.

    ``min_by`` is combined before the shuffle, so a key that holds a third of all rows sends
    one row per task. Rows with a NULL key are kept as they are, or dropped with
    ``keep_null=False``. Kept ones are grouped by the whole row and a part of the input of bounded
    size, which spreads them over all tasks without a second pass over the input, and repeated
    as often as they occurred there: at most ``PART`` times, also when all rows are equal.
    """
    row = F.struct(*df.columns)
    order = F.struct(*order_by)
    if not keep_null:
        best = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"))
        return best.agg(F.min_by(row, order).alias("__row")).select("__row.*")
    part = F.floor(F.monotonically_increasing_id() / PART)
    whole = F.when(F.col(key).isNull(), F.struct(row, part.alias("__part")))
    parted = df.select(F.col(key).alias("__key"), whole.alias("__whole"), row.alias("__all"), order.alias("__order"))
    best = parted.groupBy("__key", "__whole").agg(
        F.min_by("__all", "__order").alias("__row"), F.count(F.lit(1)).alias("__n")
    )
    times = F.when(F.col("__key").isNull(), F.col("__n")).otherwise(1).cast("int")
    return best.select("__row", F.explode(F.sequence(F.lit(1), times))).select("__row.*")


def distinct_urls(df: DataFrame, column: str = "url") -> DataFrame:
    return df.select(column).distinct()


def absent(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Rows whose value is not among the known ones; NULL is never known.

    The known side is reduced to distinct values first, so a value that is frequent there
    meets each row of ``df`` once.
    """
    values = known.select(F.col(known_column).alias("__known")).filter("__known is not null").distinct()
    return df.join(values, df[column] == values["__known"], "left_anti")


def exclude_processed_urls(df: DataFrame, log: DataFrame) -> DataFrame:
    return absent(df, "url", log, "url")


def exclude_processed_titles(df: DataFrame, log: DataFrame) -> DataFrame:
    return absent(df, "title", log, "title")


def titles_missing_from_catalog(titles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Titles that the catalogue does not hold; repeats stay."""
    return absent(titles, "title", catalog, "name").filter("title is not null")


def with_missing_titles(urls: DataFrame, titles: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """All URLs with their kept title, ``Title not found`` where none was kept.

    ``read`` (url, title before deduplication) adds ``status``: kept, duplicate or missing.
    """
    kept = titles.select("url", "title")
    joined = urls.select("url").distinct().join(kept, "url", "left")
    shown = F.coalesce("title", F.lit(SENTINELS["title"]))
    if read is None:
        return joined.select("url", shown.alias("title"))
    had_title = read.groupBy("url").agg(F.count("title").alias("__read"))
    status = (
        F.when(F.col("title").isNotNull(), "kept").when(F.col("__read") > 0, "duplicate").otherwise("missing")
    )
    return joined.join(had_title, "url", "left").select("url", shown.alias("title"), status.alias("status"))


def keep_selected(titles: DataFrame, selected: DataFrame) -> DataFrame:
    """Pairs whose URL was selected, each once however often it was returned."""
    return titles.join(selected.select("url").distinct(), "url", "left_semi").select(*titles.columns)


def combine_catalogs(a: DataFrame, b: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Rows of both; for a name in both, the row of ``a``."""
    both = a.withColumn("__source", F.lit(0)).unionByName(
        b.withColumn("__source", F.lit(1)), allowMissingColumns=True
    )
    return dedupe_first(both, "name", ["__source", *order_by]).drop("__source")


def combine_records(a: DataFrame, b: DataFrame, order_by: str = "ord") -> DataFrame:
    """Merge text records by name: the last record wins and takes the place of the first."""
    both = a.withColumn("__source", F.lit(0)).unionByName(b.withColumn("__source", F.lit(1)))
    place = F.struct("__source", order_by)
    merged = both.groupBy("name").agg(
        F.max_by("record", place).alias("record"), F.min(place).alias("__place")
    )
    return merged.select(
        "name",
        "record",
        F.col("__place.__source").alias("source"),
        F.col(f"__place.{order_by}").alias(order_by),
    )


def drop_failed(df: DataFrame, *columns: str) -> DataFrame:
    """Without the rows of failed reads, where the given columns (default: all) are NULL."""
    return df.dropna(how="all", subset=list(columns) or None)
