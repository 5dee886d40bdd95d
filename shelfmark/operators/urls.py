"""Filters on URL columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .dedup import absent


def only_same_site(df: DataFrame, root: str, column: str = "url") -> DataFrame:
    return df.filter(U.same_site(F.col(column), root))


def only_html_pages(df: DataFrame, column: str = "url") -> DataFrame:
    return df.filter(U.is_html_page(F.col(column)))


def exclude_links(df: DataFrame, ignore: DataFrame, column: str = "url") -> DataFrame:
    """Drop the URLs of an ignore list (one column). Spark broadcasts the list if it is small."""
    return absent(df, column, ignore, ignore.columns[0])


def exclude_containing(df: DataFrame, needle: str, part: str = "url", column: str = "url") -> DataFrame:
    """Drop URLs that contain ``needle`` in their query (``part="query"``) or anywhere.

    An empty needle drops nothing, although every text contains it.
    """
    if not needle:
        return df
    looked_at = U.query(F.col(column)) if part == "query" else F.col(column)
    return df.filter(~looked_at.contains(needle))
