"""The product catalogue: its columns, the upsert, its order and size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.price import price_current, price_eur, price_last
from ..functions.text import strip
from .dedup import absent, dedupe_first

# Columns of the catalogue, and of the first version's, in order.
CATALOG_COLUMNS = ["name", "description", "price", "url", "image_url", "keywords"]
CATALOG_COLUMNS_V1 = ["name", "url", "description", "image_url", "keywords", "price", "cleaned_content"]
CATALOG_SCHEMA = ", ".join(f"{c} string" for c in CATALOG_COLUMNS)


def to_catalog(df: DataFrame, *extra: str) -> DataFrame:
    """Catalogue columns from product details or an older catalogue; the name is stripped."""
    renamed = df.withColumnsRenamed({"title": "name", "image": "image_url"})
    name = strip(F.col("name"))
    columns = [name.alias("name"), *CATALOG_COLUMNS[1:5], name.alias("keywords"), *extra]
    return renamed.select(*columns)


def upsert_catalog(
    existing: DataFrame,
    new: DataFrame,
    order_by: Sequence[str] = ("url",),
    existing_is_unique: bool = False,
) -> DataFrame:
    """Add the products whose name the catalogue does not hold yet.

    A known name keeps its row. Among new products of one name the first in the order of
    ``order_by`` is taken; products without a name are not added. A catalogue written by this
    function has unique names: then only its name column is shuffled, not its rows.
    """
    held = to_catalog(existing)
    order = [c for c in order_by if c not in CATALOG_COLUMNS]
    added = to_catalog(new, *order).filter("name is not null")
    if existing_is_unique:
        first = dedupe_first(added, "name", order_by, keep_null=False)
        return held.unionByName(absent(first.select(*CATALOG_COLUMNS), "name", held, "name"))
    both = held.withColumn("__new", F.lit(0)).unionByName(
        added.withColumn("__new", F.lit(1)), allowMissingColumns=True
    )
    ties = [c for c in CATALOG_COLUMNS if c not in order_by]
    return dedupe_first(both, "name", ["__new", *order_by, *ties]).select(*CATALOG_COLUMNS)


def extend_catalog(existing: DataFrame, fresh: DataFrame, existing_is_unique: bool = False) -> DataFrame:
    """Add products that are known to be new and to have different names: no join is needed."""
    held = to_catalog(existing)
    if not existing_is_unique:
        ties = [c for c in CATALOG_COLUMNS if c not in ("name", "url")]
        held = dedupe_first(held, "name", ["url", *ties])
    return held.unionByName(to_catalog(fresh))


def total_products(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count(F.lit(1)).alias("total_products"))


def sort_by_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Ascending, missing names last. The other columns break ties, so that a frequent name
    can be spread over several tasks and the order is total."""
    others = [c for c in df.columns if c != name]
    return df.orderBy(F.asc_nulls_last(name), *others)


def require_price(df: DataFrame, allow_no_price: bool = False) -> DataFrame:
    return df if allow_no_price else df.filter(F.col("price").isNotNull())


def reformat_prices(df: DataFrame, how: str = "last") -> DataFrame:
    """Rewrite a catalogue's ``price`` column in one of the three formats."""
    formats = {"last": price_last, "current": price_current, "eur": price_eur}
    return df.withColumn("price", formats[how](F.col("price")))


def select_available(df: DataFrame, columns: Sequence[str] = CATALOG_COLUMNS_V1) -> DataFrame:
    """Those of the wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in columns if c in df.columns])
