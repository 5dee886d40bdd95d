"""Writers, logs and run numbering."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import CATALOG_COLUMNS, sort_by_name
from ..operators.html import SENTINELS

RUNS_SCHEMA = "site string, execution int, config_json string"

# The text form of a product, as Java format strings over name, price,
# description, name, url.
TEXT_FORMATS = {
    "plain": "%s\nPrecio: %s\n\n%s\n\nInformación extraída de [%s](%s)\n\n-------\n\n",
    "iva": "%s\nPrecio: %s (IVA incluido)\n\n%s\n\nInformación extraída de [%s](%s)\n\n-------\n",
}


def product_text(template: str = "plain") -> Column:
    """The text form of a catalogue row; a missing field is shown by its sentinel."""

    def shown(column: str, field: str) -> Column:
        return F.coalesce(F.col(column), F.lit(SENTINELS[field]))

    name = shown("name", "title")
    return F.format_string(
        TEXT_FORMATS[template],
        name,
        shown("price", "price"),
        shown("description", "description"),
        name,
        F.coalesce("url", F.lit("")),
    )


def to_product_text(catalog: DataFrame, template: str = "plain") -> DataFrame:
    return catalog.select(product_text(template).alias("value"))


def write_product_text(catalog: DataFrame, path: str, template: str = "plain") -> None:
    """Text files of the products. Plain records end themselves; ``iva`` ones are joined by a line end."""
    separator = "\n" if template == "iva" else ""
    text = to_product_text(catalog, template)
    if not separator:
        # the writer always ends a record, so the last line end of the format is left to it
        text = text.select(F.regexp_replace("value", r"\n\z", "").alias("value"))
    text.write.mode("overwrite").option("lineSep", "\n").text(path)


def write_catalog(catalog: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Catalogue columns, sorted by name over all files, replacing what was there.

    The sort is a range shuffle: files hold successive ranges of names.
    """
    columns = [c for c in CATALOG_COLUMNS if c in catalog.columns]
    writer = sort_by_name(catalog.select(*columns, *[c for c in catalog.columns if c not in columns])).write
    writer = writer.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def append_processed_log(processed: DataFrame, path: str) -> None:
    """Append (url, title) of a run, once."""
    processed.select("url", "title").write.mode("append").parquet(path)


def log_lines(processed: DataFrame) -> DataFrame:
    """The log as text: ``title: url``."""
    shown = F.coalesce("title", F.lit(SENTINELS["title"]))
    return processed.select(F.concat(shown, F.lit(": "), F.col("url")).alias("value"))


def logged_titles(processed: DataFrame) -> DataFrame:
    """Titles of the log, without the sentinel."""
    return processed.filter(F.col("title") != SENTINELS["title"]).select("title")


def write_url_list(df: DataFrame, path: str, column: str = "url") -> None:
    """One URL per line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def next_execution(runs: DataFrame, fixed: bool = False) -> DataFrame:
    """Number of the next run of each site; with ``fixed`` that of the last one."""
    step = 0 if fixed else 1
    return runs.groupBy("site").agg((F.max("execution") + F.lit(step)).cast("int").alias("execution"))


def execution_number(runs: DataFrame, site: str, fixed: bool = False) -> int:
    """The same for one site, which may have no run yet: then 1, or 0 with ``fixed``."""
    found = next_execution(runs.filter(F.col("site") == site), fixed).agg(F.max("execution")).first()[0]
    return found if found is not None else (0 if fixed else 1)


def run_config_row(spark: SparkSession, site: str, execution: int, config: Mapping[str, object]) -> DataFrame:
    """One row that records what a run was configured with."""
    settings = F.struct(*[_setting(v).alias(k) for k, v in sorted(config.items())])
    return spark.range(1).select(
        F.lit(site).alias("site"), F.lit(execution).alias("execution"), F.to_json(settings).alias("config_json")
    )


def append_run(spark: SparkSession, path: str, site: str, execution: int, config: Mapping[str, object]) -> None:
    """Record a run in the table of runs."""
    run_config_row(spark, site, execution, config).write.mode("append").parquet(path)


def _setting(value: object) -> Column:
    if isinstance(value, list | tuple):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value)


def write_run_output(df: DataFrame, path: str, site: str, execution: int) -> None:
    """Under one folder per site and execution; writing a run again replaces that run only."""
    tagged = df.withColumns({"site": F.lit(site), "execution": F.lit(execution)})
    (
        tagged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("site", "execution")
        .parquet(path)
    )
