"""Shop pages built from the ``part`` table.

The stored ``pages`` have no prices, images or links to one another, so the product operators
run on pages written from ``part``. The expressions are plain SQL that Spark and DuckDB
evaluate alike; beside ``html`` they give the fields that extraction has to find in it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession


ROOT = "https://shop.example/p/1"

# Pages that a task builds and cuts up. The table they are built from is a hundredth of their size, so that
# its files are far too few tasks for them.
PAGES_PER_TASK = 4000

_K = "cast(p_partkey as {T})"
_PRICE = "cast(cast(p_retailprice as decimal(18,2)) as {T})"
_COMMA = f"replace({_PRICE}, '.', ',')"

_OG_TITLE = (
    "case when p_partkey % 19 = 0 then 'Contacto' "
    "when p_partkey % 23 = 0 then 'SUDADERAS COMFY' "
    "when p_partkey % 3 = 1 then concat(p_name, ' - ', p_brand, ' | Shop') "
    "when p_partkey % 3 = 2 then concat(p_name, ' & ', p_brand, ' | Shop') end"
)
_PRICE_TEXT = (
    "case when p_partkey % 11 = 0 then '0,00€' "
    f"when p_partkey % 17 = 0 then concat('El precio original era: 9,99€. El precio actual es: ', {_COMMA}, ' €') "
    f"else concat({_COMMA}, ' €') end"
)
# every seventh price paragraph is not closed, so a strict reading takes in the rest of the page
_OPEN_PRICE = "p_partkey % 7 = 0"
_DESCRIPTION = f"concat(p_type, ' size ', cast(p_size as {{T}}))"

# name -> SQL over the columns of part; {T} is the engine's text type, {N} the number of parts
COLUMNS = {
    "page_id": "p_partkey",
    "url": f"concat('https://shop.example/p/', {_K}, case when p_partkey % 5 = 0 then '?ref=x' else '' end)",
    "og_title": _OG_TITLE,
    "title": f"coalesce({_OG_TITLE}, p_name)",
    "og_image": f"case when p_partkey % 13 <> 0 then concat('https://img.example/', {_K}, '.jpg') end",
    "image": f"case when p_partkey % 13 <> 0 then concat('https://img.example/', {_K}, '.jpg') "
    f"when p_partkey % 2 = 0 then concat('/z/', {_K}, '.jpg') end",
    "og_description": "case when p_partkey % 4 = 0 then concat('About ', p_name) end",
    "description": f"case when p_partkey % 4 = 0 then concat('About ', p_name) else {_DESCRIPTION} end",
    "div_description": _DESCRIPTION,
    "price_text": _PRICE_TEXT,
    "price_text_v1": f"case when {_OPEN_PRICE} then concat({_PRICE_TEXT}, {_DESCRIPTION}, p_name, ' of ', p_brand, "
    f"'nextmoreShop Aviso') when p_partkey % 11 <> 0 then {_PRICE_TEXT} end",
    "script_price": f"case when p_partkey % 2 = 0 then {_PRICE} end",
    "external_scripts": "p_partkey % 8",
}

HTML = (
    "concat('<!DOCTYPE html><html><head><!-- <meta property=\"og:title\" content=\"no\"> -->', "
    f"case when ({_OG_TITLE}) is null then '' "
    # attributes the other way round, single quotes, a character reference
    f"when p_partkey % 3 = 2 then concat('<META content=', chr(39), replace({_OG_TITLE}, '&', '&amp;'), chr(39), "
    "' property=', chr(39), 'og:title', chr(39), ' />') "
    f"else concat('<meta property=\"og:title\" content=\"', {_OG_TITLE}, '\">') end, "
    f"case when p_partkey % 13 <> 0 then concat('<meta property=og:image content=\"https://img.example/', {_K}, "
    "'.jpg\">') else '' end, "
    "case when p_partkey % 4 = 0 then concat('<meta property=\"og:description\" content=\" About ', p_name, ' \">') "
    "else '' end, "
    "repeat('<script src=\"/s.js\"></script>', cast(p_partkey % 8 as int)), "
    f"case when p_partkey % 2 = 0 then concat('<script>var _amtm_tm_product_ = {{{{\"price\":', {_PRICE}, "
    "'}}; \"<p>\"</script>') else '' end, "
    "'</head><body><nav><ul><li><a href=\"/contacto\">Contacto</a></li></ul></nav>', "
    "'<h1 class=\"h1 page-title\"> <span>', p_name, '</span> </h1>', "
    f"case when p_partkey % 2 = 0 then concat('<img class=\"big zoomContainer\" src=\"/z/', {_K}, '.jpg\">') else '' end, "
    f"'<p class=\"price\">', {_PRICE_TEXT}, case when {_OPEN_PRICE} then '' else '</p>' end, "
    "'<div class=\"short-description col-sm-12 value content\">', p_type, "
    "' <b>size <div></div>', cast(p_size as {T}), '</b></div>', "
    "'<div class=\"product-description\">', p_name, ' of ', p_brand, '</div>', "
    f"'<a href=\"/p/', cast((p_partkey * 2) % {{N}} as {{T}}), '#top\">next</a>', "
    f"'<a href=\"/p/', cast((p_partkey * 2 + 1) % {{N}} as {{T}}), '\">more</a>', "
    "'<footer>Shop <a href=\"/aviso.pdf\">Aviso</a></footer></body></html>')"
)


def shop_sql() -> str:
    """A common table expression ``shop`` for DuckDB, with html and the fields in it."""
    columns = {**COLUMNS, "html": HTML}
    listed = ", ".join(
        f"{sql.format(T='varchar', N='(select count(*) from part)')} as {name}" for name, sql in columns.items()
    )
    return f"shop as (select {listed} from part)"


def page_tasks(count: int) -> int:
    """Tasks for so many pages."""
    return max(1, math.ceil(count / PAGES_PER_TASK))


def spread_parts(spark: SparkSession, sf_dir: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """The table ``part`` and its row count; its rows, which are short, are dealt to ``parts`` partitions, or to
    one for every ``PAGES_PER_TASK`` pages, before anything is built from them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    count = part.count()
    tasks = parts or page_tasks(count)
    return part.repartition(tasks) if parts or tasks > 1 else part, count


def shop_pages(spark: SparkSession, sf_dir: str, *extra: str, parts: int | None = None) -> DataFrame:
    """page_id, url, html (and, for inputs of other operators, further columns by name), in ``parts``
    partitions, or as many as their number asks for."""
    part, count = spread_parts(spark, sf_dir, parts)
    columns = {**COLUMNS, "html": HTML}
    wanted = ["page_id", "url", "html", *extra]
    return part.selectExpr(*[f"{columns[c].format(T='string', N=count)} as {c}" for c in wanted])


def shop_columns(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """Columns of the shop without its HTML."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.selectExpr(*[f"{COLUMNS[c].format(T='string', N=0)} as {c}" for c in wanted])
