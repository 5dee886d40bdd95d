"""Product selection: batches of titles, prompts, replies, and a rule that needs no model."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.urls import video_embed, video_id
from .order import row_index

# Fixed value: titles per prompt.
BATCH_SIZE = 30
# Fixed value: replies asked for before a batch counts as empty.
MAX_ATTEMPTS = 3

# Titles of pages with general information or help.
INFO_TITLES = [
    "Contacto",
    "Política de Devolución",
    "Términos y Condiciones",
    "Buscar",
    "Preguntas Frecuentes",
    "Soporte al Cliente",
    "Información de Envíos",
]
# Example titles of category pages.
CATEGORY_TITLES = ["PANTALONES LARGOS", "CAMISETAS LARGAS", "SUDADERAS COMFY"]
# Keywords that a video must not get.
BANNED_KEYWORDS = ["Kit Camper", "Kit Mueble", "Kit Mueblre Camper", "Camperizar", "Camperización"]

# A list literal and nothing else: texts in either quote, numbers, names, nested brackets.
_LIST = (
    r"""(?s)\A\s*\[(?:[^\[\]"'{}]++|"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+')*+\]\s*\z"""
)

PRODUCT_TEMPLATE = (
    "Product: {title}\n"
    "Page text: {description}\n"
    "Answer with the price and four keywords that fit only this product, separated by commas: "
    "price€, keyword1, keyword2, keyword3, keyword4\n"
)
VIDEO_TEMPLATE = (
    "Video: {title}\n"
    "Description: {description}\n"
    "Answer with one to four keywords that fit only this video, separated by commas; "
    "the fewer the better. Never use: " + ", ".join(BANNED_KEYWORDS) + ".\n"
)


@dataclass(frozen=True)
class ShopProfile:
    """What a prompt says about the shop."""

    sells: str = ""
    product_titles: Sequence[str] = ()
    category_titles: Sequence[str] = tuple(CATEGORY_TITLES)
    info_titles: Sequence[str] = tuple(INFO_TITLES)


def make_batches(titles: DataFrame, size: int = BATCH_SIZE, order_by: Sequence[str] = ("page_id",)) -> DataFrame:
    """Consecutive groups of ``size`` titles: adds batch_id and the place in the batch."""
    numbered = row_index(titles, order_by, "__idx")
    return numbered.select(
        *titles.columns,
        F.floor(F.col("__idx") / F.lit(size)).alias("batch_id"),
        (F.col("__idx") % F.lit(size)).alias("place"),
    )


def prompt_head(shop: ShopProfile) -> str:
    """What a selection prompt says before its rows."""
    lines = [
        "You get a JSON list of pages of a shop, each with its url and title.",
        f"The shop sells: {shop.sells}" if shop.sells else "",
        "Answer with a list of the urls whose title is that of a single product.",
        "Titles of products: " + "; ".join(shop.product_titles) if shop.product_titles else "",
        "Leave out category pages, such as: " + "; ".join(shop.category_titles) if shop.category_titles else "",
        "Leave out information and help pages, such as: " + "; ".join(shop.info_titles),
        "If in doubt, take the page in. Answer with the list alone.",
    ]
    return "\n".join(x for x in lines if x) + "\n\n"


def selection_prompts(batches: DataFrame, shop: ShopProfile = ShopProfile()) -> DataFrame:
    """One prompt per batch. A batch has a fixed number of rows, so its list is small."""
    rows = F.array_sort(F.collect_list(F.struct("place", "url", "title")))
    listed = F.transform("rows", lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title")))
    return (
        batches.groupBy("batch_id")
        .agg(rows.alias("rows"))
        .select("batch_id", F.concat(F.lit(prompt_head(shop)), F.to_json(listed)).alias("prompt"))
    )


def reply_urls(reply: Column) -> Column:
    """The list in a reply; NULL when the reply is anything but one list."""
    closed = F.regexp_replace(reply, r",\s*\]\s*\z", "]")
    items = F.from_json(closed, "array<string>", {"allowBackslashEscapingAnyCharacter": "true"})
    return F.when(reply.rlike(_LIST), items)


def parse_selection(responses: DataFrame) -> DataFrame:
    """Adds ``urls``: an array, or NULL for an invalid reply."""
    return responses.withColumn("urls", reply_urls(F.col("reply")))


def first_valid_attempt(batches: DataFrame, responses: DataFrame, max_attempts: int | None = None) -> DataFrame:
    """Per batch the first valid reply; none gives an empty list. ``max_attempts`` leaves later ones out."""
    valid = parse_selection(responses).filter("urls is not null")
    if max_attempts is not None:
        valid = valid.filter(F.col("attempt") <= max_attempts)
    first = valid.groupBy("batch_id").agg(F.min_by("urls", "attempt").alias("urls"))
    empty = F.array().cast("array<string>")
    return (
        batches.select("batch_id")
        .distinct()
        .join(first, "batch_id", "left")
        .select("batch_id", F.coalesce("urls", empty).alias("urls"))
    )


def selected_urls(chosen: DataFrame) -> DataFrame:
    return chosen.select(F.explode("urls").alias("url"))


def rule_select(titles: DataFrame, shop: ShopProfile = ShopProfile()) -> DataFrame:
    """Keep pages that the prompt's rules do not name: a stand-in where no model is asked."""
    title = F.lower(strip(F.col("title")))
    rejected = title.isin([t.lower() for t in shop.category_titles])
    if shop.info_titles:
        # as written, and not as a part of a longer word
        info = "|".join(re.escape(t.lower()) for t in shop.info_titles)
        rejected |= title.rlike(rf"(?U)(?<!\w)(?:{info})(?!\w)")
    return titles.filter(~F.coalesce(rejected, F.lit(False)))


def keyword_prompts(df: DataFrame, template: str = PRODUCT_TEMPLATE) -> DataFrame:
    """One prompt per row from its title and description."""
    before, rest = template.split("{title}", 1)
    between, after = rest.split("{description}", 1)
    prompt = F.concat(
        F.lit(before),
        F.coalesce("title", F.lit("")),
        F.lit(between),
        F.coalesce("description", F.lit("")),
        F.lit(after),
    )
    return df.withColumn("prompt", prompt)


def parse_keywords(responses: DataFrame, has_price: bool) -> DataFrame:
    """``price, k1, …`` or ``k1, …`` to a price and an array of all keywords."""
    price_pattern = r"^\s*([0-9.,]*[0-9]\s*€)\s*,?"
    reply = F.col("reply")
    listed = F.regexp_replace(reply, price_pattern, "") if has_price else reply
    parts = F.filter(F.transform(F.split(listed, ","), strip), lambda k: k != "")
    price = F.nullif(F.regexp_extract(reply, price_pattern, 1), F.lit("")) if has_price else F.lit(None)
    return responses.withColumns({"price": price.cast("string"), "keywords": parts})


def banned_keywords(df: DataFrame, banned: Sequence[str] = BANNED_KEYWORDS) -> DataFrame:
    """Drop the forbidden keywords, in whatever case they are written; order and repeats stay."""
    lowered = [b.lower() for b in banned]
    return df.withColumn("keywords", F.filter("keywords", lambda k: ~F.lower(k).isin(lowered)))


def video_catalog(links: DataFrame, metadata: DataFrame, responses: DataFrame) -> DataFrame:
    """Links whose video has metadata, with embed address, title and keywords.

    ``responses`` has the reply per video id in ``key``. Keywords are the reply as it stands.
    """
    listed = links.select(F.col("value").alias("Link"), video_id(F.col("value")).alias("video_id"))
    replies = responses.select(F.col("key").alias("video_id"), strip(F.col("reply")).alias("Keywords"))
    return (
        listed.join(metadata.select("video_id", F.col("title").alias("Title")), "video_id")
        .join(replies, "video_id", "left")
        .select("Link", video_embed(F.col("Link")).alias("Iframe Link"), "Title", "Keywords")
    )


def typed_video_metadata(metadata: DataFrame) -> DataFrame:
    """Counts as numbers (``N/A`` is NULL), publication time as timestamp."""
    counts = {c: F.col(c).try_cast("bigint") for c in ("viewCount", "likeCount", "commentCount")}
    return metadata.withColumns({**counts, "publishedAt": F.col("publishedAt").try_cast("timestamp")})
