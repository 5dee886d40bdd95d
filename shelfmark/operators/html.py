"""HTML as columns: the element list of a page, selectors and the fields built on them.

A page is one row. Its HTML is cut into tokens once, into an array column, and every selector
is an expression over that array. So no field extraction shuffles, and the HTML itself never
leaves the task that read it. ``elements`` shows the same tokens as rows.

Missing values are NULL until the last projection; ``SENTINELS`` are the texts that stand for
them in outputs.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.price import price_amount, price_current, price_eur
from ..functions.text import blank_to_null, built_once, clean_text, decode_references, let, strip, title_head

# Inside a tag: names and values; a quoted value may hold "<" and ">". Possessive throughout,
# so broken HTML costs neither stack nor backtracking.
_ATTRS = r"""(?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+"""
_RAW = r"(?:script|style)"
_COMMENT = r"<!--(?:[^-]++|-(?!->))*+(?:-->|\z)"
# The rest of a script or style; in stretches, as a test after each character costs most where scripts are long.
_RAW_REST = r"(?:[^<]++|<(?!/\1\s*+>))*+(?:</\1\s*+>|\z)"
_RAW_BLOCK = rf"<({_RAW})(?=[\s/>]){_ATTRS}>{_RAW_REST}"
# The same where only some tags are cut out: an unclosed one is passed over whole.
_HIDING = rf"<({_RAW})(?=[\s/>]){_ATTRS}(?:>{_RAW_REST})?+"
# What is no markup, up to the next tag.
_ON = r"(?:[^<]++|<(?![a-z/!?]))*+"
# A tag that does not close takes all that was read for it, and the text after that: nothing is read again
# from within it, so the cost of a page grows with its length whatever it holds.
TOKEN = (
    rf"(?is){_COMMENT}"
    rf"|{_RAW_BLOCK}"
    rf"|</?[a-z]{_ATTRS}(?:>|{_ON})"
    r"|<[!?][^>]*+(?:>|\z)"
    rf"|(?:[^<]|<){_ON}"
)
_ATTR = r"""[^\s"'<>/=][^\s>/=]*+\s*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?"""

# Tags without an end.
VOID_TAGS = [
    "area", "base", "basefont", "br", "col", "embed", "frame", "hr", "img", "input", "isindex", "link",
    "meta", "param", "source", "track", "wbr",
]

_HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# Fixed values of lenient reading: which start tags end an open element, by that element's tag. They and
# the ranks below are the rules of the HTML 4 parser of libxml2, as of its version 2.9.
ENDED_BY = {
    "p": [
        "address", "blockquote", "caption", "center", "col", "colgroup", "dd", "dir", "div", "dl", "dt", "fieldset",
        "form", *_HEADINGS, "hr", "li", "listing", "menu", "ol", "p", "pre", "table", "tbody", "td", "tfoot", "th",
        "tr", "ul", "xmp",
    ],
    **{h: ["fieldset", "form", "li", "p", "table", *[o for o in _HEADINGS if o != h]] for h in _HEADINGS},
    **{font: ["p"] for font in ("big", "s", "small", "strike", "tt")},
    **{font: ["center", "p", "td", "th"] for font in ("b", "i")},
    "u": ["p", "td", "th"],
    "font": ["center", "td", "th"],
    "span": ["td", "th"],
    "a": ["a", "fieldset", "table", "td", "th"],
    "li": ["li"],
    "dt": ["dd"],
    "dd": ["dt"],
    "option": ["optgroup", "option"],
    "td": ["tbody", "td", "tfoot", "th", "tr"],
    "th": ["tbody", "td", "tfoot", "th", "tr"],
    "tr": ["tbody", "tfoot", "tr"],
}

# Fixed values of lenient reading: an end tag does not reach past an open element of higher rank.
END_RANKS = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190,
    "head": 200, "body": 200, "html": 220,
}
OTHER_RANK = 100

# Tags that begin a new line of plain text.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset",
    "figure", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "ol", "p",
    "pre", "section", "table", "title", "tr", "ul",
]

# Texts that stand for a missing field.
SENTINELS = {
    "title": "Title not found",
    "image": "Image not found",
    "description": "Description not found",
    "price": "Price not found",
}
SENTINELS_V1 = {
    "title": "Título no disponible",
    "image": "Imagen no disponible",
    "description": "No hay descripción disponible",
    "price": "Precio no disponible",
}
NO_HTML_TITLE = "No title found"

# Spellings of a zero price.
ZERO_PRICES = ["0", "0.00", "0,00", "0.00€", "0,00€", "€0", "€0.00", "€0,00", "€ 0", "€ 0.00", "€ 0,00"]

# Marks of pages that are drawn by a script framework, and the size limits.
FRAMEWORK_MARKS = r"data-reactroot|data-reactid|ng-app|ng-controller|v-bind|v-model"
MAX_EXTERNAL_SCRIPTS = 5
MAX_INLINE_CHARS = 20000

# The script that holds a product's price, and where in it.
PRICE_SCRIPT_MARK = "_amtm_tm_product_"
PRICE_SCRIPT_PATTERN = r'"price":([0-9.]+)'


@dataclass(frozen=True)
class Selector:
    """A tag with a class, or (for meta tags) with a property."""

    tag: str
    css: str | None = None
    property: str | None = None


# Default selectors.
TITLE_SELECTORS = (Selector("h1", "h1 page-title"),)
DESCRIPTION_SELECTORS = (Selector("div", "short-description col-sm-12 value content"),)
PRICE_SELECTORS = (Selector("p", "price"),)
IMAGE_CLASSES = ("zoomContainer",)

# Default selectors of the first version.
TITLE_SELECTORS_V1 = (Selector("meta", property="og:title"), Selector("h1", "h1 page-title"))
IMAGE_CLASS_V1 = "details-gallery__picture details-gallery__photoswipe-index-0"
PRICE_SELECTORS_V1 = (
    Selector("span", "product-price current-price-value"),
    Selector("div", "elementor-widget-woocommerce-product-price"),
    Selector("p", "price"),
    Selector("div", "details-product-price__value"),
    Selector("span", "product-price"),
    Selector("span", "Price"),
    Selector("span", "price"),
    Selector("span", "ProductMeta__Price"),
    Selector("span", "amount"),
    Selector("span", "price-value"),
    Selector("span", "price-current"),
    Selector("span", "current-price"),
    Selector("span", "actual-price"),
    Selector("span", "sale-price"),
    Selector("span", "details-product-price__value"),
    Selector("div", "product-price"),
    Selector("div", "price"),
    Selector("div", "Price"),
    Selector("div", "ProductMeta__Price"),
    Selector("div", "amount"),
    Selector("div", "price-value"),
    Selector("div", "price-current"),
    Selector("div", "current-price"),
    Selector("div", "actual-price"),
    Selector("div", "sale-price"),
)
DESCRIPTION_SELECTORS_V1 = (
    Selector("div", "metafield-rich_text_field"),
    Selector("div", "elementor-widget-woocommerce-product-content"),
    Selector("div", "product-description"),
    Selector("div", "product-details__product"),
    Selector("div", "product-details"),
    Selector("p", "description"),
    Selector("p", "product-info"),
)


@dataclass(frozen=True)
class Rules:
    """Which selectors a job uses for each field. Give tuples, so that rules can be compared."""

    titles: Sequence[Selector] = TITLE_SELECTORS
    descriptions: Sequence[Selector] = DESCRIPTION_SELECTORS
    prices: Sequence[Selector] = PRICE_SELECTORS
    image_classes: Sequence[str] = IMAGE_CLASSES
    use_og_title: bool = True
    use_og_image: bool = True
    use_og_description: bool = True


@dataclass(frozen=True)
class RulesV1:
    """The first version's selectors and switches."""

    titles: Sequence[Selector] = TITLE_SELECTORS_V1
    descriptions: Sequence[Selector] = DESCRIPTION_SELECTORS_V1
    prices: Sequence[Selector] = PRICE_SELECTORS_V1
    image_class: str = IMAGE_CLASS_V1
    ignore_description: bool = False
    allow_no_price: bool = False
    zero_prices: Sequence[str] = tuple(ZERO_PRICES)


# ---------------------------------------------------------------- tokens


def tokens(html: Column) -> Column:
    """Array of (tag, raw): ``p`` and ``/p`` for tags, ``!`` for comments, ``''`` for text.

    Text is decoded here, once; tags stay as written.
    """

    def token(raw: Column) -> Column:
        # text comes out as '', comments and declarations as '!'
        name = F.lower(F.regexp_extract(raw, r"^<(/?[a-zA-Z][^\s/>]*|[!?])", 1))
        encoded = raw.contains("&") & ~raw.rlike("^<[a-zA-Z/!?]")
        return F.struct(
            F.when(raw.startswith("<"), name).otherwise("").alias("tag"),
            F.when(encoded, decode_references(raw)).otherwise(raw).alias("raw"),
        )

    return F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), token)


def metas(tokens: Column) -> Column:
    """Array of (property, content) of the ``<meta property>`` tags; content '' if empty."""
    tags = F.filter(tokens, lambda t: (t["tag"] == "meta") & t["raw"].rlike("(?i)property"))
    pairs = F.transform(
        tags,
        lambda t: F.struct(
            attribute(t["raw"], "property").alias("property"),
            decode_references(attribute(t["raw"], "content")).alias("content"),
        ),
    )
    return F.filter(pairs, lambda m: m["property"].isNotNull())


def page_metas(html: Column) -> Column:
    """``metas`` without cutting the page up: everything between two ``<meta>`` tags is passed over as ``TOKEN``
    cuts it, in one scan."""
    passed = (
        rf"(?:[^<]++|{_COMMENT}|{_RAW_BLOCK}|<[!?][^>]*+(?:>|\z)"
        rf"|</?(?!meta[\s/>])[a-z]{_ATTRS}>?+|<(?!meta[\s/>]))*+"
    )
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)\G{passed}(<meta(?=[\s/>]){_ATTRS}(?:>|{_ON}))"), F.lit(2))
    return metas(F.transform(tags, lambda raw: F.struct(F.lit("meta").alias("tag"), raw.alias("raw"))))


def _first_content(metas: Column, name: str) -> Column:
    return F.get(F.filter(metas, lambda m: m["property"] == name), F.lit(0))["content"]


def with_tokens(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``tokens`` and ``metas``, from which the field columns below read.

    Both are made by a generator that gives one row per page. The optimizer moves a filter on
    a field below an ordinary projection and would have it cut every page up once more there;
    it does not move one below a generator.
    """
    rest = [c for c in pages.columns if c != "html"]
    cut_up = pages.select(*rest, F.explode_outer(_cut_html()).alias("__cut"))
    return cut_up.select(*rest, "__cut.tokens", "__cut.metas")


@built_once
def _cut_html() -> Column:
    both = let(tokens(F.col("html")), lambda t: F.struct(t.alias("tokens"), metas(t).alias("metas")))
    return F.array(both)


def attribute(raw: Column, name: str) -> Column:
    """Value of an attribute of a start tag, references as written; '' when it has no value,
    NULL when it is absent."""

    def named(a: Column) -> Column:
        return F.lower(F.regexp_extract(a, r"^([^\s=]+)", 1)) == name

    def unquoted(v: Column) -> Column:
        return F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    def found(r: Column) -> Column:
        # the first entry is the tag's own name
        pairs = let(F.regexp_extract_all(r, F.lit(_ATTR), F.lit(0)), lambda p: F.slice(p, F.lit(2), F.size(p)))
        value = F.regexp_replace(F.get(F.filter(pairs, named), F.lit(0)), r"(?s)^[^\s=]+\s*=?\s*", "")
        return F.when(r.rlike(f"(?i){name}"), let(value, unquoted))

    return let(raw, found)


def meta_content(name: str) -> Column:
    """``content`` of the first ``<meta property=name>``; '' when it is there but empty."""
    return _first_content(F.col("metas"), name)


def _inside(tokens: Column, hit: Column, lenient: bool) -> Column:
    """The tokens between the start tag of ``hit`` and its end."""
    rest = F.slice(tokens, hit["at"] + 1, F.size(tokens))
    return F.slice(rest, F.lit(1), _inner_size(tokens, hit, lenient))


def _inner_size(tokens: Column, hit: Column, lenient: bool) -> Column:
    """How many tokens lie between the start tag of ``hit`` (at, tag, raw) and its end.

    Open elements inside are kept on a stack. An end tag closes the innermost element of its
    name and what is open in that; it ends the element itself if it is its own, or that of an
    element around it. End tags of elements that are not open are passed over. An element that
    nothing closes runs to the end of the page. With ``lenient``, start tags in ``ENDED_BY``
    close elements too, and ``END_RANKS`` holds end tags back.
    """
    tag = hit["tag"]
    nothing = F.array().cast("array<string>")
    rest = F.slice(tokens, hit["at"] + 1, F.size(tokens))
    before = F.slice(tokens, F.lit(1), hit["at"] - 1)
    ended_by = F.from_json(F.lit(json.dumps(ENDED_BY)), "map<string,array<string>>")
    ranks = F.from_json(F.lit(json.dumps(END_RANKS)), "map<string,int>")

    def is_empty(t: Column) -> Column:
        return t["tag"].isin("", "!", "script", "style", *VOID_TAGS) | t["raw"].endswith("/>")

    def is_open_around(name: Column) -> Column:
        # only asked when an end tag fits nothing inside, so the walk from the top is rare
        def walk(stack: Column, t: Column) -> Column:
            def without(place: Column) -> Column:
                return F.when(place > 0, F.slice(stack, F.lit(1), F.size(stack) - place)).otherwise(stack)

            end = F.substring(t["tag"], F.lit(2), F.length(t["tag"]))
            return (
                F.when(t["tag"].startswith("/"), let(F.array_position(F.reverse(stack), end).cast("int"), without))
                .when(is_empty(t), stack)
                .otherwise(F.concat(stack, F.array(t["tag"])))
            )

        return F.array_contains(F.aggregate(before, nothing, walk), name)

    def rank(name: Column) -> Column:
        return F.coalesce(F.element_at(ranks, name), F.lit(OTHER_RANK))

    def step(state: Column, t: Column) -> Column:
        stack = state["stack"]

        def moved(stack=stack, strays=state["strays"], is_open=True) -> Column:
            return F.struct(
                F.lit(is_open).alias("is_open"),
                (state["n"] + int(is_open)).alias("n"),
                stack.alias("stack"),
                strays.alias("strays"),
            )

        def ended(name: Column) -> Column:
            def at(place: Column) -> Column:  # from the top of the stack, 0 if not in it
                ends = (name == tag) | (~F.array_contains(state["strays"], name) & is_open_around(name))
                known = F.array_union(state["strays"], F.array(name))
                result = (
                    F.when(place > 0, moved(F.slice(stack, F.lit(1), F.size(stack) - place)))
                    .when(ends, moved(is_open=False))
                    .otherwise(moved(strays=known))
                )
                if not lenient:
                    return result
                passed = F.when(place > 0, F.slice(F.reverse(stack), F.lit(1), place - 1)).otherwise(
                    F.concat(stack, F.array(tag))
                )
                return F.when(F.exists(passed, lambda x: rank(x) > rank(name)), moved()).otherwise(result)

            return let(F.array_position(F.reverse(stack), name).cast("int"), at)

        def started(name: Column) -> Column:
            pushed = moved(F.concat(stack, F.array(name)))
            if not lenient:
                return pushed

            def over(x: Column) -> Column:
                return F.coalesce(F.array_contains(F.element_at(ended_by, x), name), F.lit(False))

            def kept(place: Column) -> Column:  # the topmost open element that stays open, 0 if none
                left = F.concat(F.slice(stack, F.lit(1), F.size(stack) - place + 1), F.array(name))
                return (
                    F.when(place > 0, moved(left))
                    .when(over(tag), moved(is_open=False))
                    .otherwise(moved(F.array(name)))
                )

            staying = F.transform(F.reverse(stack), lambda x: ~over(x))
            return let(F.array_position(staying, F.lit(True)).cast("int"), kept)

        if lenient:  # an element without an end can still close what is open
            closes = t["tag"].isin("hr", "col") & (tag == "p") & (F.size(stack) == 0)
            empty_step = F.when(closes, moved(is_open=False)).otherwise(moved())
        else:
            empty_step = moved()
        return (
            F.when(~state["is_open"], state)
            .when(t["tag"] == "", moved())
            .when(t["tag"].startswith("/"), ended(F.substring(t["tag"], F.lit(2), F.length(t["tag"]))))
            .when(is_empty(t), empty_step)
            .otherwise(started(t["tag"]))
        )

    begin = F.struct(
        (~hit["raw"].endswith("/>")).alias("is_open"),
        F.lit(0).alias("n"),
        nothing.alias("stack"),
        nothing.alias("strays"),
    )
    return F.aggregate(rest, begin, step, lambda s: s["n"])


def _text(inside: Column, strip_each: bool = False) -> Column:
    """Text of a run of tokens, without comments, scripts and styles."""

    def piece(t: Column) -> Column:
        return strip(t["raw"]) if strip_each else t["raw"]

    return F.array_join(F.transform(F.filter(inside, lambda t: t["tag"] == ""), piece), "")


def inner_text(tokens: Column) -> Column:
    """All text of a page in document order."""
    return _text(tokens)


# Stands for the classes of an element that has none.
_NO_CLASS = "\0"


def _matches(tokens: Column, selectors: Sequence[Selector], any_class: bool = False) -> Column:
    """For each selector, in order, its first element as (at, tag, raw); no match, no entry.

    One walk over the tokens, however many selectors there are: an element's tag with its whole class and
    with each of its classes are looked up in the places of the selectors.
    """
    tags = sorted({s.tag for s in selectors})

    def key(s: Selector) -> str:
        return s.tag if any_class else f"{s.tag} {_NO_CLASS if s.css is None else s.css}"

    places = {key(s): n for n, s in reversed(list(enumerate(selectors)))}
    index = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])

    def names(t: Column) -> Column:
        if any_class:
            return F.array(t["tag"])

        def of(css: Column) -> Column:
            every = F.array_distinct(F.concat(F.array(css), F.split(css, " ")))
            return F.transform(every, lambda c: F.concat(t["tag"], F.lit(" "), c))

        css = strip(F.regexp_replace(attribute(t["raw"], "class"), r"(?U)\s+", " "))
        return let(F.coalesce(css, F.lit(_NO_CLASS)), of)

    def candidate(t: Column, i: Column) -> Column:
        found = F.filter(F.transform(names(t), lambda n: F.element_at(index, n)), lambda p: p.isNotNull())
        hit = F.struct((i + 1).alias("at"), t["tag"].alias("tag"), t["raw"].alias("raw"))
        return F.when(t["tag"].isin(tags), F.transform(found, lambda p: F.struct(p.alias("place"), hit.alias("hit"))))

    def firsts(hits: Column) -> Column:
        return F.filter(hits, lambda h, i: (i == 0) | (F.get(hits, i - 1)["place"] != h["place"]))

    hits = F.flatten(F.filter(F.transform(tokens, candidate), lambda c: c.isNotNull()))
    return F.transform(let(F.array_sort(hits), firsts), lambda h: h["hit"])


def first_by_class(
    selectors: Sequence[Selector],
    *,
    skip: Sequence[str] = (),
    first_match_wins: bool = False,
    strip_each: bool = False,
    any_class: bool = False,
    lenient: bool = True,
) -> Column:
    """Text of the first element that a selector finds, selectors tried in order.

    Empty texts, and those in ``skip``, move on to the next selector unless
    ``first_match_wins``. ``any_class`` ignores the classes. NULL when nothing is found.
    """
    if not selectors:
        return F.lit(None).cast("string")

    def text(h: Column) -> Column:
        inside = _inside(F.col("tokens"), h, lenient)
        joined = _text(inside, strip_each)
        return joined if strip_each else strip(joined)

    hits = _matches(F.col("tokens"), selectors, any_class)
    if first_match_wins:
        return F.get(F.transform(F.slice(hits, 1, 1), text), F.lit(0))
    texts = F.transform(hits, text)
    return F.get(F.filter(texts, lambda x: (x != "") & ~x.isin("", *skip)), F.lit(0))


def image_by_class(classes: Sequence[str], first_match_wins: bool = False) -> Column:
    """``src`` of the first ``img`` that carries one of the classes, classes tried in order."""
    if not classes:
        return F.lit(None).cast("string")
    hits = _matches(F.col("tokens"), [Selector("img", c) for c in classes])
    sources = F.transform(
        hits, lambda h: F.coalesce(strip(decode_references(attribute(h["raw"], "src"))), F.lit(""))
    )
    if first_match_wins:
        return F.get(sources, F.lit(0))
    return F.get(F.filter(sources, lambda s: s != ""), F.lit(0))


# ---------------------------------------------------------------- fields of a page, as columns


@built_once
def page_title(rules: Rules = Rules()) -> Column:
    """og:title as it stands, else the first title element's text, pieces stripped."""
    by_tag = _title_by_tag(rules)
    if not rules.use_og_title:
        return by_tag
    return F.coalesce(blank_to_null(meta_content("og:title")), by_tag)


def _title_by_tag(rules: Rules) -> Column:
    return blank_to_null(first_by_class(rules.titles, first_match_wins=True, strip_each=True))


@built_once
def _cut_title() -> Column:
    """(og, tokens): og:title from a scan for meta tags; the page is cut up only where there is none."""
    og = blank_to_null(_first_content(page_metas(F.col("html")), "og:title"))
    both = let(og, lambda t: F.struct(t.alias("og"), F.when(t.isNull(), tokens(F.col("html"))).alias("tokens")))
    return F.array(both)


@built_once
def page_title_v1(rules: RulesV1 = RulesV1()) -> Column:
    """Selectors in order; an og entry needs a content, a tag entry counts whatever its class."""
    tries = []
    for s in rules.titles:
        if s.property:
            # present and not empty wins, even if only white space is in it
            tries.append(strip(blank_to_null(meta_content(s.property))))
        else:
            tries.append(first_by_class([s], first_match_wins=True, any_class=True, lenient=False))
    return blank_to_null(F.coalesce(*tries))


@built_once
def page_image(rules: Rules = Rules()) -> Column:
    by_class = image_by_class(rules.image_classes)
    if not rules.use_og_image:
        return by_class
    return F.coalesce(blank_to_null(strip(meta_content("og:image"))), by_class)


@built_once
def page_image_v1(rules: RulesV1 = RulesV1()) -> Column:
    return F.coalesce(
        strip(meta_content("og:image")), image_by_class([rules.image_class], first_match_wins=True)
    )


@built_once
def page_description(rules: Rules = Rules()) -> Column:
    by_tag = first_by_class(rules.descriptions)
    if not rules.use_og_description:
        return by_tag
    return F.coalesce(blank_to_null(strip(meta_content("og:description"))), by_tag)


@built_once
def page_description_v1(rules: RulesV1 = RulesV1()) -> Column:
    """The first matching element wins even if it is empty."""
    if rules.ignore_description:
        return F.lit(None).cast("string")
    return first_by_class(rules.descriptions, first_match_wins=True, lenient=False)


@built_once
def page_price_text(rules: Rules = Rules()) -> Column:
    return first_by_class(rules.prices)


@built_once
def page_price_text_v1(rules: RulesV1 = RulesV1()) -> Column:
    return first_by_class(rules.prices, skip=rules.zero_prices, lenient=False)


@built_once
def script_price() -> Column:
    """The price in the first script that holds product data."""
    script = F.get(
        F.filter("tokens", lambda x: (x["tag"] == "script") & x["raw"].contains(PRICE_SCRIPT_MARK)), F.lit(0)
    )
    return blank_to_null(F.regexp_extract(script["raw"], PRICE_SCRIPT_PATTERN, 1))


def status_title(status: Column, title: Column) -> Column:
    """The title of a page that did not load is its status."""
    return F.when(status != 200, F.concat(F.lit("Status code: "), status.cast("string"))).otherwise(title)


def html_title(html: Column) -> Column:
    """Text of the first ``<title>``, taken from the HTML without cutting the whole page up.

    Comments, raw blocks, declarations and tags are passed over as ``TOKEN`` cuts them, and like there
    what does not end runs to the end of the page.
    """
    before = (
        rf"(?:[^<]++|{_COMMENT}|{_RAW_BLOCK}|<[!?][^>]*+(?:>|\z)"
        rf"|</?(?!title[\s/>])[a-z]{_ATTRS}>?+|<title(?=[\s/]){_ATTRS}(?!>)|<(?!title[\s/>]))*+"
    )
    found = F.regexp_extract(html, rf"(?is)\A{before}<title{_ATTRS}>(.*?)</title", 2)
    return decode_references(blank_to_null(found))


@built_once
def page_text_column() -> Column:
    """Plain text without ``nav`` and ``footer`` parts; blocks are set off by an empty line."""
    t = F.col("tokens")

    def mark(x: Column, i: Column) -> Column:
        hit = F.struct((i + 1).alias("at"), x["tag"].alias("tag"), x["raw"].alias("raw"))
        return F.when(x["tag"].isin("nav", "footer"), hit)

    def run(start: Column, end: Column) -> Column:
        return F.array(F.struct(start.alias("start"), (end - start).alias("len")))

    def step(s: Column, m: Column) -> Column:
        left_out = F.struct(
            (m["at"] + _inner_size(t, m, False)).alias("start"),
            F.concat(s["kept"], run(s["start"], m["at"] - 1)).alias("kept"),
        )
        return F.when(m["at"] <= s["start"], s).otherwise(left_out)  # else it lies in a part left out

    marks = F.filter(F.transform(t, mark), lambda m: m.isNotNull())
    begin = F.struct(
        F.lit(0).alias("start"), F.array().cast("array<struct<start:int,len:int>>").alias("kept")
    )
    runs = F.aggregate(marks, begin, step, lambda s: F.concat(s["kept"], run(s["start"], F.size(t))))
    kept = F.flatten(F.transform(runs, lambda r: F.slice(t, r["start"] + 1, r["len"])))

    def written(x: Column) -> Column:
        name = F.regexp_replace(x["tag"], "^/", "")
        # line breaks in the source are only spaces
        flowing = F.regexp_replace(x["raw"], r"[ \t\r\n\f]+", " ")
        return F.when(x["tag"] == "", flowing).when(name.isin(BLOCK_TAGS), "\n\n").when(name == "br", "\n").otherwise("")

    text = F.array_join(F.transform(kept, written), "")
    text = F.regexp_replace(text, r" *+(\n+) *+", "$1")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


@built_once
def _price() -> Column:
    return price_eur(F.col("price_text"))


@built_once
def _price_amount() -> Column:
    return price_amount(F.col("price_text"))


@built_once
def _price_v1() -> Column:
    return price_current(F.col("price_text"))


@built_once
def _cleaned() -> Column:
    return clean_text(F.col("text"))


# ---------------------------------------------------------------- operators


def elements(pages: DataFrame) -> DataFrame:
    """One row per token: page_id, pos, kind, tag, attrs, text."""
    exploded = with_tokens(pages).select("page_id", F.posexplode("tokens").alias("pos", "token"))
    tag, raw = F.col("token.tag"), F.col("token.raw")
    raw_block = tag.isin("script", "style")
    kind = (
        F.when(tag == "", "text")
        .when(tag == "!", "comment")
        .when(raw_block, "raw")
        .when(tag.startswith("/"), "close")
        .otherwise("open")
    )
    attrs = F.when(kind.isin("open", "raw"), F.regexp_extract(raw, rf"(?s)^<[^\s/>]+({_ATTRS})>", 1))
    body = F.regexp_extract(raw, rf"(?is)^<[^\s/>]+{_ATTRS}>(.*?)(?:</{_RAW}\s*>)?\z", 1)
    return exploded.select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        kind.alias("kind"),
        F.when(kind.isin("open", "close", "raw"), F.regexp_replace(tag, "^/", "")).alias("tag"),
        strip(attrs).alias("attrs"),
        F.when(kind == "text", raw).when(kind == "raw", body).alias("text"),
    )


def extract_links(pages: DataFrame) -> DataFrame:
    """Every ``<a href>`` in document order: page_id, src_url, pos, href."""
    # only anchors (and what may hide one) are cut out
    only_anchors = rf"(?is){_COMMENT}|{_HIDING}|<a(?=[\s/]){_ATTRS}>?+"
    found = F.filter(
        F.regexp_extract_all("html", F.lit(only_anchors), F.lit(0)), lambda r: r.rlike(r"(?i)^<a[\s/]") & r.endswith(">")
    )
    hrefs = F.filter(
        F.transform(found, lambda r: decode_references(attribute(r, "href"))), lambda h: h.isNotNull()
    )
    # the outer form: for the inner one the optimizer adds a filter that finds the links twice
    links = pages.select("page_id", F.col("url").alias("src_url"), F.posexplode_outer(hrefs).alias("pos", "href"))
    return links.filter("pos is not null").withColumn("pos", F.col("pos").cast("bigint"))


def meta_property(pages: DataFrame, name: str) -> DataFrame:
    """page_id and the content of the named meta property; empty and absent are NULL."""
    found = blank_to_null(_first_content(page_metas(F.col("html")), name))
    # a generator, so that the filter on what is found does not find it once more
    return pages.select("page_id", F.explode(F.array(found)).alias("content")).filter("content is not null")


def script_stats(pages: DataFrame) -> DataFrame:
    """Per page: scripts with a source, characters of the others."""
    only_scripts = rf"(?is){_COMMENT}|{_HIDING}"
    # the start tag has closed, so that there is a script
    scripts = F.filter(
        F.regexp_extract_all("html", F.lit(only_scripts), F.lit(0)), lambda r: r.rlike(rf"(?is)^<script{_ATTRS}>")
    )

    def measured(raw: Column) -> Column:
        # the end tag is what follows the last "<", if the script has one: its body is not read for it
        last = F.substring_index(raw, "<", -1)
        end = F.when(last.rlike(r"(?i)\A/script\s*+>\z"), F.length(last) + 1).otherwise(0)

        def after(start_tag: Column) -> Column:
            external = F.coalesce(attribute(start_tag, "src") != "", F.lit(False))
            return F.struct(external.alias("external"), (F.length(raw) - F.length(start_tag) - end).alias("chars"))

        return let(F.regexp_extract(raw, rf"(?is)^<script{_ATTRS}>", 0), after)

    def counted(measured_scripts: Column) -> Column:
        inline = F.filter(measured_scripts, lambda s: ~s["external"])
        return F.struct(
            F.size(F.filter(measured_scripts, lambda s: s["external"])).cast("bigint").alias("external_scripts"),
            F.aggregate(inline, F.lit(0).cast("bigint"), lambda n, s: n + s["chars"]).alias("inline_chars"),
        )

    rest = [c for c in pages.columns if c != "html"]
    framework = reduce(Column.__or__, [F.col("html").contains(mark) for mark in FRAMEWORK_MARKS.split("|")])
    # a generator, so that both numbers come from one reading of the scripts
    both = F.explode(F.array(let(F.transform(scripts, measured), counted)))
    found = pages.select(*rest, framework.alias("framework"), both.alias("__scripts"))
    return found.select(*rest, "__scripts.external_scripts", "__scripts.inline_chars", "framework")


def is_js_heavy(pages: DataFrame) -> DataFrame:
    """Pages with a framework mark, more than 5 external scripts or 20000 inline characters."""
    heavy = (
        F.col("framework")
        | (F.col("external_scripts") > MAX_EXTERNAL_SCRIPTS)
        | (F.col("inline_chars") > MAX_INLINE_CHARS)
    )
    return script_stats(pages).withColumn("js_heavy", heavy)


def page_text(pages: DataFrame, cleaned: bool = False) -> DataFrame:
    shown = with_tokens(pages).withColumn("text", page_text_column()).drop("tokens", "metas")
    return shown.withColumn("text", _cleaned()) if cleaned else shown


def strict_og(pages: DataFrame) -> DataFrame:
    """Only pages that have og:title, og:image and og:description."""
    fields = {n: strip(meta_content(f"og:{n}")) for n in ("title", "image", "description")}
    found = with_tokens(pages).select("page_id", "url", *[c.alias(n) for n, c in fields.items()])
    return found.dropna(subset=["title", "image", "description"])


def _only_loaded_html(pages: DataFrame) -> DataFrame:
    """Without the HTML of pages whose ``status`` says that they did not load."""
    if "status" not in pages.columns:
        return pages
    loaded = F.coalesce(F.col("status") == 200, F.lit(True))  # not told: it loaded
    return pages.withColumn("html", F.when(loaded, F.col("html")))


def extract_titles(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All columns but the HTML, and the title, as ``extract_fields`` has it.

    A page whose og:title counts is not cut up for it.
    """
    pages = _only_loaded_html(pages)
    rest = [c for c in pages.columns if c != "html"]
    if rules.use_og_title:
        read = pages.select(*rest, F.explode_outer(_cut_title()).alias("__cut")).select(*rest, "__cut.og", "__cut.tokens")
        title = F.coalesce("og", _title_by_tag(rules))
    else:
        read, title = with_tokens(pages), page_title(rules)
    if "status" in pages.columns:
        title = status_title(F.col("status"), title)
    return read.select(*rest, title.alias("title"))


def extract_fields(pages: DataFrame, rules: Rules = Rules(), titled: bool = True) -> DataFrame:
    """All fields of every page in one pass: title, image, description, price, price_amount; without the title
    unless ``titled``.

    Missing values are NULL. Pages with a ``status`` other than 200 get their status as title
    and no other field, as their HTML is not looked at.
    """
    read = with_tokens(_only_loaded_html(pages))
    fields = {
        "image": page_image(rules),
        "description": page_description(rules),
        "price_text": page_price_text(rules),
    }
    rest = [c for c in read.columns if c not in ("tokens", "metas")]
    if titled:
        title = page_title(rules)
        if "status" in pages.columns:
            title = status_title(F.col("status"), title)
        # a generator, so that filters on the title do not find it once more each
        read = read.select("*", F.explode(F.array(title)).alias("title"))
        rest = [*rest, "title"]
    found = read.select(*rest, *[c.alias(n) for n, c in fields.items()])
    return found.select(
        *rest,
        "image",
        "description",
        _price().alias("price"),
        _price_amount().alias("price_amount"),
    )


def extract_fields_v1(pages: DataFrame, rules: RulesV1 = RulesV1()) -> DataFrame:
    """The first version's fields: og_title, name, image_url, description, price, cleaned_content."""
    read = with_tokens(pages)
    rest = [c for c in read.columns if c not in ("tokens", "metas")]
    found = read.select(
        *rest,
        blank_to_null(meta_content("og:title")).alias("og_title"),
        page_title_v1(rules).alias("title"),
        page_image_v1(rules).alias("image_url"),
        page_description_v1(rules).alias("description"),
        F.coalesce(page_price_text_v1(rules), script_price()).alias("price_text"),
        page_text_column().alias("text"),
    )
    return found.select(
        *rest,
        "og_title",
        title_head(F.coalesce("title", F.lit(SENTINELS_V1["title"]))).alias("name"),
        "image_url",
        "description",
        _price_v1().alias("price"),
        _cleaned().alias("cleaned_content"),
    )


def product_details(pages: DataFrame, titles: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """url, title, image, description and price of the selected URLs.

    Only their pages are cut up: the list is joined to the pages first, and broadcast if it is short.
    """
    wanted = pages.join(titles.select("url").distinct(), "url", "left_semi")
    fields = extract_fields(wanted, rules, titled=False)
    return (
        titles.select("url", "title")
        .join(fields, "url")
        .select("url", "title", "image", "description", "price", "price_amount")
    )


def with_sentinels(df: DataFrame, sentinels: dict[str, str] = SENTINELS) -> DataFrame:
    """Put the texts for missing values in; the last step before an output."""
    names = {"name": "title", "image_url": "image"}
    shown = {c: sentinels.get(names.get(c, c)) for c in df.columns}
    return df.select(*[F.coalesce(c, F.lit(s)).alias(c) if s else F.col(c) for c, s in shown.items()])
