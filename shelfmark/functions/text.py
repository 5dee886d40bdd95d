"""Text columns: strip, character references, title head, clean-up of page text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from html.entities import html5, name2codepoint
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip removes: Unicode white space and the four separator controls.
SPACE = r"[\s\x1c-\x1f]"

# White space somewhere between here and the last "]" that closes the match: the next line
# break if that lies on the following line, else the first white space of this line. The plain
# form ".*\s.*" finds the same text but tries every white space for every "[".
_GAP = r"(?:.*+\n|\S*+[^\S\n]).*"
# Where the first "[" (or "![") of a line closes nothing, the later ones of that line do not
# either, so only the first after a line start or after the last match is tried. What lies
# before it is put back.
_TO_BRACKET = r"(?:^|\G)([^\[\n]*+)"
_TO_IMAGE = r"(?:^|\G)((?:[^!\n]|!(?!\[))*+)"

# The rewrite rules for page text, in the order in which they apply, each as
# (pattern, replacement, text without which it cannot match).
CLEAN_RULES = [
    (r"!\[\]([^)]*\))", "", "![]"),
    (rf"{_TO_BRACKET}\[{_GAP}\]([^)]*+\))", "$1", "["),
    (r"\[\s*\]\([^)]*\)", "", "]("),
    (r"\[!\]\([^)]*\)", "", "[!]"),
    (rf"\[\s*!\[{_GAP}\]([^)]*\))\s*\]\([^)]*\)", "", "!["),
    (r"(\w)-\n(\w)", "$1$2", "-"),
    (r"(?<!\n)\n(?!\n)", " ", None),
    (r"\n\s*\n", "\n", None),
    (r"(?:(?:(?<!\s)|\G)\s++)?!\s*$", "", "!"),
    (r"(?<!\s)\s++!", " ", "!"),
    (r"~", "", "~"),
    (rf"{_TO_IMAGE}!\[{_GAP}\]([^)]*+\))", "$1", "!["),
    (rf"{_TO_BRACKET}\[{_GAP}\]([^)]*+\))", "$1", "["),
    (rf"{_TO_BRACKET}\[.*?\]\(.*?\)!\[.*?\]\(.*?\)", "$1", ")!["),
    (rf"{_TO_BRACKET}\[.*?\]\(.*?\)", "$1", "]("),
]


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the columns that ``build`` makes, per Spark context and arguments.

    A large expression takes thousands of calls into the JVM to put together, and a stream
    needs the same ones for every batch.
    """
    kept: WeakKeyDictionary[SparkContext, dict] = WeakKeyDictionary()

    @wraps(build)
    def found(*args) -> Column:
        context = SparkContext._active_spark_context
        if context is None:
            return build(*args)
        columns = kept.setdefault(context, {})
        if args not in columns:
            columns[args] = build(*args)
        return columns[args]

    return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A Python variable that is used twice puts its whole expression into the plan twice, and
    nested uses multiply. Here ``body`` sees the element of a one-element array instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Python's ``str.strip``. ``trim`` would leave line breaks and no-break spaces."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def blank_to_null(c: Column) -> Column:
    return let(c, lambda v: F.when(v != "", v))


def _code_point(number: Column) -> Column:
    """The character of a code point; ``chr`` only knows the first 256."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def decode_references(c: Column) -> Column:
    """Replace ``&name;``, ``&#n;`` and ``&#xh;`` in one pass; unknown references stay.

    Names are those of HTML 4 and ``apos``. The semicolon may be missing after a number, and after the
    names that have always done without one, unless a letter, a digit or ``=`` follows. The names
    are taken from Python's own tables.
    """
    points = {**name2codepoint, "apos": ord("'")}
    table = "\x02".join(f"{name}\x01{chr(point)}" for name, point in points.items())
    names = F.str_to_map(F.lit(table), F.lit("\x02"), F.lit("\x01"))
    open_names = [name for name in html5 if not name.endswith(";") and name in points]

    def numbered(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^#[xX]?0*([0-9a-fA-F]*)$", 1)
        number = F.when(ref.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.when((F.length(digits) <= 7) & valid, _code_point(number))

    def one(piece: Column) -> Column:
        def replaced(ref: Column) -> Column:
            after = F.substring(piece, F.length(ref) + 1, F.lit(1))
            named = (after == ";") | (ref.isin(open_names) & (after != "="))
            char = (
                F.when(ref == "", F.lit(None))
                .when(ref.startswith("#"), numbered(ref))
                .when(named, F.element_at(names, ref))
            )
            tail = F.substring(piece, F.length(ref) + F.when(after == ";", 2).otherwise(1), F.length(piece))
            return F.coalesce(F.concat(char, tail), F.concat(F.lit("&"), piece))

        ref = r"^(#[0-9]++|#[xX][0-9a-fA-F]++|[a-zA-Z][a-zA-Z0-9]*+)"
        return let(F.regexp_extract(piece, ref, 1), replaced)

    def decoded(pieces: Column) -> Column:
        others = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(others, ""))

    return let(c, lambda v: F.when(v.contains("&"), let(F.split(v, "&"), decoded)).otherwise(v))


def title_head(title: Column) -> Column:
    """The part of a title before the first `` - `` or `` | ``; empty becomes NULL."""
    return F.element_at(F.split(blank_to_null(title), r"(?U)\s[-|]\s"), 1)


def clean_text(c: Column) -> Column:
    """Apply ``CLEAN_RULES`` in order.

    ``U``: white space and word characters are Unicode's; ``d``: only ``\\n`` ends a line;
    ``m``: ``$`` is the end of each line.
    """
    for pattern, replacement, needed in CLEAN_RULES:
        c = _rewritten(c, f"(?Udm){pattern}", replacement, needed)
    return c


def _rewritten(c: Column, pattern: str, replacement: str, needed: str | None) -> Column:
    if needed is None:
        return F.regexp_replace(c, pattern, replacement)
    return let(c, lambda v: F.when(v.contains(needed), F.regexp_replace(v, pattern, replacement)).otherwise(v))
