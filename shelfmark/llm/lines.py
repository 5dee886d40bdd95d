"""Line deduplication by log templates: a tree of fixed depth over the tokens of a line.

A line is parsed by its number of tokens, then by its leading tokens, then to a template of the rest,
in which variable fields are generalised: tokens with a digit, and in long lines one of
``STRETCHES`` stretches of the tokens after the leading ones. Lines that meet in a template have the
number, the leading tokens and all other stretches in common. A template that recurs in several
documents is dropped from all of them but one, the one with the smallest id, so that nothing that
only copies hold is lost altogether.

Templates are keys of 128 bits, so the tree needs no task that holds a branch: the ids of a template's
documents are a minimum and a maximum, which are partly taken before anything moves. Texts do not
move with the keys.

Defined results: a null text stays null, an empty one empty. Lines of fewer than ``LEAST`` tokens are
never dropped by the query; the pipeline's stage (``dedup``) drops them if they recur exactly and have
``EXACT`` characters at least, so that short notices go, and paragraphs of scripts without spaces. Rows of the same id are one document, rows without id are one too, the last. All
else of a text, with the order of its lines, stays. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

LEAST = 5  # tokens of a line that is parsed
EXACT = 16  # characters of a shorter line that is compared as it is; below are brackets, rules, single words
LEADING = 2  # leading tokens, the inner levels of the tree
LONG = 12  # tokens of a line that may have a variable stretch
STRETCHES = 3
VARIABLE = "<*>"


def tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit generalised."""
    masked = F.regexp_replace(F.trim(line), r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", VARIABLE)
    return F.split(masked, r"[\s]+")


def key(*parts: Column | str) -> Column:
    """A key of 128 bits."""
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))


def templates(lines: DataFrame, keep: list[str], exact: bool = False) -> DataFrame:
    """Columns ``keep`` and ``keys``, the templates that ``line`` may belong to; none for a short line, or
    with ``exact`` the line itself."""
    n, rest = F.size("words"), F.greatest(F.size("words") - LEADING, F.lit(0))
    bounds = [F.floor(rest * k / STRETCHES).cast("int") for k in range(STRETCHES + 1)]
    parts = [
        F.concat_ws(" ", F.slice("words", LEADING + 1 + lo, hi - lo)) for lo, hi in zip(bounds, bounds[1:], strict=False)
    ]
    lead = F.concat_ws(" ", F.slice("words", 1, LEADING))
    names = [f"part{k}" for k in range(STRETCHES)]
    whole = F.trim("line")
    parsed = lines.select(*keep, tokens(F.col("line")).alias("words"), F.when(F.lit(exact), whole).alias("whole"))
    parsed = parsed.filter((n >= LEAST) | (F.length("whole") >= EXACT))
    # a step of its own for what several keys are made of, so that it is computed once
    parsed = parsed.select(*keep, n.alias("n"), F.when(n < LEAST, F.col("whole")).alias("whole"), lead.alias("lead"), *[p.alias(x) for x, p in zip(names, parts, strict=True)])
    open_ = [key("n", "lead", *[F.lit(VARIABLE) if k == j else F.col(x) for k, x in enumerate(names)]) for j in range(STRETCHES)]
    keys = F.when(F.col("n") >= LONG, F.array(*open_)).otherwise(F.array(key("n", "lead", *names)))
    if exact:
        keys = F.when(F.col("n") < LEAST, F.array(key("n", "whole"))).otherwise(keys)
    return parsed.select(*keep, keys.alias("keys"))


def recurring(docs: DataFrame, exact: bool = False) -> DataFrame:
    """For ``rid``, ``id``, ``text``: the lines whose template recurs, as ``rid``, ``place`` and whether
    the line is to be ``dropped``."""
    lines = docs.select("rid", "id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    keyed = cut(templates(lines, ["rid", "id", "place"], exact).select("rid", "id", "place", F.inline_outer("keys")))  # outer: no filter that parses twice
    # rows without id are one document, the last
    several = (
        keyed.groupBy("h1", "h2")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("nameless"))
        .filter((F.col("first") != F.col("last")) | (F.col("nameless") & F.col("first").isNotNull()))
        .select("h1", "h2", "first")
    )
    found = keyed.join(several, ["h1", "h2"]).groupBy("rid", "place")
    return found.agg(F.max(~F.col("id").eqNullSafe(F.col("first"))).alias("dropped"))


def strip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_lines``, ``n_recurring``, ``n_dropped`` and ``kept_text``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = cut(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("rid")), compression="zstd")
    named = held.select("rid", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text}`").alias("text"))
    marks = recurring(named, exact).groupBy("rid").agg(
        F.count(F.lit(1)).alias("n_recurring"), F.collect_list(F.when(F.col("dropped"), F.col("place"))).alias("places")
    )
    none = F.array().cast("array<int>")
    marked = held.join(marks.hint("shuffle_hash"), "rid", "left").select(
        "row",
        F.split(F.col(f"row.`{text}`"), "\n").alias("lines"),
        F.coalesce("n_recurring", F.lit(0)).cast("long").alias("n_recurring"),
        F.coalesce("places", none).alias("places"),
    )
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.transform(F.array_except(every, F.col("places")), lambda k: F.get("lines", k))
    return marked.select(
        "row",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        "n_recurring",
        F.size("places").cast("long").alias("n_dropped"),
        F.when(F.size("places") == 0, F.col(f"row.`{text}`")).otherwise(F.array_join(left, "\n")).alias("kept_text"),
    )


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, ``n_lines``, ``n_recurring``, ``n_dropped`` and the ``text`` left."""
    return strip(docs, id_col, text).select(
        F.col(f"row.`{id_col}`").alias(id_col), "n_lines", "n_recurring", "n_dropped", F.col("kept_text").alias("text")
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with the text that is left, its length in the column ``length``, and all other columns;
    short lines that recur exactly go too."""

    def column(name: str) -> Column:
        if name == text:
            return F.col("kept_text")
        if name == length:
            changed = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema[name].dataType))
            return F.coalesce(changed, F.col(f"row.`{name}`"))
        return F.col(f"row.`{name}`")

    return strip(docs, id_col, text, exact=True).select(*[column(c).alias(c) for c in docs.columns])


ORACLE = r"""
with d as (select row_number() over () as rid, doc_id as id, text, string_split(text, chr(10)) as lines from documents),
l as (select rid, id, unnest(lines) as line, unnest(range(len(lines))) as place from d where text is not null),
w as (select rid, id, place, regexp_split_to_array(array_to_string(list_transform(string_split(trim(line, ' '), ' '),
    lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end), ' '), '[ \t\n\x0B\f\r]+') as words from l),
p as (select rid, id, place, words, len(words) as n, len(words) - 2 as size from w where len(words) >= 5),
q as (select rid, id, place, n, array_to_string(words[1:2], ' ') as lead, array_to_string(words[3:2 + size // 3], ' ') as a,
    array_to_string(words[3 + size // 3:2 + size * 2 // 3], ' ') as b, array_to_string(words[3 + size * 2 // 3:], ' ') as c from p),
k as (select rid, id, place, unnest(case when n >= 12 then [[n::varchar, lead, '<*>', b, c], [n::varchar, lead, a, '<*>', c],
    [n::varchar, lead, a, b, '<*>']] else [[n::varchar, lead, a, b, c]] end) as key from q),
s as (select key, min(id) as first from k group by key having min(id) <> max(id) or (bool_or(id is null) and min(id) is not null)),
f as (select rid, place, bool_or(id is distinct from first) as dropped from k join s using (key) group by rid, place),
m as (select rid, count(*) as n, coalesce(list(place) filter (dropped), []) as places from f group by rid)
select d.id as doc_id, coalesce(len(lines), 0)::bigint as n_lines, coalesce(n, 0)::bigint as n_recurring,
    coalesce(len(places), 0)::bigint as n_dropped, case when coalesce(len(places), 0) = 0 then text else coalesce(array_to_string(
    list_transform(list_filter(range(len(lines)), lambda i: not list_contains(places, i)), lambda i: lines[i + 1]), chr(10)), '') end as text
from d left join m using (rid)
"""
