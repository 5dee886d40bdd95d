"""Secret scans: patterns of known secrets, and tokens that a battery of randomness tests finds.

Tokens are runs of at least ``LEAST`` characters of encodings. Of each, the encoding is inferred, and the
battery is made against its alphabet: chi-squared of the counts of its characters against uniformity, the
runs above and below the middle of the alphabet, and the serial correlation of neighbours.

Chi-squared decides in two ways. What is no secret, words or numbers written in the encoding, repeats its
characters more often than uniform ones, which makes the value larger, the more clearly the longer the
token: the p-value of a token is how often such writing of its length gives as small a value. Each encoding
has its own null model, the chance that two or three of its characters are the same: decimal numbers for
the two hexadecimal ones, whose letters alone make no words, and text for the others. The value's repeated
part is a sum of positive parts, so it is taken as gamma distributed (by its cube root). The three tests
together then ask whether the token is uniform and random: the smallest of their p-values, corrected for
being the smallest of three, divides the p-value; below ``RATE`` the token fails the battery and is no find
however little it looks like text.

Over all tokens of the corpus the false discovery rate is held at ``RATE`` (Benjamini and Hochberg), with
p-values weighted by length.

Everything is column functions. Texts are read once and do not move; what is found keeps its place by
summing the lengths of what stands before it. The rate needs the number of tokens by steps of their
p-value, at most ``STEPS`` numbers.

Defined results: null counts as empty. Places count code points. Spans are sorted by start, then kind as
listed, a find last; a find that overlaps a pattern's span is left out. Repeated rows give repeated
rows; ids may be null. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

KINDS = ("assign", "access", "hex", "random")


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of the contract. A character that may not stand before a run only saves
# looking at the run again.
NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{either_case('api')}_?{either_case('key')}"
ASSIGN = rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}",
}
SECRET = 12  # characters of the value of an assignment
LEAST = 20  # characters of a token
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"

UPPER, LOWER, DIGIT = string.ascii_uppercase, string.ascii_lowercase, string.digits
# Encodings in the order in which they are inferred: what they are made of, and their alphabets.
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", DIGIT + "abcdef"),
    "hex_upper": ("^[0-9A-F]+$", DIGIT + "ABCDEF"),
    "letters_lower": ("^[a-z]+$", LOWER),
    "letters_upper": ("^[A-Z]+$", UPPER),
    "base32": ("^[A-Z2-7]+$", UPPER + "234567"),
    "base62": ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGIT),
    "base64": ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGIT + "+/"),
    "base64url": ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGIT + "-_"),
    "mixed": (".", UPPER + LOWER + DIGIT + "+/-_"),
}
# The chance that two, or three, characters are the same. Text as English has it; decimals.
TEXT_ALIKE, NUMBER_ALIKE = (0.065, 0.0055), (0.1, 0.01)
NUMBERS = ("hex", "hex_upper")  # encodings in which numbers, not words, are what is no secret
RATE = 0.01
STEP, STEPS = 20, 2000  # steps of a unit of -log p, and their number


def places(text: Column, pattern: str) -> tuple[Column, Column]:
    """Lengths of what stands before each match, and the matches; null without a match."""
    any_ = text.rlike(pattern)
    before = F.when(any_, F.transform(F.split(text, pattern), lambda x: F.length(x)))
    return before, F.when(any_, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))


def found(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Per document: id, a number of its own, and for each kind its matches as structs."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    columns = []
    for kind, pattern in {**PATTERNS, "random": TOKEN}.items():
        before, matches = places(F.col("text"), pattern)
        value = F.when(F.col("text").rlike(pattern), F.regexp_extract_all("text", F.lit(pattern), F.lit(1))) if kind == "assign" else matches
        columns += [before.alias(f"before_{kind}"), matches.alias(f"match_{kind}"), value.alias(f"value_{kind}")]
    rows = rows.select("id", *columns)
    shortest = {"assign": SECRET, "access": 18}
    kept = []
    for kind in KINDS:
        match, value = F.col(f"match_{kind}"), F.col(f"value_{kind}")
        least = F.lit(shortest.get(kind, 0))
        good = F.transform(value, lambda v: F.length(v) >= least)  # noqa: B023 - used at once
        token = value if kind == "random" else F.transform(value, lambda _: F.lit(None).cast("string"))
        before = F.slice(f"before_{kind}", 1, F.size(match))
        zipped = F.arrays_zip(
            before.alias("before"), F.transform(match, F.length).alias("length"), good.alias("good"), token.alias("token")
        )
        kept.append(zipped.alias(kind))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "id", *kept)


def spans(rows: DataFrame) -> DataFrame:
    """Matches with their places: ``rid``, ``kind``, ``start``, ``end``, ``token``; failing ones are gone."""
    by_kind = [
        rows.select("rid", F.lit(n).alias("kind"), F.posexplode(kind).alias("pos", "m")).select("rid", "kind", "pos", "m.*")
        for n, kind in enumerate(KINDS)
    ]
    every = by_kind[0]
    for more in by_kind[1:]:
        every = every.unionByName(more)
    upto = F.expr("sum(before + length) over (partition by rid, kind order by pos)")
    placed = every.withColumn("end", upto).withColumn("start", F.col("end") - F.col("length"))
    return placed.filter("good").select("rid", "kind", "start", "end", "token")


def tested(tokens: DataFrame) -> DataFrame:
    """Columns of ``tokens`` and, of ``token``: its ``n`` characters, the size ``k`` of its alphabet, ``chi_squared``;
    in standard deviations, ``unlike``, by which it is smaller than other writing gives, and the three tests of
    uniform randomness, ``uneven``, ``runs`` and ``serial``."""
    core = F.regexp_replace("token", "=+$", "")
    alphabet, size, two, three = F.lit(""), F.lit(0), F.lit(0.0), F.lit(0.0)
    for name, (pattern, letters) in reversed(ENCODINGS.items()):
        fits, alike = core.rlike(pattern), NUMBER_ALIKE if name in NUMBERS else TEXT_ALIKE
        alphabet, size = F.when(fits, F.lit(letters)).otherwise(alphabet), F.when(fits, F.lit(len(letters))).otherwise(size)
        two, three = F.when(fits, F.lit(alike[0])).otherwise(two), F.when(fits, F.lit(alike[1])).otherwise(three)
    columns = tokens.columns
    model = [size.cast("double").alias("k"), two.alias("two"), three.alias("three")]
    rows = tokens.select("*", core.alias("core"), alphabet.alias("alphabet"), *model)
    kept = [*columns, "k", "two", "three", "n"]
    rows = rows.select(
        *columns,
        "k",
        "two",
        "three",
        F.length("core").cast("double").alias("n"),
        F.col("core"),
        "alphabet",
        F.transform(F.split("core", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double")).alias("values"),
    )
    # the sum of squared counts: each character of the alphabet taken out once
    squares = F.aggregate(
        F.split("alphabet", ""),
        F.lit(0.0),
        lambda total, c: total + F.pow(F.col("n") - F.length(F.replace(F.col("core"), c, F.lit(""))), F.lit(2.0)),
    )
    high = F.transform("values", lambda v: (v > F.col("k") / 2).cast("double"))
    nexts = F.slice("values", 2, F.greatest(F.size("values") - 1, F.lit(0)))
    mean = F.aggregate("values", F.lit(0.0), lambda a, v: a + v) / F.col("n")
    rows = rows.select(*kept, "values", nexts.alias("nexts"), squares.alias("squares"), high.alias("high"), mean.alias("mean"))
    above = F.aggregate("high", F.lit(0.0), lambda a, v: a + v)
    nexts_high = F.slice("high", 2, F.greatest(F.size("high") - 1, F.lit(0)))
    changes = F.aggregate(
        F.zip_with("high", nexts_high, lambda a, b: F.when(a != b, 1.0).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v
    )
    spread = F.aggregate("values", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    products = F.aggregate(
        F.zip_with("values", "nexts", lambda a, b: F.coalesce((a - F.col("mean")) * (b - F.col("mean")), F.lit(0.0))),
        F.lit(0.0),
        lambda a, v: a + v,
    )
    n, k, two, three = F.col("n"), F.col("k"), F.col("two"), F.col("three")
    chi_squared = F.greatest(k / n * F.col("squares") - n, F.lit(0.0))
    # of other writing: mean and variance of n / k times the repeated part of chi-squared, in pairs of equal characters
    pairs = n * (n - 1) * two
    variance = 4 * n * (n - 1) * (n - 2) * (three - two * two) + 2 * n * (n - 1) * (two - two * two)
    rows = rows.select(
        *kept,
        chi_squared.alias("chi_squared"),
        pairs.alias("pairs"),
        (pairs * pairs / variance).alias("shape"),
        above.alias("above"),
        changes.alias("changes"),
        spread.alias("spread"),
        products.alias("products"),
    )
    expected = 1 + 2 * F.col("above") * (n - F.col("above")) / n
    variance = (expected - 1) * (expected - 2) / (n - 1)
    repeated = F.greatest((F.col("chi_squared") + n - k) * n / k, F.lit(0.0))
    third, ninth, free = F.lit(1 / 3), 9 * F.col("shape"), 9 * (k - 1) / 2
    return rows.select(
        *columns,
        "k",
        "n",
        "chi_squared",
        ((1 - 1 / ninth - F.pow(repeated / F.col("pairs"), third)) * F.sqrt(ninth)).alias("unlike"),
        ((F.pow(F.col("chi_squared") / (k - 1), third) - 1 + 1 / free) * F.sqrt(free)).alias("uneven"),
        F.when(variance > 0, (1 + F.col("changes") - expected) / F.sqrt(variance)).otherwise(F.lit(1e9)).alias("runs"),
        F.when(F.col("spread") > 0, (F.col("products") / F.col("spread") + 1 / n) * F.sqrt(n)).otherwise(F.lit(1e9)).alias("serial"),
    )


def passing(tokens: DataFrame, rate: float = RATE) -> DataFrame:
    """The finds among ``tokens`` at the false discovery rate ``rate``."""
    sums = tokens.agg(F.count(F.lit(1)).alias("m"), F.avg("n").alias("mean")).first()
    if not sums.m:
        return tokens
    # minus the logarithms of p-values: a tail beyond z standard deviations has at most exp(-z ** 2 / 2), one side half of it
    unlike = F.when(F.col("unlike") > 0, F.col("unlike") * F.col("unlike") / 2 + math.log(2)).otherwise(F.lit(0.0))
    worst = F.greatest(F.col("uneven"), F.abs("runs"), F.abs("serial"))
    battery = F.greatest(worst * worst / 2 - math.log(3), F.lit(0.0))
    step = F.least(F.floor((unlike - battery + F.log(F.col("n") / sums.mean)) * STEP), F.lit(STEPS))
    step = F.when(battery > -math.log(rate), F.lit(-1)).otherwise(F.greatest(step, F.lit(-1))).cast("int")
    steps = tokens.filter(step >= 0).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    limit, above = STEPS + 1, 0
    for at, n in sorted(((r.step, r.n) for r in steps), reverse=True):
        above += n
        if sums.m * math.exp(-at / STEP) <= rate * above:
            limit = at
    return tokens.filter(step >= limit)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``."""
    rows = cut(found(docs, id_col, text))
    placed = cut(spans(rows))
    random = KINDS.index("random")
    finds = passing(cut(tested(placed.filter(F.col("kind") == random)))).select("rid", "kind", "start", "end")
    every = placed.filter(F.col("kind") != random).select("rid", "kind", "start", "end").unionByName(finds)
    base = F.col("kind") != random
    # a find is left out where a pattern's span starts before its end and ends after its start
    earlier = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("rid").orderBy("start"))
    later = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("rid").orderBy(F.desc("start")))
    every = every.withColumns({"earlier": earlier, "later": later})
    free = (F.coalesce("earlier", F.lit(-1)) <= F.col("start")) & (F.coalesce("later", F.col("end")) >= F.col("end"))
    span = F.struct("start", "kind", "end")
    counts = [F.count(F.when(F.col("kind") == n, 1)).alias(f"n_{kind}") for n, kind in enumerate(KINDS[:random])]
    lists = every.filter(base | free).groupBy("rid").agg(*counts, F.sort_array(F.collect_list(span)).alias("all"))

    def joined(array: Column) -> Column:
        name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")

    whole = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    return rows.select("rid", "id").join(lists, "rid", "left").select(
        F.col("id").alias(id_col),
        *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS[:random]],
        F.sha2(joined(F.filter(whole, lambda s: s["kind"] != random)).cast("binary"), 256).alias("base_sha256"),
        joined(whole).alias("spans"),
    )


def oracle() -> str:
    """The same rows in DuckDB."""
    patterns = {**PATTERNS, "hex": PATTERNS["hex"].split(")", 1)[1], "random": TOKEN.split(")", 1)[1]}
    quoted = {kind: p.replace("'", "''") for kind, p in patterns.items()}
    value = {kind: 1 if kind == "assign" else 0 for kind in KINDS}
    matches = " union all ".join(
        f"select rid, {n} as kind, regexp_split_to_array(text, '{quoted[k]}') as before, regexp_extract_all(text, '{quoted[k]}', 0) as match, "
        f"regexp_extract_all(text, '{quoted[k]}', {value[k]}) as value from d"
        for n, k in enumerate(KINDS)
    )
    alphabet = " ".join(f"when regexp_matches(core, '{p}') then '{letters}'" for p, letters in ENCODINGS.values())
    first = f"case when {' or '.join(f'alphabet = {chr(39)}{ENCODINGS[e][1]}{chr(39)}' for e in NUMBERS)} then "
    two, three = (f"{first}{NUMBER_ALIKE[x]}::double else {TEXT_ALIKE[x]}::double end" for x in (0, 1))
    names = ", ".join(f"'{k}'" for k in KINDS)
    counts = ", ".join(f"count(*) filter (kind = {n}) as n_{k}" for n, k in enumerate(KINDS[:-1]))
    columns = ", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in KINDS[:-1])
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
m as ({matches}),
u as (select rid, kind, unnest(range(len(match))) as pos, unnest(before[1:len(match)]) as b, unnest(match) as m, unnest(value) as v from m),
p as (select rid, kind, len(m) as size, v, sum(len(b) + len(m)) over (partition by rid, kind order by pos) as stop from u),
s as (select rid, kind, (stop - size)::bigint as start, stop::bigint as stop, v from p
    where not (kind = 0 and len(v) < {SECRET}) and not (kind = 1 and size < 18)),
t1 as (select rid, start, stop, regexp_replace(v, '=+$', '') as core from s where kind = 3),
t2 as (select *, len(core)::double as n, case {alphabet} end as alphabet from t1),
t3 as (select *, len(alphabet)::double as k, {two} as two, {three} as three,
    list_transform(string_split(core, ''), lambda c: strpos(alphabet, c)::double) as vs,
    list_sum(list_transform(string_split(alphabet, ''), lambda c: pow(n - len(replace(core, c, '')), 2))) as squares from t2),
t4 as (select *, list_sum(vs) / n as mean, list_transform(vs, lambda x: x > k / 2) as high,
    greatest(k / n * squares - n, 0) as chi, n * (n - 1) * two as pairs,
    4 * n * (n - 1) * (n - 2) * (three - two * two) + 2 * n * (n - 1) * (two - two * two) as var from t3),
t5 as (select *, list_sum(list_transform(high, lambda x: x::double)) as above,
    list_sum(list_transform(range(1, len(vs)), lambda i: (high[i] <> high[i + 1])::double)) as changes,
    list_sum(list_transform(vs, lambda x: (x - mean) * (x - mean))) as spread,
    list_sum(list_transform(range(1, len(vs)), lambda i: (vs[i] - mean) * (vs[i + 1] - mean))) as products,
    9 * (pairs * pairs / var) as ninth, 9 * (k - 1) / 2 as free from t4),
t6 as (select *, 1 + 2 * above * (n - above) / n as expected from t5),
t7 as (select *, (expected - 1) * (expected - 2) / (n - 1) as variance,
    (1 - 1 / ninth - pow(greatest((chi + n - k) * n / k, 0) / pairs, 1 / 3::double)) * sqrt(ninth) as unlike,
    (pow(chi / (k - 1), 1 / 3::double) - 1 + 1 / free) * sqrt(free) as uneven from t6),
t8 as (select rid, start, stop, n, case when unlike > 0 then unlike * unlike / 2 + ln(2.0::double) else 0.0::double end as found,
    greatest(uneven, abs(case when variance > 0 then (1 + changes - expected) / sqrt(variance) else 1e9 end),
    abs(case when spread > 0 then (products / spread + 1 / n) * sqrt(n) else 1e9 end)) as worst from t7),
t9 as (select *, greatest(least(floor((found - greatest(worst * worst / 2 - ln(3.0::double), 0) + ln(n / avg(n) over ())) * {STEP}),
    {STEPS}), -1)::int as s0,
    worst * worst / 2 - ln(3.0::double) > -ln({RATE}::double) as failed, count(*) over () as m from t8),
t10 as (select *, case when failed then -1 else s0 end as step from t9),
h as (select step, m, sum(count(*)) over (order by step desc) as above from t10 where step >= 0 group by step, m),
f as (select rid, 3 as kind, start, stop from t10 where step >= (select coalesce(min(step), {STEPS + 1}) from h
    where m * exp(-step / {STEP}::double) <= {RATE}::double * above)),
e as (select rid, kind, start, stop from s where kind < 3 union all select * from f),
o as (select *, max(case when kind < 3 then stop end) over (partition by rid order by start) as earlier,
    min(case when kind < 3 then start end) over (partition by rid order by start desc) as later from e),
g as (select rid, kind, start, stop, [{names}][kind + 1] || ':' || start || ':' || stop as name from o
    where kind < 3 or (coalesce(earlier, -1) <= start and coalesce(later, stop) >= stop)),
l as (select rid, {counts}, string_agg(name, ',' order by start, kind, stop) filter (kind < 3) as base,
    string_agg(name, ',' order by start, kind, stop) as spans from g group by rid)
select doc_id, {columns}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join l using (rid)
"""
