"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a target in words: its share by weight of a multiple of all words, at most ``cap``
times its own size. Complete epochs come first; the rest of a target is met by a weighted sample
without replacement: each document draws an exponential key, divided by its quality weight, and a
source takes documents in the order of their keys until their summed sizes reach the rest. The
document at the border is taken if more than half of it fits, so whole documents are taken.

Summing in the order of keys needs no task that holds a source: keys fall into about the square root
of a source's rows of buckets, the buckets are summed, and only the bucket at the border is sorted.
What a source takes then is a bound on its keys.

Defined results: a null text has size 0; rows without a source are a source of their own, last in
order. A source without words has target 0. Rows equal in id and text share a key and so one
decision. The key is a digest of id and text, so reruns agree. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import row_index
from ..session import cut
from .common import word_count

WEIGHTS = (5, 2, 1)
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column, size: Column) -> Column:
    """1 to 5: less with more signs of markup and noise for each word."""
    signs = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    share = F.least(F.lit(1.0), signs / F.greatest(size, F.lit(1)))
    return F.coalesce(1 + 4 * (1 - share), F.lit(1.0))


def sampling_key(doc_id: Column, text: Column, weight: Column) -> Column:
    """An exponential of mean 1 / weight, drawn from a digest of id and text."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    drawn = F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long")
    return -F.log((drawn + 1) / F.lit(float(2**48))) / weight


def slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Id, source, size and key of each document."""
    text = F.col(f"`{text_col}`")
    sized = docs.select(
        F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.col(f"`{source_col}`").cast("string").alias("source")
    ).withColumn("size", word_count(F.col("text")))
    key = sampling_key(F.col("id"), F.col("text"), quality_weight(F.col("text"), F.col("size")))
    return sized.select("id", "source", "size", key.alias("key"))


def targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2
) -> DataFrame:
    """Per source: ``source_size``, rows, ``target``, complete ``epochs`` and the ``rest`` to sample.

    ``share`` is the multiple of all words as a fraction. What a source cannot take goes to the others
    by weight until none is above its cap: all that is left at the same level per weight. The level
    rises from round to round, as more sources are full; a round is one sum over the sources.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = row_index(sums.withColumn("last", F.col("source").isNull()), ["last", "source"], "place")
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(F.col("place"), len(weights)).cast("int"))
    sources = cut(ranked.select("source", "source_size", "n", weight.alias("weight")))
    level, full = -1.0, None
    while True:
        over = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        found = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, F.col("source_size") * cap).otherwise(0)).alias("held"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(over.cast("int")).alias("full"),
        ).first()
        if not found["all"] or not found["open"] or found["full"] == full:
            break
        full = found["full"]
        level = (found["all"] * share[0] / share[1] - found["held"]) / found["open"]
    target = F.least((F.col("source_size") * cap).cast("double"), F.lit(level) * F.col("weight"))
    target = F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0))
    size = F.greatest(F.col("source_size"), F.lit(1))
    return sources.withColumn("target", target).select(
        "*",
        F.floor(F.col("target") / size).cast("long").alias("epochs"),
        (F.col("target") - F.floor(F.col("target") / size) * F.col("source_size")).alias("rest"),
    )


def bounds(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with ``bound``: the largest key that the sampled part of the source takes; null for none."""
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    split = F.greatest(F.lit(1), F.ceil(4 * F.sqrt(F.col("n"))))
    bucket = F.floor((1 - F.exp(-F.col("key"))) * split).cast("long")
    placed = sized.alias("d").join(
        sources.filter("rest > 0").select("source", "n", "rest").alias("s"), same
    ).select("d.source", "size", "key", "rest", bucket.alias("bucket"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("key").alias("top"), F.first("rest").alias("rest"))
    ahead = F.expr("sum(words) over (partition by source order by bucket) - words")
    sums = cut(sums.withColumn("ahead", ahead))
    # the bucket in which the rest is reached, and the top key of those before it
    border = sums.groupBy("source").agg(
        F.max(F.when(F.col("ahead") + F.col("words") <= F.col("rest"), F.col("top"))).alias("whole"),
        F.min(F.when(F.col("ahead") + F.col("words") > F.col("rest"), F.struct("bucket", "ahead"))).alias("cut"),
    ).select("source", "whole", "cut.bucket", "cut.ahead")
    border = cut(border)
    inside = placed.alias("p").join(
        border.filter("bucket is not null").alias("b"),
        F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bucket") == F.col("b.bucket")),
    ).groupBy("p.source", "key").agg(F.sum("size").alias("size"), F.first("ahead").alias("ahead"), F.first("rest").alias("rest"))
    before = F.expr("ahead + sum(size) over (partition by source order by key) - size")
    taken = inside.withColumn("before", before).filter(F.col("before") + F.col("size") / 2 <= F.col("rest"))
    part = taken.groupBy("source").agg(F.max("key").alias("part"))
    limit = border.alias("b").join(part.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")), "left").select(
        "b.source", F.greatest("whole", "part").alias("bound")
    )
    return cut(
        sources.alias("s").join(limit.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left").select("s.*", "bound")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: id, ``size``, its source's ``source_size`` and ``target``, and
    ``taken``, the words that the mix takes of it with repeats."""
    sized = cut(slim(docs, id_col, text_col, source_col))
    sources = bounds(sized, targets(sized))
    copies = F.col("epochs") + F.coalesce((F.col("key") <= F.col("bound")).cast("long"), F.lit(0))
    return sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its source takes it, with all its columns.

    Documents without words count as taken in complete epochs and, in the sample, by their key.
    """
    sized = cut(slim(docs, id_col, text_col, source_col))
    sources = bounds(sized, targets(sized)).select("source", "epochs", "bound")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(f"row.`{text_col}`")
    rows = docs.select(row).select(
        "row",
        F.col(f"row.`{source_col}`").cast("string").alias("source"),
        sampling_key(F.col(f"row.`{id_col}`"), text, quality_weight(text, word_count(text))).alias("key"),
    )
    copies = F.col("epochs") + F.coalesce((F.col("key") <= F.col("bound")).cast("long"), F.lit(0))
    joined = rows.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return (
        joined.select("row", copies.alias("copies"))
        .filter("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("row.*")
    )


ORACLE = """
with d as (select doc_id, text, source,
    cast(case when text is null then 0 else len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) end as bigint) as size from documents),
s as (select source, sum(size)::bigint as source_size,
    case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w
    from d group by source),
o as (select *, coalesce(sum(2 * source_size) over before, 0)::bigint as held,
    (sum(w) over (order by 2.0 * source_size / w, source rows between current row and unbounded following))::bigint as open,
    (select sum(source_size) from s)::bigint as everything
    from s window before as (order by 2.0 * source_size / w, source rows between unbounded preceding and 1 preceding)),
l as (select max((everything * 1.5::double - held) / open) as level from o
    where (everything * 1.5::double - held) / open < 2.0::double * source_size / w),
t as (select source, source_size, case when source_size = 0 then 0.0::double
    else least(2.0::double * source_size, (select coalesce(level, 1e300::double) from l) * w) end as target from s),
e as (select *, floor(target / greatest(source_size, 1))::bigint as epochs,
    target - floor(target / greatest(source_size, 1)) * source_size as rest from t),
k as (select d.*, e.source_size, e.target, e.epochs, e.rest,
    -ln((('0x' || md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')))[1:12])::bigint + 1) / 281474976710656::double)
    / coalesce(1 + 4 * (1 - least(1.0::double, (length(text) - length(translate(text, '#*$%&|<>', '')))::double / greatest(size, 1))), 1.0) as key
    from d join e on d.source is not distinct from e.source),
g as (select source, key, sum(size) as words, sum(sum(size)) over (partition by source order by key) as upto, any_value(rest) as rest
    from k group by source, key),
b as (select source, max(key) as bound from g where rest > 0 and upto - words + words / 2.0::double <= rest group by source)
select doc_id, size, source_size, target,
    (size * (epochs + case when key <= bound then 1 else 0 end))::bigint as taken
from k left join b on k.source is not distinct from b.source
"""
