"""Exact dedup: partitions make sorted runs of digests, which a tree of merges brings together.

A partition's run holds each of its texts once: digest, length and a second checksum of the normalised
text, the smallest identifier, and how many rows have it. In each round ``FAN`` neighbouring runs become
one. A run is dealt out by digest, so no task holds a whole one: what several runs have of a stretch of
digests meets in a task, is sorted there and merged in one pass. Entries become one only if digest,
length and checksum agree, so an identifier is never kept for a text of another length or checksum.
A text of which there are many copies sends one entry from each run, at most ``FAN`` to a task.

Then the decisions go down the same tree: an entry of a round asks the run that it went into, so here
too at most ``FAN`` entries, and at the bottom one partition's rows, meet on a key. Only texts that
stand more than once are asked for. Texts are read once and never move. Column functions only.

Defined results: null counts as empty. Of rows equal in text, the smallest id stays, null after all
others; of rows equal in id too, exactly one stays, the first in the order in which they were read.
Normalising works on bytes, so texts that are no UTF-8 compare by their bytes. An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

FAN = 16  # runs that are merged into one
# Runs of white space that are not a single space already; all of them become one.
BLANK = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
TEXT = ["digest", "bytes", "check"]


def normalised(text: Column) -> Column:
    """The bytes of a text, each run of ASCII white space as one space; null becomes empty."""
    whole = F.coalesce(text, F.lit(""))
    # one character for each byte, where the bytes are no UTF-8
    as_bytes = F.encode(F.regexp_replace(F.decode(whole.cast("binary"), "ISO-8859-1"), BLANK, " "), "ISO-8859-1")
    return F.when(F.is_valid_utf8(whole), F.regexp_replace(whole, BLANK, " ").cast("binary")).otherwise(as_bytes)


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, a number of its own, the partition (``run``) that it was read in, and its text's marks."""
    text = normalised(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    return rows.select(
        "id",
        F.monotonically_increasing_id().alias("rid"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.xxhash64("text").alias("check"),
    )


def merged(entries: DataFrame) -> DataFrame:
    """Entries of equal runs and texts as one: each task sorts its stretch of digests and passes over it once."""
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(parts, "run", "digest").sortWithinPartitions("run", *TEXT)
    return dealt.groupBy("run", *TEXT).agg(F.min("keep").alias("keep"), F.sum("size").alias("size"))


def tree(rows: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The runs of each round, from those of the partitions to the single last one."""
    first = rows.select("run", *TEXT, F.struct(F.col("id").isNull().alias("last"), "id", "rid").alias("keep"))
    # what a partition has of one text becomes one entry before anything moves
    own = first.groupBy("run", *TEXT).agg(F.min("keep").alias("keep"), F.count(F.lit(1)).alias("size"))
    rounds = [cut(own)]
    most = rows.agg(F.max("run")).first()[0] or 0
    while most > 0:
        most //= fan
        rounds.append(cut(merged(rounds[-1].withColumn("run", F.floor(F.col("run") / fan).cast("int")))))
    return rounds


def decided(rounds: list[DataFrame], fan: int = FAN) -> DataFrame:
    """For texts of several rows: what all rows together keep (``best``, ``total``), per run of the first round."""
    top = rounds[-1].filter("size > 1").select("run", *TEXT, F.col("keep").alias("best"), F.col("size").alias("total"))
    for lower in reversed(rounds[:-1]):
        asked = lower.select(F.floor(F.col("run") / fan).cast("int").alias("run"), *TEXT, F.col("run").alias("child"))
        found = asked.join(top, ["run", *TEXT]).select(F.col("child").alias("run"), *TEXT, "best", "total")
        top = cut(found)
    return top


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """One row for each row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    rows = cut(digests(docs, id_col, text_col))
    known = decided(tree(rows, fan), fan)
    alone = F.col("total").isNull()
    return rows.join(known, ["run", *TEXT], "left").select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("total", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.rid") == F.col("rid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each text."""
    name, least = (F.col(f"`{c}`") for c in (id_col, text_col))
    text = normalised(least)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keys = F.struct(F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("check"))
    wide = docs.select(F.struct(*columns).alias("row"), keys.alias("key"), name.alias("id"))
    held = cut(wide.withColumn("rid", F.monotonically_increasing_id()))
    rows = held.select("id", "rid", (F.col("rid") / (1 << 33)).cast("int").alias("run"), F.unhex("key.digest").alias("digest"), F.col("key.bytes").cast("long").alias("bytes"), F.col("key.check").alias("check"))
    kept = tree(rows)[-1].select(F.col("keep.rid").alias("rid"))
    return held.join(kept, "rid", "left_semi").select("row.*")


ORACLE = """
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
    row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
from d
"""
