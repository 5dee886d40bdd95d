"""License scans by an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text, as sets of words, and runs of successive words as long as the template,
so that a notice wrapped over several lines is found too. For lines, tokens are ordered by the number of blocks of the
corpus that hold them, rare ones first. A block that holds at least ``ceil(t * n)`` of a template's ``n``
words must hold one of the template's first ``n - ceil(t * n) + 1`` words in that order (prefix filter),
must hold enough template words at all (length filter), and from the place where the two first meet
enough must be left in both (positional filter). What passes is counted exactly. No pair that meets
the threshold is lost, and few others are looked at. Runs are looked at in texts that hold enough of a
template's words at all, from each of its words on.

Beside the templates, phrases are looked for anywhere in the text, also across lines.

The templates are a parameter; only their words are counted, so what the driver gets is bounded by
them. Texts are read once and never move: what stays of a text is its counts, the template words
of its lines, and labels and scores of the runs.

Defined results: null counts as empty; a text without words has no labels, null places and score 0.
Repeated rows give repeated rows; ids may be null. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import lower_ascii

# The phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Words of well-known license notices.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.9  # below, one license's short notice would do for another's

# What is no part of a word, in lower-cased text.
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of constants."""
    made = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def wrapped(lines: Column, held: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """``label`` and ``score`` of every template and run of words, across the ends of ``lines``, whose
    containment meets the threshold: of each template the best. ``held`` has the template words of the text."""
    sets = [(label, sorted(set(t.split())), len(t.split())) for label, t in templates]
    known = F.array(
        *[F.struct(F.lit(label).alias("label"), strings(w).alias("words"), F.lit(n).alias("run")) for label, w, n in sets]
    )
    enough = F.filter(known, lambda t: F.size(F.array_intersect(t["words"], held)) / F.size(t["words"]) >= threshold)
    words = F.filter(F.flatten(lines), lambda w: w != "")

    def best(t: Column) -> Column:
        placed = F.transform(words, lambda w, at: F.struct(at.alias("at"), w.alias("word")))
        hits = F.filter(placed, lambda h: F.array_contains(t["words"], h["word"]))

        def score(hits: Column) -> Column:
            def share(h: Column, k: Column) -> Column:
                run = F.filter(F.slice(hits, k + 1, t["run"]), lambda x: x["at"] < h["at"] + t["run"])
                return F.size(F.array_distinct(run["word"])) / F.size(t["words"])

            return F.array_max(F.transform(hits, share))

        # an array of one, so that the hits are computed once and not for each of them
        return F.struct(t["label"].alias("label"), F.get(F.transform(F.array(hits), score), F.lit(0)).alias("score"))

    # a text of one line has no run that its line does not hold
    found = F.filter(F.transform(enough, best), lambda x: x["score"] >= threshold)
    return F.when((F.size(lines) > 1) & (F.size(enough) > 0), found)


def scanned(
    docs: DataFrame, templates: list[tuple[str, str]], phrases: dict[str, str], threshold: float, id_col: str, text: str
) -> DataFrame:
    """Per document: id, a number of its own, places of phrases, ``blocks``, for each line that holds
    any its words out of the templates, and ``runs``, what runs of words match."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), lower_ascii(F.col(f"`{text}`")).alias("text"))
    rows = rows.select("*", F.transform(F.split("text", "\n"), lambda x: F.split(x, f"[{GAP}]+")).alias("lines"))
    vocabulary_set = strings(vocabulary)
    held = F.filter(F.transform("lines", lambda x: F.array_intersect(x, vocabulary_set)), lambda x: F.size(x) > 0)
    # a line that starts or ends with a gap has an empty first or last piece
    n_words = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.size(F.filter(x, lambda w: w != "")))
    pattern = "|".join(p.replace(" ", f"[{GAP}]+") for p in phrases)
    pattern = f"(?<![^{GAP}])(?:{pattern})(?![^{GAP}])"
    rows = rows.select("id", "text", "lines", n_words.alias("n_words"), held.alias("blocks"), F.col("text").rlike(pattern).alias("any"))
    places = F.when(F.col("any"), F.regexp_extract_all("text", F.lit(f"({pattern})")))
    around = F.when(F.col("any"), F.split("text", pattern))
    rows = rows.select("id", "lines", F.array_distinct(F.flatten("blocks")).alias("held"), "n_words", "blocks", places.alias("places"), around.alias("around"))
    runs = wrapped(F.col("lines"), F.col("held"), templates, threshold) if templates else F.lit(None).cast("array<struct<label:string,score:double>>")
    rows = rows.select("id", "n_words", "blocks", "places", "around", runs.alias("runs"))
    words = rf"[^{GAP}]+"
    phrase_words = F.regexp_count(F.element_at("places", -1), F.lit(words))
    # phrases as written in the list: single spaces
    plain = F.transform("places", lambda x: F.regexp_replace(x, f"[{GAP}]+", " "))
    labels = F.filter(
        F.array(*[F.when(F.array_contains(plain, p), F.lit(label)) for p, label in phrases.items()]), lambda x: x.isNotNull()
    )
    return rows.select(
        F.monotonically_increasing_id().alias("rid"),
        "id",
        "n_words",
        "blocks",
        "runs",
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.regexp_count(F.get("around", F.lit(0)), F.lit(words)).cast("long").alias("first_word"),
        (F.col("n_words") - F.regexp_count(F.element_at("around", -1), F.lit(words)) - phrase_words).cast("long").alias("last_word"),
        F.coalesce(labels, F.array().cast("array<string>")).alias("base"),
    )


def matched(blocks: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """For ``rid`` and ``words`` (the template words of a block): ``rid``, ``label``, ``score`` of every block
    and template whose containment meets the threshold."""
    found = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    often = {r.word: r.n for r in found}  # as many as the templates have words
    order = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (often.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    prefixes, sets = [], []
    for number, (label, text) in enumerate(templates):
        words = sorted(set(text.split()), key=rank.__getitem__)
        need = next(k for k in range(len(words) + 1) if k / len(words) >= threshold)
        sets.append((number, label, words, need))
        prefixes += [(w, number, place, need, len(words)) for place, w in enumerate(words[: len(words) - need + 1])]
    spark = blocks.sparkSession
    index = literal_rows(spark, prefixes, ["word", "template", "place", "need", "size"])
    known = literal_rows(spark, sets, ["template", "label", "of_template", "least"])
    first_of = F.slice("of_template", 1, F.size("of_template") - F.col("least") + 1)
    sorted_blocks = blocks.select("rid", F.array_intersect(strings(order), "words").alias("words"))
    shortest = min((s[3] for s in sets), default=0)
    probes = sorted_blocks.filter(F.size("words") >= shortest).select("rid", "words", F.posexplode("words").alias("at", "word"))
    # both sides below are as large as the templates
    met = (
        probes.join(F.broadcast(index), "word")
        .filter(F.size("words") >= F.col("need"))
        .filter(F.least(F.col("size") - F.col("place"), F.size("words") - F.col("at")) >= F.col("need"))
        .join(F.broadcast(known), "template")
        # a pair may meet in several words of the prefix; it is counted where it meets first
        .filter(F.col("word") == F.get(F.array_intersect(first_of, F.col("words")), F.lit(0)))
    )
    score = F.size(F.array_intersect("of_template", "words")) / F.col("size")
    return met.select("rid", "label", score.alias("score")).filter(F.col("score") >= threshold)


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row for each document: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels`` and ``score``, the largest containment (1 where a phrase stands)."""
    rows = cut(scanned(docs, templates, phrases, threshold, id_col, text))
    found = matched(rows.select("rid", F.explode("blocks").alias("words")), templates, threshold)
    found = found.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", none), F.coalesce("runs.label", none))))
    return rows.join(found, "rid", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.greatest("best", F.array_max("runs.score")), F.lit(0.0))).alias("score"),
    )


def oracle(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> str:
    """The same rows by comparing every line with every template; for texts without wrapped notices."""
    known = ", ".join(f"('{label}', ['{"', '".join(sorted(set(t.split())))}'])" for label, t in templates)
    rows = ", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in phrases.items())
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = f"[^{GAP}]+"
    return f"""
with t(label, words) as (values {known}),
p(label, words) as (values {rows}),
d as (select row_number() over () as rid, doc_id, {low} as text from documents),
w as (select rid, doc_id, regexp_extract_all(text, '{word}') as words from d),
x as (select rid, list_distinct(regexp_extract_all(unnest(string_split(text, chr(10))), '{word}')) as words from d),
m as (select rid, label, len(list_intersect(t.words, x.words)) / len(t.words) as score from x, t where score >= {threshold}),
b as (select rid, label, unnest(list_filter(range(len(w.words)), lambda k: w.words[k + 1 : k + len(p.words)] = p.words)) as place from w, p),
bs as (select rid, count(*) as n_base, min(place) as first_word, max(place) as last_word, list_distinct(list(label)) as base from b group by rid),
ms as (select rid, list_distinct(list(label)) as found, max(score) as best from m group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
    array_to_string(list_sort(coalesce(base, [])), ',') as base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') as labels,
    case when n_base > 0 then 1.0::double else coalesce(best, 0)::double end as score
from w left join bs using (rid) left join ms using (rid)
"""
