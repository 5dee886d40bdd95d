"""Toxicity: the machine on clauses, and held-out accuracy."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import toxicity as T
from shelfmark.plans.registry import table

SF = "/root/testdata/sf0.1"


def outputs(*symbols):
    machine, state, out = T.compose(T.MACHINES), (0,) * len(T.MACHINES), []
    for s in symbols:
        state, o = machine[state][s]
        out.append(o)
    return out


@pytest.mark.parametrize(
    ("symbols", "last"),
    [
        (["insult"], "insult"),
        (["target", "other", "insult"], "aimed insult"),
        (["target", *["other"] * 5, "insult"], "insult"),
        (["deny", "other", "insult"], "denied insult"),
        (["deny", "other", "other", "other", "insult"], "insult"),
        (["report", *["other"] * 9, "insult"], "reported insult"),
        (["insult", "insult"], "chained insult"),
        (["target", "threat"], "aimed threat"),
        (["threat"], "other"),
        (["target", "deny", "threat"], "denied threat"),
    ],
)
def test_machine(symbols, last):
    assert outputs(*symbols)[-1] == last


def test_the_composed_machine_does_what_the_four_do_in_turn():
    rng = random.Random(6)
    for _ in range(500):
        symbols = rng.choices(T.INPUTS, weights=(3, 2, 2, 2, 1, 4), k=rng.randint(0, 30))
        stream = symbols
        for machine in T.MACHINES:
            state, out = 0, []
            for symbol in stream:
                state, symbol = machine(state, symbol)
                out.append(symbol)
            stream = out
        assert outputs(*symbols) == stream


@pytest.mark.parametrize("text", ["sie die Mutter", "ich sage dir du die Frau und ihr die Kinder", "tu vas à la plage, elle aussi"])
def test_articles_are_no_threats(text):
    reader = T.Reader({"idiot": 3.0})
    assert reader.features(text) == reader.features("")
    assert reader.features("ich werde dich töten") != reader.features("")


def test_equal_texts_count_once_and_footers_do_not_join_texts(spark):
    footer = "this long line stands at the end of all the texts of one source, whatever they say"
    rows = [(i, f"text {i // 2}\n{footer}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    got = T.sample(docs, labels).collect()
    free = {r.doc_id for r in docs.filter(~T.held_out(F.col("doc_id"))).collect()}
    want = {(f"text {i // 2}\n{footer}", int(i % 4 == 0)) for i in free}
    assert sorted((r.text, r.toxic) for r in got) == sorted(want)


def test_bytes_that_are_no_text_are_scored(spark):
    docs = spark.createDataFrame([(1, bytearray(b"\xff you \xc3"))], "doc_id long, b binary")
    docs = docs.select("doc_id", F.col("b").cast("string").alias("text"))
    model = T.Model({"idiot": 3.0}, [0.0] * (len(T.OUTPUTS) + 2))
    assert [r.s for r in docs.select(T.score(F.col("text"), model).alias("s")).collect()] == [0.5]


def test_clauses_are_scored_apart():
    reader = T.Reader({"idiot": 3.0, "mor*": 2.0})
    plain = reader.features("an idiot")
    assert reader.features("never. an idiot") == plain
    assert reader.features("not an idiot") != plain
    assert reader.weight("mor") == 0.0
    assert reader.features("") == reader.features("nothing") == [0.0] * (len(T.OUTPUTS) + 1)


def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels")
    got = T.predictions(table(spark, SF, "documents"), labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 500
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.99
    toxic = [r.predicted for r in rows if r.toxic]
    assert sum(toxic) / len(toxic) > 0.9  # some labelled ones hold no insult at all
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_rows_are_not_learned_from(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.learn(docs, flipped) == T.learn(docs, labels)


def test_cases(spark, docs, no_docs):
    labels = table(spark, SF, "labels")
    model = T.learn(table(spark, SF, "documents"), labels)
    scored = docs.select("doc_id", "text", T.score(F.col("text"), model).alias("s")).collect()
    assert len({r.s for r in scored if not r.text}) == 1
    assert all(0 <= r.s < 0.5 for r in scored)
    one_kind = labels.filter("toxic = 0")
    assert {r.score for r in T.predictions(docs, one_kind).collect()} == {0.0}
    assert T.predictions(no_docs, labels).count() == 0
    assert T.predictions(docs, labels.limit(0)).count() == docs.count()
    kept = T.reject(docs, labels)
    assert kept.columns == docs.columns
    nothing = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    assert T.predictions(docs, labels.limit(0).unionByName(nothing)).count() == docs.count()
