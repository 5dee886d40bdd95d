"""Exact dedup against a dictionary of texts, and the shape of its tree."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
from plain import SCHEMA, rows, sha
from pyspark.sql import functions as F

from shelfmark.llm import exact


def plain(made):
    """Result rows but for which of several rows equal in id and text stays."""
    groups = defaultdict(list)
    for r in made:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for r in made:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        known = [i for i in groups[text] if i is not None]
        out.append((r[0], min(known) if known else None, len(groups[text]), sha(text)))
    return out


def check(got, made):
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=str) == sorted(plain(made), key=str)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_all_cases(spark, docs):
    got = exact.dedup(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    check(got.collect(), rows())


@pytest.mark.parametrize(("parts", "fan"), [(1, 16), (9, 2), (40, 3), (40, 16)])
def test_runs_and_fans(spark, parts, fan):
    texts = ["hot  text" if i % 3 == 0 else f"t{i % 70}\t{i % 2 * ' '}x" for i in range(600)]
    made = [((i * 7919) % 600, t, "en", "s", "x", i) for i, t in enumerate(texts)]
    made += [(None, "hot text", None, None, None, None), (None, "alone", None, None, None, None), made[1], made[1]]
    frame = spark.createDataFrame(made, SCHEMA).repartition(parts)
    check(exact.dedup(frame, fan=fan).collect(), made)


def test_white_space_and_bytes(spark):
    made = [(i, t) for i, t in enumerate(["a b", "a\tb", "a \r\n b", "a\x0bb", " a b", "ab", "a b", "a\x1cb", "", None, " ", "\n\n"])]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    check(exact.dedup(frame).collect(), made)
    # bytes that are no UTF-8 stay apart
    broken = spark.range(4).select(F.col("id").alias("doc_id"), F.expr("cast(unhex(array('FF2020', 'FE20', 'FF09', 'FF20')[int(id)]) as string)").alias("text"))
    got = {r.doc_id: r.keep_id for r in exact.dedup(broken).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0}


def test_rows_that_stay(spark, docs, no_docs):
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert sorted(normal) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows()})
    assert exact.dedup(no_docs).count() == 0
    assert exact.keep_one(no_docs).count() == 0


def test_few_entries_of_a_hot_text_meet(spark):
    """No more entries of a text meet in a round than runs that are merged."""
    frame = spark.range(0, 64, 1, 64).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    rounds = exact.tree(exact.digests(frame, "doc_id", "text"), fan=4)
    assert [r.count() for r in rounds] == [64, 16, 4, 1]
    assert rounds[-1].first()["size"] == 64


def test_no_python_and_texts_do_not_move(spark, docs):
    rows_ = exact.digests(docs, "doc_id", "text")
    plan = exact.merged(rows_.select("run", *exact.TEXT, F.struct("id", "rid").alias("keep"), F.lit(1).alias("size")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "text" not in [c for c in rows_.columns]
