"""Mixing sources: targets, whole documents, the same again on a rerun, weights."""

from __future__ import annotations

from collections import Counter

import pytest
from plain import WORD, rows

from shelfmark.llm import mixing


def water(sizes: dict) -> dict:
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        if not open_:
            return full
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in open_}
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def test_targets_and_budgets(spark):
    made = [(i, "w " * (1 + i % 7), "abcde"[min(i % 9, 4)]) for i in range(900)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    source = {i: s for i, _, s in made}
    for r in got:
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"])
    targets = water(sizes)
    for r in got:
        assert r.target == pytest.approx(targets[source[r.doc_id]])
        assert r.source_size == sizes[source[r.doc_id]]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 3.5  # half the longest text
    assert sorted(mixing.mix(docs.repartition(2)).collect()) == sorted(got)


def test_the_mix_holds_what_the_numbers_say(docs):
    taken = {(r.doc_id, r["size"]): r.taken for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in mixed.collect())
    rows_of = Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows())
    for key, words in taken.items():
        if key[1]:
            assert got[key] * key[1] == words * rows_of[key]


def test_clean_texts_are_preferred(spark):
    made = [(i, "good words here" if i % 2 else "### %%% $$$", "a" if i < 2000 else "b") for i in range(2200)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    # the larger source gets less than its size, so it is sampled
    got = [r for r in mixing.mix(docs, source_col="source").collect() if r.doc_id < 2000]
    assert 0 < sum(r.taken for r in got if r.doc_id % 2 == 0) < sum(r.taken for r in got if r.doc_id % 2)


def test_hot_key_ties_and_nothing(spark, no_docs):
    same = spark.createDataFrame([(1, "a b c", None)] * 50, "doc_id long, text string, source string")
    assert {r.taken for r in mixing.mix(same).collect()} <= {3, 6}
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(empty).collect()] == [(0.0, 0)] * 2
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mixed(no_docs).count() == 0
