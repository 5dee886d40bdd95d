"""Quality rules: statistics against plain Python, the estimate against its formulas, the verdict on labels."""

from __future__ import annotations

import random

import numpy as np
from plain import quality, repeated_words

from shelfmark.llm import quality as Q
from shelfmark.plans.registry import table


def test_statistics(docs):
    got = {(r.doc_id, r.n_words, r.word_chars): tuple(r)[1:7] for r in Q.judge(docs).collect()}
    for r in docs.collect():
        want = quality(r.text)
        assert got[(r.doc_id, want[0], want[1])] == want


def test_repeated_words():
    random.seed(3)
    for _ in range(300):
        words = [random.choice("ab") for _ in range(random.randint(0, 40))]
        assert Q.repeated_words(Q.numbered([w.encode() for w in words])) == repeated_words(words)


def test_estimate_finds_how_far_rules_are_right():
    """Two ways to be bad, of which five rules see one or the other; a sixth votes at random."""
    rng = np.random.default_rng(1)
    kind = rng.choice(3, 60_000, p=[0.8, 0.12, 0.08])
    chance = np.array([[0.02, 0.05, 0.01, 0.03, 0.02, 0.1], [0.95, 0.9, 0.02, 0.05, 0.02, 0.1], [0.02, 0.05, 0.9, 0.85, 0.95, 0.1]])
    votes = np.where(rng.random((60_000, 6)) < chance[kind], -1, 1)
    votes[rng.random((60_000, 6)) < 0.1] = 0
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = Q.estimate(patterns, counts.astype(float))
    assert abs(model.share[0] - 0.8) < 0.06
    wrong = model.vote[:, 0, 0] / (model.vote[:, 0, 0] + model.vote[:, 0, 2])
    assert abs(wrong[5] - 0.1) < 0.01  # no better than chance, as the data say
    assert wrong[:5].max() < 0.05
    kept = Q.classes(Q.as_seen(patterns), model)[place, 0] >= 0.5
    assert kept[kind == 0].mean() > 0.92
    assert kept[kind != 0].mean() < 0.05


def test_estimate_finds_how_often_a_rule_catches_its_own_kind():
    """A quarter of the bad texts escape their rule; that the second rule has nothing to say tells them."""
    rng = np.random.default_rng(2)
    n = 80_000
    bad = rng.random(n) < 0.2
    first = np.where(bad, np.where(rng.random(n) < 0.75, -1, 0), np.where(rng.random(n) < 0.01, 0, 1))
    second = np.where(bad, 0, np.where(rng.random(n) < 0.01, 0, 1))
    patterns, counts = np.unique(np.stack([first, second], axis=1), axis=0, return_counts=True)
    model = Q.estimate(patterns, counts.astype(float))
    assert abs(model.share[1] - 0.2) < 0.05
    assert abs(model.vote[0, 1, 0] - 0.75) < 0.05


def test_posterior_and_verdict_of_every_document(spark):
    """The whole result against a plain version: votes by hand, the model's formula for each document."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rules = list(Q.votes())
    rows = Q.measured(docs).withColumns(Q.votes()).collect()
    seen: dict[tuple, int] = {}
    for r in rows:
        key = tuple(r[x] for x in rules)
        seen[key] = seen.get(key, 0) + 1
    patterns = sorted(seen)
    model = Q.estimate(np.array(patterns), np.array([float(seen[p]) for p in patterns]))

    def posterior(key):
        likely = [model.share[c] * np.prod([model.vote[r, c, v + 1] for r, v in enumerate(key)]) for c in range(len(rules) + 1)]
        return likely[0] / sum(likely)

    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = posterior(tuple(r[x] for x in rules))
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert abs(got[r.id].posterior - want) < 1e-9
        assert (got[r.id].base_failed, got[r.id].kept) == (failed, not failed and want >= 0.5)


def test_bytes_that_are_no_text():
    assert Q.measure(b"\xff abc \xc3")[:2] == (3, 5)


def test_base_rules_hold_and_labels_agree(spark):
    sf = "/root/testdata/sf0.1"
    rows = Q.judge(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").collect()
    assert not any(r.kept for r in rows if r.base_failed)
    clean = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) / len(clean) > 0.97
    assert sum(junk) / len(junk) < 0.3


def test_nothing(no_docs):
    assert Q.judge(no_docs).count() == 0
