"""SimHash near-duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from plain import simhash, smallest_reachable

from shelfmark.llm import simhash as S


def test_fingerprints_and_components(docs):
    rows = docs.collect()
    fps = [simhash(r.text) for r in rows]
    parts = smallest_reachable(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2, [r.doc_id for r in rows])
    want = sorted(((r.doc_id, f"{f:016x}", p) for r, f, p in zip(rows, fps, parts, strict=True)), key=str)
    assert sorted((tuple(r) for r in S.near_duplicates(docs).collect()), key=str) == want


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_planes(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [np.uint64(sum(1 << b for b in random.Random(k).sample(range(64), k % 8))) for k in range(60)]
    fps = np.unique(np.concatenate([base, base ^ np.array(flips, np.uint64), base[:1] ^ np.uint64(1 << 63)]))
    i, j = S.links(fps, radius)
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    n = len(fps)
    assert got == {(a, b) for a in range(n) for b in range(a + 1, n) if (int(fps[a]) ^ int(fps[b])).bit_count() <= radius}


@pytest.mark.parametrize("block", [S.BLOCK, 5])
def test_groups_of_many(spark, monkeypatch, block):
    """Chains of links, a crowd in one bucket, and buckets of more than one block."""
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "GATHER", 3)
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(150)]
    chain = [0]
    for b in range(20):
        chain.append(chain[-1] ^ (3 << 2 * b))
    crowd = [0xABCDEF0123456789 ^ (1 << b) for b in range(20)]
    every = list(dict.fromkeys(fps + chain + crowd))
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    slim = spark.createDataFrame([(k, f) for k, f in enumerate(signed)], "id long, fp long").repartition(3)
    got = {r.fp: r.component_id for r in S.groups(slim, "id").collect()}
    want = smallest_reachable(len(every), lambda i, j: (every[i] ^ every[j]).bit_count() <= 2, list(range(len(every))))
    assert got == dict(zip(signed, want, strict=True))


def test_one_of_each_group_stays(spark, docs, no_docs):
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    fps = [simhash(r.text) for r in rows]
    parts = smallest_reachable(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2, [r.doc_id for r in rows])
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({p for p in parts if p is not None})
    assert S.keep_one(no_docs).count() == 0
    assert S.near_duplicates(no_docs).count() == 0


def test_the_stage_keeps_one_of_each_component(spark):
    """Copies, texts within two bits of each other, and chains of them; clean texts stay."""
    rng = random.Random(11)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(words)] * rng.choice([1, 1, 3])
        for _ in range(4):
            words[rng.randrange(400)] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    fps = [simhash(t) for t in texts]
    want = set(smallest_reachable(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2, list(range(len(texts)))))
    assert len(want) < len(texts) - 30
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in S.keep_one(rows).collect()} == want
    assert {r.component_id for r in S.near_duplicates(rows).collect()} == want
