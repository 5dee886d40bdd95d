"""Embedding near-duplicates against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from plain import smallest_reachable

from shelfmark.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node string, cells int"


def vectors(n=260, size=8):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(n, size))
    near = base + 0.12 * rng.normal(size=(n, size)) * np.linalg.norm(base, axis=1, keepdims=True) / math.sqrt(size)
    rows = [(k, [float(x) for x in np.float32(v)], k % 2) for k, v in enumerate(np.concatenate([base, near]))]
    rows += [(1000 + k, [2 * x for x in rows[k][1]], rows[k][2]) for k in range(5)]  # the same direction
    rows += [(k, rows[k][1], rows[k][2]) for k in range(3)]  # repeated rows
    rows += [(2000 + k, rows[7][1], rows[7][2]) for k in range(40)]  # copies
    rows += [(3000, None, 1), (3001, [0.0] * size, 1), (3002, [float("nan")] * size, 1), (3003, [None] + [1.0] * 7, 1)]
    rows += [(3004, rows[3][1], None), (3005, [1.0, 2.0], 1), (3006, [1.0, 2.0], 1), (3007, [], 1), (None, rows[4][1], 0)]
    rows += [(3008, [float("inf")] + [1.0] * 7, 1), (3009, [1e30] * size, 0), (3010, [1e-30] * size, 0)]
    return [(*r, "x", 0) for r in rows]


def plain(rows, threshold=0.98):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(np.float32(v), float)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(r[1]) if r[2] is not None else None for r in rows]

    def linked(i, j):
        a, b = units[i], units[j]
        return a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold

    counts = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    parts = smallest_reachable(len(rows), linked, [r[0] for r in rows])
    return sorted(((r[0], n, c, r[0] == c) for r, n, c in zip(rows, counts, parts, strict=True)), key=str)


@pytest.mark.parametrize(("per_cell", "block"), [(4096, 1024), (12, 7)])
def test_all_pairs(spark, monkeypatch, per_cell, block):
    monkeypatch.setattr(embeddings, "PER_CELL", per_cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors()
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = plain(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(r[1] for r in want) > 300


def test_nothing(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_vectors_reach_numpy_without_python_numbers():
    held = pa.chunked_array([pa.array([[9.0, 9.0], [1.0, 2.0]], pa.list_(pa.float32())).slice(1), pa.array([[3.0, 4.0]], pa.list_(pa.float32()))])
    assert embeddings.matrix(held).tolist() == [[1, 2], [3, 4]]
