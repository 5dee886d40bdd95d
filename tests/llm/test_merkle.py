"""The manifest against a plain tree, its log against a plain postorder walk."""

from __future__ import annotations

import zlib

import pytest
from plain import lower, sha
from pyspark.sql import functions as F

from shelfmark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, log string, id int"


def leaf_of(r) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha("".join(last[k : k + 16])) for k in range(0, len(last), 16)])
    return out


def walk(tree: list[list[str]], level: int, i: int):
    """Nodes of a subtree, children first."""
    if level:
        for j in range(16 * i, min(16 * i + 16, len(tree[level - 1]))):
            yield from walk(tree, level - 1, j)
    yield level, i, tree[level][i]


def plain(rows):
    """Result rows, and the nodes of each tree in postorder."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = {}, {}
    for t, s in enumerate(sources):
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        members[t], trees[t] = mine, levels([leaf_of(r) for r in mine])
    top = levels([trees[t][-1][0] for t in range(len(sources))])
    out = []
    for t, mine in members.items():
        for i, r in enumerate(mine):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            shown = leaf_of((*r[:4], r[4] if r[4] is None else lower(r[4]))) if tampered else leaf_of(r)
            node, proof = shown, ""
            for tree, at in ((trees[t], i), (top, t)):
                for level in tree[:-1]:
                    run = level[at - at % 16 : at - at % 16 + 16]
                    left, right = "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
                    proof, node, at = proof + left + right, sha(left + node + right), at // 16
            out.append((r[0], leaf_of(r), trees[t][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    logs = {t: list(walk(tree, len(tree) - 1, 0)) for t, tree in {**trees, merkle.TOP: top}.items()}
    return out, logs


def made(sizes: dict):
    rows = []
    for s, n in sizes.items():
        for k in range(n):
            i = len(rows)
            text = [None, "", "plain", f"Text {i}", "Ünï ÀB\n" * 3][i % 5]
            rows.append((i, s, "en" if k % 3 else None, None if k % 7 == 3 else len(text or ""), text, 0, "x", 1))
    return rows


def run(spark, rows, parts=4):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, None: 3, "": 1, "B": 16}, {f"s{k}": 1 + k % 3 for k in range(40)}, {"a": 700, "b": 256, "c": 257}])
def test_against_a_plain_tree(spark, sizes):
    rows = made(sizes)
    got = merkle.verify(run(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want, _ = plain(rows)
    found = sorted(tuple(r) for r in got.collect())
    assert found == sorted(want)
    if len(rows) > 30:
        assert {r[-1] for r in found} == {True, False}


def test_several_rounds_of_builders(spark):
    """Small builders, so that paths come down through several rounds."""
    rows = made({"a": 5000, "b": 20, "c": 256, "d": 4})
    found = merkle.manifest(run(spark, rows), depth=1)
    assert len(found.forest.rounds) == 4
    want, logs = plain(rows)
    assert sorted(tuple(r) for r in merkle.proofs(found).collect()) == sorted(want)
    check_log(found, logs)


def check_log(found, logs):
    got = {}
    for r in found.log().orderBy("tree", "position").collect():
        got.setdefault(r.tree, []).append((r.position, r.level, r.i, r.node))
    assert {t: [x[1:] for x in nodes] for t, nodes in got.items()} == logs
    assert all([x[0] for x in nodes] == list(range(len(nodes))) for nodes in got.values())


def test_log_is_in_postorder(spark):
    rows = made({"a": 300, None: 2, "b": 33})
    check_log(merkle.manifest(run(spark, rows)), plain(rows)[1])


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4096, 4097, 5000])
def test_positions(n):
    tree = levels([str(k) for k in range(n)])
    assert [merkle.position(n, level, i) for level, i, _ in walk(tree, len(tree) - 1, 0)] == list(range(sum(map(len, tree))))


def test_nulls_ties_and_long_texts(spark):
    rows = [(None, "a", None, None, None, 0, "", 0), (None, "a", "en", 1, "A", 0, "", 0), (None, None, None, None, None, 0, "", 0)]
    rows += [(5, "a", "en", 1, t, 0, "", 0) for t in ("Z", "B", "B")] + [(7, None, "en", 1, "Word " * 200_000, 0, "", 0)]
    got = sorted((tuple(r) for r in merkle.verify(run(spark, rows)).collect()), key=str)
    assert got == sorted(plain(rows)[0], key=str)


def test_bytes_that_are_no_text_and_nothing(spark):
    broken = spark.range(3).select(
        F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("en").alias("lang"), F.lit(1).cast("long").alias("n_chars"),
        F.expr("cast(unhex(array('FF41', 'FE', '41')[int(id)]) as string)").alias("text"),
    )
    assert len({r.leaf for r in merkle.verify(broken).collect()}) == 3
    assert merkle.verify(spark.createDataFrame([], SCHEMA)).count() == 0
