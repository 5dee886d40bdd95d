"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one kept of each group.

Centres are fitted on a bounded sample; every vector is then assigned to the cell of its nearest
centre. A link may cross a border: two unit vectors within the chord ``d`` of the threshold lie in
different cells only if each is within ``d`` of the plane between the centres, so a vector is also
shown to those cells, one of the two directions being enough. No link is lost by this, whatever the
centres. Within a cell, blocks of bounded size are compared pair by pair, as matrix products in
double precision. A block pair gives each vector its number of links and a spanning forest, never
the links themselves. Copies of a vector are compared once.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors
without a label, link with nothing; nor do vectors of different lengths. Repeated rows are copies
and link with each other. Rows without id count as links and take the smallest id of their group; a
row is kept if its id is that of its component, null equal to null. An empty table gives an empty
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import components, map_batches
from .simhash import forest

SAMPLE = 8192  # vectors on which centres are fitted
PER_CELL = 4096  # vectors for which there is one centre
MOST_CELLS = 512
BLOCK = 2048  # vectors of a block; a vector moves once for each block it is compared with
CHUNK = 512  # vectors that are compared with a block, or with the centres, in one product


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, without a Python number for each component."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit(vectors: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centres by spherical k-means: means of unit vectors, scaled to length one."""
    centres = vectors[np.random.default_rng(0).permutation(len(vectors))[:cells]]
    for _ in range(rounds):
        home = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vectors)
        empty = np.abs(sums).max(axis=1) < 1e-12
        sums[empty] = centres[empty]
        centres = unit(sums)
    return centres


def centres_of(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Centres for each length of vectors, fitted on a sample of about ``SAMPLE`` vectors."""
    sizes = {r[0]: r[1] for r in nodes.groupBy(F.size("vector")).agg(F.count(F.lit(1))).orderBy(F.desc("count(1)")).limit(64).collect()}
    total = sum(sizes.values())
    share = min(1.0, SAMPLE / max(1, total))
    taken = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").collect()
    out = {}
    for size, n in sizes.items():
        sample = [r.vector for r in taken if len(r.vector) == size]
        if sample:
            cells = min(MOST_CELLS, math.ceil(n / PER_CELL), len(sample))
            out[size] = fit(unit(np.array(sample, float)), cells)
    return out


def placed(nodes: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Nodes with ``cells``: the home cell first, then those of higher number that a link may reach."""
    chord = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def make():
        apart = {k: np.linalg.norm(c[:, None] - c[None], axis=2) for k, c in centres.items()}

        def cells(vectors: pa.Array, size: int) -> Iterator[list[int]]:
            for start in range(0, len(vectors), CHUNK):
                near = unit(matrix(vectors.slice(start, CHUNK))) @ centres[size].T
                home = near.argmax(axis=1)
                reach = near[np.arange(len(near)), home][:, None] - near <= chord * apart[size][home]
                reach &= np.arange(near.shape[1]) > home[:, None]
                for h, r in zip(home.tolist(), reach, strict=True):
                    yield [h, *np.flatnonzero(r).tolist()]

        def work(columns):
            vectors = columns["vector"]
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            found = [[0]] * len(vectors)
            for size in np.unique(sizes).tolist():
                if size in centres:
                    where = np.flatnonzero(sizes == size)
                    for at, listed in zip(where.tolist(), cells(vectors.take(pa.array(where)), size), strict=True):
                        found[at] = listed
            return {**columns, "cells": found}

        return work

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return map_batches(nodes, make, f"{kinds}, cells array<int>")


def compare(threshold: float):
    """The function from a tile to the links of its vectors: their number, and a forest."""

    def run(tile: pa.Table) -> pa.Table:
        node, own, copies = (tile[c].to_numpy() for c in ("node", "own", "copies"))
        guest = tile["guest"].to_numpy().astype(bool)
        vectors = unit(matrix(tile["vector"]))
        x, y = tile["x"][0].as_py(), tile["y"][0].as_py()
        rows, cols = np.flatnonzero(own == x), np.flatnonzero(own == y)
        counts, every = np.zeros(len(node), np.int64), np.arange(len(node))
        root = every
        for start in range(0, len(rows), CHUNK):
            part = rows[start : start + CHUNK]
            linked = vectors[part] @ vectors[cols].T >= threshold
            linked &= ~(guest[part][:, None] & guest[cols][None])  # these meet in another cell
            if x == y:
                linked &= part[:, None] != cols[None]
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            i, j = part[i], cols[j]
            np.add.at(counts, i, copies[j])
            if x != y:
                np.add.at(counts, j, copies[i])
            root = forest(len(node), np.concatenate([every, i]), np.concatenate([root, j]))
        hit = counts > 0
        return pa.table({"node": node[hit], "n": counts[hit], "root": node[root][hit]})

    return run


def near(nodes: DataFrame, threshold: float) -> DataFrame:
    """For ``node``, ``label``, ``vector``, ``copies``: per tile the linked nodes, the rows ``n`` that
    they link with, and ``root``, a node of the same component."""
    spread = placed(nodes, centres_of(nodes), threshold).select(
        "node", "label", "vector", "copies", F.size("vector").alias("size"), F.posexplode("cells").alias("guest", "cell")
    )
    spread = cut(spread.withColumn("guest", F.col("guest") > 0))
    group = ["label", "size", "cell"]
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    crowds = spread.groupBy(*group).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    tiles = (
        spread.join(crowds.select(*group, blocks.alias("blocks")), group)
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("x", F.least("own", "other"))
        .withColumn("y", F.greatest("own", "other"))
    )
    return tiles.groupBy(*group, "x", "y").applyInArrow(compare(threshold), "node long, n long, root long")


def near_duplicates(
    table: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row for each vector: its id, ``n_links``, ``component_id`` and ``kept``."""
    rows = table.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (vector, "vector"), (label, "label"))])
    rows = rows.withColumn("usable", usable(F.col("vector")) & F.col("label").isNotNull())
    nodes = rows.filter("usable").groupBy("label", "vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = cut(near(nodes.select("node", "label", "vector", "copies"), threshold))
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = (
        nodes.join(joined, "node", "left")
        .join(linked, "node", "left")
        .select(
            "label", "vector", "first", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
        )
    )
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = cut(known.join(smallest, "root").select("label", "vector", "n_links", "component_id"))
    good = rows.filter("usable").join(known, ["label", "vector"]).select("id", "n_links", "component_id")
    rest = rows.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


ORACLE = """
with recursive v as (
    select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (
    select a.vec_id as x, b.vec_id as y from v a join v b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id as id, vec_id as root from embeddings union select l.y, r.root from r join l on r.id = l.x),
c as (select id, min(root) as component_id from r group by id),
n as (select x, count(*) as n from l group by x)
select vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join c on c.id = vec_id left join n on n.x = vec_id
"""
