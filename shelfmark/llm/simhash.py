"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared by bit planes.

Fingerprints that differ in at most ``radius`` bits agree in one of ``radius + 1`` stretches of bits,
so candidates meet by equal stretches. What meets is compared bit-sliced: the fingerprints of a tile
are stored as 64 bit planes, many distances at once are counted by carry-save adders on machine
words, and a row of the tile is given up once all its distances exceed the radius.

``keep_one``, the pipeline's stage, keeps one document of each component of the same links.

Defined results: a null text counts as empty, a text without words has fingerprint zero and is
linked like any other, a text with fewer words than a shingle is one shingle. Repeated rows share a
fingerprint and a component. A row without id joins the component of its fingerprint; a component of
such rows alone has a null id. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import components, map_batches

SEED = 42
# Fingerprints that one comparison takes from each of two blocks, and rows that small buckets are
# gathered to. They only set the size of a task's arrays.
BLOCK = 1024
GATHER = 256

# For each byte, its bits spread over the eight bytes of a word.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").view(np.uint64).ravel()


def simhash(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned number."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    size = min(shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    n = len(words) - size + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    return int(np.packbits(bit_counts(hashes) * 2 > n, bitorder="little").view(np.uint64)[0])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    starts = np.arange(0, len(hashes), 255)  # a byte counts to 255
    lanes = [np.add.reduceat(SPREAD[octets[:, j]], starts).view(np.uint8).reshape(-1, 8) for j in range(8)]
    return np.concatenate([x.sum(axis=0, dtype=np.int64) for x in lanes])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """Columns ``keys`` and ``fp``, the fingerprint as a signed long."""
    kept = docs.select(*keys, F.col(text).cast("binary").alias("__text"))
    schema = ", ".join([*(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys), "fp long"])

    def make():
        def work(columns):
            found = [simhash(t or b"", shingle) for t in columns.pop("__text").to_pylist()]
            return {**columns, "fp": pa.array(np.array(found, np.uint64).view(np.int64))}

        return work

    return map_batches(kept, make, schema)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: 64 rows of machine words with one lane for each fingerprint."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(octets, ((0, 0), (0, -octets.shape[1] % 8)))).view(np.uint64)


def links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places i < j whose fingerprints differ in at most ``radius`` bits."""
    n = len(fps)
    plane = planes(fps)
    # lanes that are out: the row's own, those before it, and the padding
    lanes = np.arange(plane.shape[1] * 64)
    out = np.packbits((lanes <= np.arange(n)[:, None]) | (lanes >= n), axis=1, bitorder="little")
    out = np.ascontiguousarray(out).view(np.uint64)
    rows = np.arange(n)
    # the count of each lane, by binary digit; one more digit than the radius needs
    digits = [np.zeros_like(out) for _ in range(int(radius).bit_length())]
    for b in range(64):
        ones = -((fps[rows] >> np.uint64(b)) & np.uint64(1)).astype(np.int64)
        carry = plane[b] ^ ones.view(np.uint64)[:, None]
        for d in range(len(digits)):
            digits[d], carry = digits[d] ^ carry, digits[d] & carry
        out |= carry | above(digits, radius)
        if b % 8 == 7:
            alive = ~(out == ~np.uint64(0)).all(axis=1)
            if not alive.any():
                return rows[:0], rows[:0]
            rows, out, digits = rows[alive], out[alive], [d[alive] for d in digits]
    i, j = np.nonzero(np.unpackbits((~out).view(np.uint8), axis=1, bitorder="little"))
    return rows[i], j


def above(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count, given by its binary digits, exceeds the radius."""
    over = np.zeros_like(digits[0])
    equal = ~over
    for d in range(len(digits) - 1, -1, -1):
        if radius >> d & 1:
            equal = equal & digits[d]
        else:
            over |= equal & digits[d]
            equal = equal & ~digits[d]
    return over


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place of the component of each place, by its links."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new[root]
    return root


def near(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``a``, ``b`` between different fingerprints (column ``fp``, distinct) that differ in at
    most ``radius`` bits: of each tile a spanning forest, which has the components of all its links."""
    stretches = radius + 1
    edges = [64 * s // stretches for s in range(stretches + 1)]
    parts = [
        F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) * stretches + s
        for s, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    keyed = fps.select("fp", F.explode(F.array(*parts)).alias("key"))
    crowds = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a bucket of many blocks becomes tiles, one for each pair of its blocks
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    tiles = (
        keyed.join(crowds, "key")
        .select("key", "fp", blocks.alias("blocks"), F.pmod(F.hash("fp"), blocks).alias("own"))
        .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    )
    tiles = tiles.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches, GATHER):
            fp = np.unique(block)
            root = fp[forest(len(fp), *links(fp.view(np.uint64), radius))]
            far = root != fp
            if far.any():
                yield pa.RecordBatch.from_pydict({"a": fp[far], "b": root[far]})

    return tiles.mapInArrow(compare, "a long, b long")


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[np.ndarray]:
    """Fingerprints of whole tiles, which follow each other; small ones together up to ``least``."""
    rest, key = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("key", "x", "y", "fp")]
        key = np.concatenate([key, np.stack(columns[:3], axis=1)])
        rest = np.concatenate([rest, columns[3]])
        starts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        done = 0
        for s in starts:
            if s - done >= least:
                yield rest[done:s]
                done = s
        rest, key = rest[done:], key[done:]
    if len(rest):
        yield rest


def groups(slim: DataFrame, key: str, radius: int = 2) -> DataFrame:
    """The fingerprints of ``slim`` (columns ``key``, ``fp``), each with ``component_id``: the smallest
    key that its links reach."""
    firsts = cut(slim.groupBy("fp").agg(F.min(key).alias("first")))
    joined = components(near(firsts.select("fp"), radius))
    placed = firsts.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return cut(placed.join(smallest, "root").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """One row for each document: its id, ``fingerprint`` in hexadecimal and ``component_id``."""
    slim = cut(fingerprints(docs, [id_col], text))
    return slim.join(groups(slim, id_col, radius), "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id, null after all others, of
    several such rows one. All columns are kept."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = cut(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("rid")), compression="zstd")
    named = held.select("rid", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text}`").alias("text"))
    slim = cut(fingerprints(named, ["rid", "id"]))
    rank = F.struct(F.col("id").isNull().alias("missing"), "id", "rid")
    # each component is named by its first row, so the rows themselves are not joined with their groups
    chosen = groups(slim.select(rank.alias("rank"), "fp"), "rank", radius).select("component_id.rid").distinct()
    return held.join(chosen.hint("shuffle_hash"), "rid", "left_semi").select("row.*")
