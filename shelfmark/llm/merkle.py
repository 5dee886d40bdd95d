"""Merkle manifest of a dataset: a postorder append log, and proofs extracted from it.

Every row is a leaf; the leaves of a source, in the order of their ids, make a tree in which each node
digests ``ARITY`` consecutive ones of the level below, and the sources' roots make a tree of their own.
All leaves of a tree have the same depth, so a node is named by its level and number.

Builders are aligned: one takes the 16² nodes of a level that begin at a multiple of 16², makes the two
levels (``DEPTH``) above them, and appends nodes as they are complete, children before parents. So a
builder's nodes lie in postorder, a subtree in one stretch, and where a node stands follows from the
sizes of the subtrees before it in closed form (``position``), within a builder as in the whole log.
The topmost nodes of all builders are what the builders of the next round take; a round leaves a 256th,
so two or three rounds do for any table.

A proof needs a leaf's siblings level by level. Those inside its builder's stretch are read at their
closed-form places; those above are the same for all leaves of the builder, and come down from round to
round as a path: a builder's own siblings, then its parent's path. Builders meet their parent on a key of
theirs, at most 16² of them, so neither a large source nor the nodes near a root are hot keys.

Texts are read once and do not move: what is sorted and numbered is ids, sources and digests. No task
holds a source; no row comes to the driver, only counts.

Defined results: a source's rows are ordered by id, null first, rows with the same id by their leaf; so
equal rows are leaves each, with proofs of their own. A null source is a source, the first. Ids are
written as decimals (text ids as text). Bytes that are no UTF-8 are digested as they are. A text without
A-Z is not changed by tampering. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.order import numbered
from ..session import cut
from .common import UPPER

ARITY = 16
DEPTH = 2  # levels that a builder makes
SIZE = 32  # bytes of a digest
TOP = -1  # the tree of the sources' roots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # fixed by the contract, in this order
TAMPERED = 5  # ids whose checksum this divides


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves; 0 for a single one."""
    levels = 0
    while n > 1:
        n, levels = ceil_div(n, ARITY), levels + 1
    return levels


def position(n: int, level: int, i: int) -> int:
    """Where node ``i`` of ``level`` stands in the postorder of a tree of ``n`` leaves.

    Before it are, up to its level, all nodes that end no later than it does, and above its level those
    whose leaves all stand before its own.
    """
    end = min((i + 1) * ARITY**level, n)
    below = sum(ceil_div(end, ARITY**m) for m in range(level + 1))
    return below + sum(i // ARITY ** (m - level) for m in range(level + 1, height(n) + 1)) - 1


def joined(parts: list[bytes]) -> str:
    """H of digests, as hexadecimal text one after the other."""
    return hashlib.sha256(b"".join(parts).hex().encode()).hexdigest()


def appended(nodes: list[bytes], levels: int) -> list[bytes]:
    """The nodes of a builder in postorder: ``nodes``, and ``levels`` levels above them, each when complete."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def complete(level: int, node: bytes, last: bool) -> None:
        log.append(node)
        if level < levels:
            run = open_[level + 1]
            run.append(node)
            if len(run) == ARITY or last:
                made = bytes.fromhex(joined(run))
                open_[level + 1] = []
                complete(level + 1, made, last)

    for k, node in enumerate(nodes, 1):
        complete(0, node, k == len(nodes))
    return log


def levels_of(n: int, base: int, depth: int) -> int:
    """Levels that builders of ``depth`` on level ``base`` of a tree of ``n`` leaves make."""
    return min(depth, height(n) - base)


def siblings(log: bytes, k: int, levels: int, i: int) -> list[tuple[int, bytes]]:
    """Of input ``i`` of a builder with ``k``: per level its place in its run, and the others of the run."""
    out = []
    for level in range(levels):
        count, number = ceil_div(k, ARITY**level), i // ARITY**level
        first = number - number % ARITY
        others = []
        for j in range(first, min(first + ARITY, count)):
            if j != number:
                # within the builder, subtree sizes give the place as they do in the whole log
                end = min((j + 1) * ARITY**level, k)
                at = sum(ceil_div(end, ARITY**m) for m in range(level + 1)) - 1
                at += sum(j // ARITY ** (m - level) for m in range(level + 1, levels + 1))
                others.append(log[at * SIZE : (at + 1) * SIZE])
        out.append((number - first, b"".join(others)))
    return out


def builders(nodes: DataFrame, base: int, depth: int, carried: list[str]) -> DataFrame:
    """One row for each builder over ``nodes`` (``tree``, ``n``, ``i``, ``node``) of level ``base``: ``tree``,
    ``n``, ``builder`` (its number), ``k`` (its inputs), ``log`` and, as lists, the columns ``carried``."""
    types = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = "tree long, n long, builder long, k int, log binary" + "".join(f", {c} array<{types[c]}>" for c in carried)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        n, i = group["n"][0].as_py(), group["i"][0].as_py()
        log = appended(group["node"].to_pylist(), levels_of(n, base, depth))
        row = [group["tree"][0].as_py(), n, i // ARITY**depth, group.num_rows, b"".join(log), *(group[c].to_pylist() for c in carried)]
        return pa.table([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    keyed = nodes.withColumn("builder", F.expr(f"i div {ARITY**depth}"))
    return keyed.groupBy("tree", "builder").applyInArrow(build, schema)


@dataclass
class Forest:
    """Trees by their builders: ``rounds[r]`` holds those on level r * depth."""

    rounds: list[DataFrame]
    depth: int

    @property
    def span(self) -> int:
        """Nodes that a builder takes."""
        return ARITY**self.depth

    def last(self, r: int) -> Column:
        """Whether one builder of round ``r`` ends the tree: its level has at most ``span`` nodes, and that of
        the round before had more."""
        done = F.col("n") <= self.span ** (r + 1)
        return done if r == 0 else done & (F.col("n") > self.span**r)

    def finished(self, r: int) -> DataFrame:
        """The roots (``tree``, ``node``) of the trees whose last round is ``r``."""
        return self.rounds[r].filter(self.last(r)).select("tree", last_node().alias("node"))

    def roots(self) -> DataFrame:
        every = self.finished(0)
        for r in range(1, len(self.rounds)):
            every = every.unionByName(self.finished(r))
        return every


def last_node() -> Column:
    """The topmost node of a builder: the last one that it appended."""
    return F.substring(F.col("log"), -SIZE, SIZE)


def grow(leaves: DataFrame, most: int, depth: int, carried: list[str] | None = None) -> Forest:
    """Trees over ``leaves``: ``tree``, ``n`` (its leaves), ``i``, ``node``; none has more than ``most``."""
    made = Forest([cut(builders(leaves, 0, depth, carried or []))], depth)
    while most > made.span ** len(made.rounds):
        r = len(made.rounds)
        open_ = made.rounds[-1].filter(F.col("n") > made.span**r)
        tops = open_.select("tree", "n", F.col("builder").alias("i"), last_node().alias("node"))
        made.rounds.append(cut(builders(tops, r * depth, depth, [])))
    return made


PATH = "array<struct<at:int, others:binary>>"


def with_paths(trees: Forest, roots: DataFrame) -> DataFrame:
    """Builders of the first round with ``path``, the siblings above them, and ``root``; ``roots`` (``tree``,
    ``path``, ``root``) has what stands above the trees."""
    below = None
    for r in range(len(trees.rounds) - 1, -1, -1):
        run = trees.rounds[r]
        above = run.filter(trees.last(r)).join(roots, "tree")  # one builder of each tree
        if below is not None:
            above = above.unionByName(run.filter(F.col("n") > trees.span ** (r + 1)).join(below, ["tree", "builder"]))
        if r:
            below = cut(inputs(above, r * trees.depth, trees.depth).withColumnRenamed("i", "builder"))
    return above


def inputs(run: DataFrame, base: int, depth: int) -> DataFrame:
    """Each input of builders with paths: ``tree``, its number ``i``, its ``path``, and ``root``."""
    schema = f"tree long, i long, path {PATH}, root binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                levels = levels_of(b["n"], base, depth)
                paths = [
                    [{"at": at, "others": others} for at, others in siblings(b["log"], b["k"], levels, i)] + b["path"]
                    for i in range(b["k"])
                ]
                numbers = range(b["builder"] * ARITY**depth, b["builder"] * ARITY**depth + b["k"])
                columns = [[b["tree"]] * b["k"], list(numbers), paths, [b["root"]] * b["k"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return run.select("tree", "n", "builder", "k", "log", "path", "root").mapInArrow(unfold, schema)


def field(value: Column) -> Column:
    """A value with its length before it; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """Per row ``id``, ``source``, its ``leaf`` and ``shown``: the leaf that is to be verified, that of the
    tampered row where the row is tampered with."""
    fields = [F.col(f"`{c}`") for c in FIELDS]
    tampered = F.coalesce(F.pmod(F.crc32(fields[0].cast("string").cast("binary")), F.lit(TAMPERED)) == 0, F.lit(False))
    other = leaf([*fields[:-1], F.translate(fields[-1], UPPER, UPPER.lower())])
    rows = docs.select(fields[0].alias("id"), fields[1].cast("string").alias("source"), leaf(fields).alias("node"), F.when(tampered, other).alias("other"))
    return rows.select("id", "source", "node", F.coalesce("other", "node").alias("shown"))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their tree and number, the sources (``tree``, ``source``, ``n``), and how many these are.

    Rows are numbered through, in ranges; a source's first number then gives the numbers within it. Rows
    and sources meet by source and stretch of numbers, so a large source is many keys.
    """
    ordered, _ = numbered(rows, ["source", "id", "node", "shown"], "idx")
    sums = ordered.groupBy("source").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("n"))
    ranked, m = numbered(sums, ["source"], "tree")
    sources = cut(ranked)
    stretch = 1 << 10
    spans = sources.select(
        "source", "start", "n", "tree", F.explode(F.expr(f"sequence(start div {stretch}, (start + n - 1) div {stretch})")).alias("stretch")
    )
    found = ordered.withColumn("stretch", F.expr(f"idx div {stretch}")).alias("r").join(
        spans.alias("s"), (F.col("r.stretch") == F.col("s.stretch")) & F.col("r.source").eqNullSafe(F.col("s.source"))
    )
    return found.select("tree", "n", (F.col("idx") - F.col("start")).alias("i"), "node", "shown", "id"), sources, m


@dataclass
class Manifest:
    """A dataset's trees: those of its sources, that of their roots, and the sources by number."""

    forest: Forest
    top: Forest
    sources: DataFrame

    def log(self) -> DataFrame:
        """The append log: ``tree`` (a source's number; ``TOP`` for the tree of the sources), ``position``,
        ``level``, ``i``, ``node`` (hexadecimal). A tree's nodes in the order of ``position`` are its log."""
        every = None
        for forest in (self.forest, self.top):
            for r, run in enumerate(forest.rounds):
                part = logged(run, r, forest.depth)
                every = part if every is None else every.unionByName(part)
        return every


def logged(run: DataFrame, r: int, depth: int) -> DataFrame:
    """The nodes that the builders of round ``r`` appended, with their places in the whole log."""
    base = r * depth

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, n, builder, k, log = (batch.column(c)[row].as_py() for c in range(5))
                levels = levels_of(n, base, depth)
                # inputs of later rounds are in the log already
                made = [(m, j) for m in range(0 if r == 0 else 1, levels + 1) for j in range(ceil_div(k, ARITY**m))]
                names = [(base + m, builder * ARITY**depth // ARITY**m + j) for m, j in made]
                local = [
                    sum(ceil_div(min((j + 1) * ARITY**m, k), ARITY**q) for q in range(m + 1))
                    + sum(j // ARITY ** (q - m) for q in range(m + 1, levels + 1))
                    - 1
                    for m, j in made
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree] * len(made), pa.int64()),
                        pa.array([position(n, *name) for name in names], pa.int64()),
                        pa.array([level for level, _ in names], pa.int32()),
                        pa.array([i for _, i in names], pa.int64()),
                        pa.array([log[at * SIZE : (at + 1) * SIZE].hex() for at in local], pa.string()),
                    ],
                    names=["tree", "position", "level", "i", "node"],
                )

    return run.select("tree", "n", "builder", "k", "log").mapInArrow(spread, "tree long, position long, level int, i long, node string")


def manifest(docs: DataFrame, depth: int = DEPTH) -> Manifest:
    """Build all trees over ``docs``, which has the columns ``FIELDS``, by builders of ``depth`` levels."""
    rows, sources, m = placed(cut(leaves(docs)))
    most = sources.agg(F.max("n")).first()[0] or 0
    forest = grow(rows, most, depth, ["id", "node", "shown"])
    tops = forest.roots().select(F.lit(TOP).cast("long").alias("tree"), F.lit(m).cast("long").alias("n"), F.col("tree").alias("i"), "node")
    return Manifest(forest, grow(tops, m, depth), sources)


def proofs(made: Manifest, id_col: str = "doc_id") -> DataFrame:
    """One row for each leaf: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``."""
    depth = made.forest.depth
    whole = made.top.roots().first()  # one row, none without leaves
    root = whole.node.hex() if whole else ""
    none = made.top.roots().select("tree", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    above = inputs(with_paths(made.top, none), 0, made.top.depth).select(F.col("i").alias("tree"), "path")
    roots = made.forest.roots().withColumnRenamed("node", "root").join(above, "tree")
    runs = with_paths(made.forest, cut(roots))
    kind = next(f.dataType for f in runs.schema if f.name == "id").elementType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                levels = levels_of(b["n"], 0, depth)
                above = [(p["at"], p["others"].hex().encode()) for p in b["path"]]
                out: list[list] = [[] for _ in arrow]
                for i, (name, node, shown) in enumerate(zip(b["id"], b["node"], b["shown"], strict=True)):
                    path = [(at, others.hex().encode()) for at, others in siblings(b["log"], b["k"], levels, i)] + above
                    proof = hashlib.sha256(b"".join(others for _, others in path)).hexdigest()
                    folded = fold(shown.hex(), path)
                    values = (name, node.hex(), b["root"].hex(), root, proof, folded, folded == root)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    columns = ["n", "k", "log", "id", "node", "shown", "path", "root"]
    return runs.select(*columns).mapInArrow(extract, schema).withColumnRenamed("id", id_col)


def fold(node: str, path: list[tuple[int, bytes]]) -> str:
    """The root that a leaf and its siblings, in hexadecimal, lead to."""
    for at, others in path:
        left = at * 2 * SIZE
        node = hashlib.sha256(others[:left] + node.encode() + others[left:]).hexdigest()
    return node


def verify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``proofs`` of ``docs``, of which some are tampered with, against the manifest of the untampered rows."""
    return proofs(manifest(docs), id_col)


def oracle(levels: int = 6) -> str:
    """The same rows in DuckDB, for sources, and a number of them, of up to 16 ** ``levels``."""

    def text(column: str) -> str:
        return f"coalesce(octet_length(encode({column}::varchar)) || ':' || {column}::varchar, '-')"

    def hashed(last: str) -> str:
        return "sha256(" + " || ".join([*(text(c) for c in FIELDS[:-1]), text(last)]) + ")"

    parts = []

    def climb(name: str, tree: str) -> None:
        """Levels of trees: ``{name}0`` has tree, i, h; each level's node meets the others of its run."""
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} as (select {tree}, i // 16 as i, case when max(m) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end as h"
                f" from (select *, count(*) over (partition by {tree}) as m from {name}{k}) group by {tree}, i // 16)"
            )
            parts.append(
                f"{name}s{k} as (select a.{tree}, a.i, count(b.i) + 1 as run, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as l,"
                f" coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as r, (select count(*) from {name}{k} c where c.{tree} = a.{tree}) as m"
                f" from {name}{k} a left join {name}{k} b on a.{tree} = b.{tree} and a.i // 16 = b.i // 16 and a.i <> b.i group by a.{tree}, a.i)"
            )

    parts.append(
        f"d as (select doc_id, {hashed('text')} as leaf, {hashed(r'''translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')''')} as lower,"
        " dense_rank() over (order by source nulls first) as t, source from documents)"
    )
    parts.append("e as (select *, row_number() over (partition by t order by doc_id nulls first, leaf) - 1 as i from d)")
    parts.append("n0 as (select t, i, leaf as h from e)")
    climb("n", "t")
    parts.append(f"u0 as (select 0 as z, t - 1 as i, h from n{levels})")
    climb("u", "z")
    steps = [("n", "t", k) for k in range(levels)] + [("u", "z", k) for k in range(levels)]
    parts.append(CRC)
    parts.append(
        "f0 as (select e.doc_id, e.t, e.i as leaf_i, e.leaf, '' as proof, 0 as z, e.i, case when c.crc % 5 = 0 then e.lower else e.leaf end as h"
        " from e left join c on c.id is not distinct from e.doc_id)"
    )
    for at, (name, tree, k) in enumerate(steps):
        number = "f.t - 1" if (name, k) == ("u", 0) else "f.i"
        parts.append(
            f"f{at + 1} as (select f.doc_id, f.t, f.leaf_i, f.leaf, f.proof || s.l || s.r as proof, f.z, ({number}) // 16 as i,"
            f" case when s.m = 1 then f.h else sha256(s.l || f.h || s.r) end as h from f{at} f join {name}s{k} s on s.{tree} = f.{tree} and s.i = {number})"
        )
    return (
        "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, n{levels}.h as subroot, u{levels}.h as root, sha256(proof) as proof_sha256,"
        f" f.h as folded_root, f.h = u{levels}.h as verified from f{len(steps)} f join n{levels} on n{levels}.t = f.t cross join u{levels}"
    )


# CRC-32 of the decimals of the ids, a bit at a time.
CRC = """
cb as (select distinct doc_id as id, doc_id::varchar as name from documents where doc_id is not null),
cs as (select id, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(name, ''), lambda ch: ascii(ch)::bigint)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
        lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)) as state from cb),
c as (select id, xor(state, 4294967295::bigint) as crc from cs)"""
