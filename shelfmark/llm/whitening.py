"""Embedding whitening: principal components and whitened coordinates by Golub-Kahan-Lanczos bidiagonalisation.

A vector's entries become the integers x = floor(256 c). The fit list is each different x once; its
sums are exact, its rows are centred before anything is multiplied. The fit list is written once, as
blocks of packed integers. A step of the bidiagonalisation is one pass over the blocks: every task forms
its piece of u = X w and, from it, its piece of X'u; what leaves a task is one vector of sums. Here w is
the step's right vector v less what earlier left vectors hold of it, so u comes out orthogonal to them;
the products X'u show how far it is not, and are corrected by it, with a second pass where much is left.
Right vectors, which are as long as a row is wide, are kept whole and orthogonalised twice. The left ones,
as long as the table, are never written: u = X w gives their pieces again. The small bidiagonal matrix's
singular values and right vectors give deviations and components.

One start finds one vector of each singular value. When the leading values stand, or a step finds nothing
new, the bidiagonalisation goes on from a new direction, until a whole such chain has added nothing to the
leading ones (or all dimensions are used). So equal values are found as often as they occur.

Bounds: the driver and each task hold a few numbers for each step and dimension, never rows; steps are at
most the dimensions. All state is a table in the shared folder and those numbers, so lost executors cost
a task again.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, and so are
rows with no entries and rows whose length is not the commonest one (of equally common ones the shortest).
An x beyond 64 bits is the nearest one that fits. Repeated rows give repeated rows; ids may be null.
Components without variance are left out: equal vectors, one vector or an empty table give no rows. A
deviation beyond 64 bits is null. A component's largest entry by amount is positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import bounded

SCALE = 256
COMPONENTS = 4
BLOCK = 2 << 20  # bytes of a block's rows as 64-bit numbers
KINDS = (np.int16, np.int32, np.int64)
# A singular value or a coupling below this share of the largest counts as none.
NOTHING = 1e-9
# What may be missing of a component, as a share of the largest singular value.
MISSING = 1e-15


def quantised(vectors: np.ndarray) -> np.ndarray:
    """x of finite entries, as 64-bit integers."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    return np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Integers in the smallest kind that holds them; equal ones give equal bytes."""
    low, high = x.min(), x.max()
    code = next(k for k, t in enumerate(KINDS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([code]) + x.astype(KINDS[code]).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    """The rows that ``packed`` was given."""
    return np.frombuffer(data, KINDS[data[0]], offset=1).reshape(-1, width).astype(np.int64)


def usable(table: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, has entries, and only finite ones."""
    column = F.col(f"`{vector}`")
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.filter(F.coalesce(finite & (F.size(column) > 0), F.lit(False)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def fit_list(rows: DataFrame, width: int) -> DataFrame:
    """Each different x once, in blocks: column ``block`` holds packed rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in bounded(batch):
                seen = {packed(x) for x in quantised(matrix(small.column(0), width))}
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary())], names=["x"])

    most = max(1, BLOCK // (8 * width))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held += [unpacked(x, width) for x in batch.column(0).to_pylist()]
            while len(held) >= most:
                yield pa.RecordBatch.from_arrays([pa.array([packed(np.concatenate(held[:most]))], pa.binary())], names=["block"])
                held = held[most:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([packed(np.concatenate(held))], pa.binary())], names=["block"])

    different = rows.select("vector").mapInArrow(pack, "x binary").distinct()
    return cut(different.mapInArrow(block, "block binary"))


@dataclass
class Fit:
    """What the fit list gives: its size, sums, and the components with their deviations."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # a component in each column
    values: np.ndarray  # singular values of the centred rows, falling
    trace: float = 0.0  # of the covariance
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def sums_of(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sums of the dimensions."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * (width + 1)
        for batch in batches:
            for data in batch.column(0):
                block = unpacked(data.as_py(), width)
                if max(-int(block.min()), int(block.max())) >= 1 << 32:  # sums may not fit: Python's integers
                    block = block.astype(object)
                sums = [a + int(b) for a, b in zip(sums, [len(block), *block.sum(axis=0)], strict=True)]
        columns = [pa.array(range(width + 1), pa.int32()), pa.array([str(v) for v in sums], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "value"])

    parts = blocks.mapInArrow(add, "at int, value string")
    found = parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).collect()
    by = {r["at"]: int(r.value) for r in found}
    return by.get(0, 0), [by.get(k + 1, 0) for k in range(width)]


def summed(blocks: DataFrame, mean: np.ndarray, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of the ``size`` numbers that ``work`` makes of a block's centred rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for data in batch.column(0):
                total += work(unpacked(data.as_py(), len(mean)) - mean)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["at", "value"])

    found = blocks.mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["at"]] = r["value"]
    return out


class Bidiagonal:
    """The state of a bidiagonalisation X V = U B: right vectors ``v``, coefficients ``w`` of the left ones
    (u = X w), the products ``xu`` = X'u, and ``b``.

    Within a chain ``b`` has two diagonals. A chain that was broken off leaves its last coupling, kept in
    ``loose``, and with the next chain one more entry each above them.
    """

    def __init__(self, width: int, product: Callable[[np.ndarray], tuple[np.ndarray, float]]):
        self.width, self.product = width, product
        self.v, self.w, self.xu = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((width, 0))
        self.b = np.zeros((0, 0))
        self.loose: dict[int, float] = {}  # by step: what couples it to a direction that is not taken in
        self.chains: list[int] = []  # the step at which each chain begins
        self.random = np.random.default_rng(0)
        self.largest = 0.0

    @property
    def steps(self) -> int:
        return len(self.b)

    def free(self, g: np.ndarray) -> np.ndarray:
        """``g`` without what the right vectors hold of it."""
        for _ in range(2):
            g = g - self.v @ (self.v.T @ g)
        return g

    def new_direction(self) -> np.ndarray:
        """A random unit vector orthogonal to the right vectors."""
        while True:
            g = self.random.standard_normal(self.width)
            left = self.free(g / np.linalg.norm(g))
            if np.linalg.norm(left) > 1e-6:
                return left / np.linalg.norm(left)

    def step(self, v: np.ndarray) -> np.ndarray | None:
        """Take in ``v``; the next right vector, or None where the chain ends."""
        h = self.xu.T @ v  # what earlier left vectors hold of X v
        w = v - self.w @ h
        for _ in range(3):
            z, square = self.product(w)  # X'(X w) and |X w|², over all rows
            held = self.w.T @ z  # what they still hold of it
            w, z, h = w - self.w @ held, z - self.xu @ held, h + held
            square -= held @ held
            if held @ held <= 1e-8 * max(square, 0.0):
                break
        alpha = float(np.sqrt(max(square, 0.0)))
        self.largest = max(self.largest, alpha)
        nothing = alpha <= NOTHING * self.largest
        alpha, w, z = (0.0, 0 * w, 0 * z) if nothing else (alpha, w / alpha, z / alpha)
        grown = np.zeros((self.steps + 1, self.steps + 1))
        grown[:-1, :-1], grown[:-1, -1], grown[-1, -1] = self.b, h, alpha
        self.v, self.w, self.xu = (np.column_stack(p) for p in ((self.v, v), (self.w, w), (self.xu, z)))
        self.b = grown
        self.loose.pop(self.steps - 2, None) if self.chains[-1] < self.steps - 1 else None
        g = self.free(z)
        beta = float(np.linalg.norm(g))
        if beta <= NOTHING * self.largest:
            return None
        self.loose[self.steps - 1] = beta
        return g / beta

    def svd(self, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values of ``b`` from a step on, their right vectors, and what may be missing of each."""
        left, values, right = np.linalg.svd(self.b[start:, start:])
        missing = np.zeros(len(values))
        for at, beta in self.loose.items():
            if at >= start:
                missing = np.hypot(missing, beta * left[at - start])
        return values, right.T, missing

    def run(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The leading singular values and, in columns, their right vectors."""
        v: np.ndarray | None = None
        while self.steps < self.width:
            if v is None:
                self.chains.append(self.steps)
                v = self.new_direction()
            v = self.step(v)
            values, _, missing = self.svd()
            if len(values) < wanted or (missing[:wanted] > MISSING * values[0]).any():
                continue
            if len(self.chains) == 1:
                v = None  # all stand; look for more from elsewhere
                continue
            mine, _, open_ = self.svd(self.chains[-1])
            if open_[0] > 0.01 * mine[0]:
                continue  # the chain's largest is not known yet
            if mine[0] + open_[0] <= values[wanted - 1] * (1 + 1e-12):
                break
            if open_[0] <= MISSING * values[0]:
                v = None
        values, right, _ = self.svd()
        return values[:wanted], (self.v @ right)[:, :wanted]


def fit(rows: DataFrame, width: int, wanted: int = COMPONENTS) -> Fit | None:
    """Components of the fit list of ``rows`` (column ``vector``, of ``width`` entries); None without rows."""
    blocks = fit_list(rows, width)
    n, sums = sums_of(blocks, width)
    if n == 0:
        return None
    found = Fit(n, sums, np.zeros((width, 0)), np.zeros(0))
    mean = found.mean
    found.trace = float(summed(blocks, mean, lambda centred: np.array([np.square(centred).sum()]), 1)[0]) / n
    if not found.trace:
        return found

    def product(w: np.ndarray) -> tuple[np.ndarray, float]:
        def work(centred: np.ndarray) -> np.ndarray:
            u = centred @ w
            return np.append(centred.T @ u, u @ u)

        out = summed(blocks, mean, work, width + 1)
        return out[:width], float(out[width])

    values, vectors = Bidiagonal(width, product).run(min(wanted, width))
    held = values > NOTHING * values[0]
    values, vectors = values[held], vectors[:, held]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    found.values, found.vectors = values, vectors
    k, white = len(values), vectors / (values / np.sqrt(n))

    def moments(centred: np.ndarray) -> np.ndarray:
        z = centred @ white
        return np.append(z.sum(axis=0), z.T @ z)

    out = summed(blocks, mean, moments, k + k * k) / n
    covariance = out[k:].reshape(k, k) - np.outer(out[:k], out[:k])
    found.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return found


def whiten(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """For each usable row and each of the leading components: id, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``."""
    rows = usable(table, vector).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    common = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    rows = rows.filter(F.size("vector") == (common.width if common else 0))
    found = fit(rows, common.width, wanted) if common else None
    k = len(found.values) if found else 0
    if not k:
        return table.sparkSession.createDataFrame([], schema).toDF(*names)
    width, n, sums, mean = common.width, found.n, np.array(found.sums, object), found.mean
    variances = found.values**2 / n
    white, explained, error = found.vectors / np.sqrt(variances), variances / found.trace, found.identity_error

    def deviations(x: np.ndarray) -> list[int | None]:
        most = n * max(-int(x.min()), int(x.max())) + max(abs(int(s)) for s in sums)
        if width * most * most < 1 << 63:
            apart = n * x - sums.astype(np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in bounded(batch, 2 << 20):
                if not small.num_rows:
                    continue
                x = quantised(matrix(small.column("vector"), width))
                order = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        small.column("id").take(pa.array(order)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(order), n, np.int64)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(order)),
                        pa.array(((x - mean) @ white).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(order), error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, schema).toDF(*names)
