"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Rows. A vector becomes whole numbers, x = floor(64 * c) + 1000000; the fit list is each distinct x vector once (a hash
aggregation with map-side combine). It is kept in blocks of `BLOCK` rows, one cell of bytes each, so that a pass is a scan of plain arrays.

Bidiagonalisation. With A the centred rows, A V = U R and A' U = V R' + residual: alternately u = A v (a pass that gives the products
of the new column with all columns of U and its length) and A' u (a pass that gives the next column of V), each as sums of tasks. V and the
small triangle R (bidiagonal but for what rounding leaves) are on the driver; U is as long as the corpus and is kept nowhere: a task
gets its rows' part of U back from A V and the inverse of R. Every new column is made orthogonal to all earlier ones, on
both sides, and what rounding left is measured and taken off too. The singular values and right vectors of R give deviations and components. It ends once the residual of every
wanted component is below rounding and the squares not met yet can't hold a greater one, or with all dimensions.

Scale. A pass is a narrow scan; partial sums (a few numbers for each task) meet in the square root of as many tasks before they
reach the driver. Vectors of d entries need at most 2 d + 3 passes, fewer where the spectrum falls.

Defined cases: vectors that are null, empty, or hold null or non-finite entries are left out, and so are those whose entries have no 64-bit
form (beyond 2**62 / 64) or whose length isn't the commonest (of equally common lengths the greater); repeated rows count once in the fit and are returned each; components
beyond the rank of the fit list (deviation below its rounding error) don't exist, so one distinct vector gives no rows; equal
eigenvalues give some orthonormal basis of their space; a deviation over 64 bits is null; a null vec_id is kept; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm import scratch

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK = 4096
#: Partial sums that the driver takes as they are; more meet in tasks first.
DIRECT = 64


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and the vector as longs (x) of all rows that take part."""
    c = F.col(column).cast("array<double>")
    whole = F.transform(c, lambda e: F.floor(e * F.lit(float(SCALE))))
    good = (F.size(c) > 0) & F.forall(c, lambda e: F.coalesce(F.abs(e) < F.lit(2.0**62 / SCALE), F.lit(False)))  # false for NaN too
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.transform(whole, lambda e: e.cast("long") + F.lit(SHIFT))).alias("x")).where("x is not null")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (common[0]["d"] if common else 0))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows as bytes."""
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy()
        if len(batch):
            rows = flat.reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([pa.array([rows[i : i + BLOCK].tobytes() for i in range(0, len(rows), BLOCK)], pa.binary())], names=["rows"])


def _sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in parts:
        for cell in batch.column(0).to_pylist():
            x = np.frombuffer(cell)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def total(blocks: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all rows of what `of` gives for each block (an array of doubles)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for cell in batch.column(0):
                x = of(np.frombuffer(cell.as_buffer(), np.int64))
                out = x if out is None else out + x
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    parts = blocks.mapInArrow(partial, "sums binary")
    tasks = blocks.rdd.getNumPartitions()
    if tasks > DIRECT:
        parts = parts.repartition(max(DIRECT, math.isqrt(tasks))).mapInArrow(_sums, "sums binary")
    return sum((np.frombuffer(r["sums"]) for r in parts.collect()), np.zeros(size))


@dataclass
class Centre:
    """Count and exact sums of the fit list; rows are centred from whole numbers."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.near = np.array([round(s / self.n) for s in self.sums], np.int64)
        self.rest = np.array([s - self.n * int(m) for s, m in zip(self.sums, self.near, strict=True)], np.float64) / self.n

    def rows(self, flat: np.ndarray) -> np.ndarray:
        """x - S / n of the rows of a block."""
        return (flat.reshape(-1, len(self.near)) - self.near) - self.rest

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """The exact sum over the dimensions of (n * x - S) ** 2, where it has 64 bits."""
        apart = rows - self.near
        rest = [s - self.n * int(m) for s, m in zip(self.sums, self.near, strict=True)]
        widest = self.n * (int(np.abs(apart).max(initial=0)) + 1)
        if widest**2 * max(1, len(rest)) < 2**62:
            return ((self.n * apart - np.array(rest)) ** 2).sum(1).tolist()
        exact = (sum((self.n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in apart.tolist())
        return [v if v < 2**63 else None for v in exact]


@dataclass
class Whitening:
    """Components as columns, their eigenvalues, and the trace of the covariance."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0

    def project(self, rows: np.ndarray) -> np.ndarray:
        return self.centre.rows(rows) @ (self.vectors / np.sqrt(self.values))


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(blocks: DataFrame, centre: Centre, wanted: int, norm: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(right singular vectors, singular values, passes) of the centred rows, the greatest first. norm: the root of the sum of all their squares."""
    spark, d, passes = blocks.sparkSession, len(centre.near), 0
    rounding, tiny = np.finfo(float).eps, 1e-13 * norm
    rng = np.random.default_rng(12)

    def fresh(basis: np.ndarray) -> np.ndarray:
        v = _orthogonal(rng.normal(size=d), basis)
        return v / np.linalg.norm(v)

    right = fresh(np.zeros((d, 0)))[:, None]  # V
    triangle = np.zeros((0, 0))  # R: a row for each column of U, a column for each of V
    pivots: list[int] = []  # the columns of V that gave a column of U
    backs = np.zeros((d, 0))  # A' U
    while True:
        k, j = len(pivots), right.shape[1] - 1
        inverse = np.linalg.inv(triangle[:, pivots]) if k else np.zeros((0, 0))
        own = spark.sparkContext.broadcast((right[:, [*pivots, j]], inverse))

        def along(flat: np.ndarray, own=own, k=k) -> np.ndarray:
            """Products of the new column A v with the columns of U."""
            right, inverse = own.value
            y = centre.rows(flat) @ right
            return (y[:, :k] @ inverse).T @ y[:, k]

        column = total(blocks, along, k) if k else np.zeros(0)
        own.destroy()
        own = spark.sparkContext.broadcast((right[:, [*pivots, j]], inverse, column))

        def across(flat: np.ndarray, own=own, k=k) -> np.ndarray:
            """A' w of the new column less its part in U, and the products of w with U and with itself, which tell what rounding left."""
            right, inverse, column = own.value
            a = centre.rows(flat)
            y = a @ right
            u = y[:, :k] @ inverse
            w = y[:, k] - u @ column
            return np.concatenate((a.T @ w, u.T @ w, [w @ w]))

        got = total(blocks, across, d + k + 1)
        own.destroy()
        passes += 1 + (k > 0)
        back, more, square = got[:d], got[d : d + k], got[d + k]
        alpha = np.sqrt(max(square - more @ more, 0.0))
        triangle = np.hstack((triangle, (column + more)[:, None]))
        beta = 0.0
        if alpha > tiny:
            back = (back - backs @ more) / alpha
            triangle = np.vstack((triangle, np.append(np.zeros(j), alpha)))
            pivots.append(j)
            backs = np.hstack((backs, back[:, None]))
            new = _orthogonal(back, right)
            beta = float(np.linalg.norm(new))
        left, values, rows = np.linalg.svd(triangle, full_matrices=False)
        hidden = max(norm**2 - (values**2).sum(), 0.0)  # the squares that no column of V has met bound all components still unseen
        if j + 1 == d or hidden <= rounding * d * norm**2:
            break
        if len(values) >= wanted and hidden <= values[wanted - 1] ** 2 and (beta * np.abs(left[-1, :wanted]) <= rounding * values[0]).all():
            break
        # where the space is closed (equal singular values, few distinct rows) a new direction opens another one
        right = np.hstack((right, (new / beta if beta > tiny else fresh(right))[:, None]))
    return right @ rows.T, values, passes


def _counted(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task, and for each dimension the sums of the upper and lower halves of its numbers."""
    n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
    for batch in batches:
        for cell in batch.column(0):
            rows = np.frombuffer(cell.as_buffer(), np.int64).reshape(-1, d)
            n, high, low = n + len(rows), high + (rows >> 31).sum(0), low + (rows & (2**31 - 1)).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([0, *high.tolist()]), pa.array([n, *low.tolist()])], names=["i", "high", "low"])


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """x: rows of `integers`. None where no component exists."""
    first = x.select(F.size("x")).limit(1).collect()
    if not first:
        return None
    d = first[0][0]
    blocks = scratch.keep(x.select("x").distinct().mapInArrow(_packed, "rows binary"), "blocks")
    sums = blocks.mapInArrow(lambda batches: _counted(batches, d), "i int, high long, low long").groupBy("i")
    sums = {r["i"]: int(r["h"]) * 2**31 + int(r["l"]) for r in sums.agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c[0]) for c in ("high", "low"))).collect()}
    n = sums.pop(-1)
    centre = Centre(n, [sums[i] for i in range(d)])
    norm = float(np.sqrt(total(blocks, lambda flat: np.array([(centre.rows(flat) ** 2).sum()]), 1)[0]))
    if not norm:
        return None
    vectors, values, passes = bidiagonalise(blocks, centre, min(components, d), norm)
    real = int((values > 1e-11 * values[0]).sum())
    vectors, values = vectors[:, : min(real, components)], values[: min(real, components)] ** 2 / n
    found, m = Whitening(centre, vectors, values, norm**2 / n, passes=passes), len(values)
    got = total(blocks, lambda flat: np.concatenate(((z := found.project(flat)).sum(0), (z.T @ z).ravel())), m + m * m)
    mean = got[:m] / n
    found.identity_error = float(np.abs(got[m:].reshape(m, m) / n - np.outer(mean, mean) - np.eye(m)).max())
    return found


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(x: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each row of `integers` and component."""
    if model is None:
        return x.sparkSession.createDataFrame([], OUTPUT)
    shipped = x.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        m = len(own.values)
        for batch in batches:
            if not len(batch):
                continue
            rows = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
            each = lambda a: pa.array(np.tile(a, len(batch)))  # noqa: B023, E731
            whole = pa.array(own.centre.deviations(rows), pa.int64())
            at = pa.array(np.repeat(np.arange(len(batch)), m))
            columns = [batch.column(0).take(at), each(np.arange(1, m + 1, dtype=np.int32)), pa.array(np.full(len(at), own.centre.n)), whole.take(at)]
            columns += [pa.array(own.project(rows).ravel()), each(own.values / own.trace), pa.array(np.full(len(at), own.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, OUTPUT)


def query(spark, sf_dir: str) -> DataFrame:
    x = integers(scratch.table(spark, sf_dir, "embeddings"))
    return whiten(x, fit(x))
