"""Embedding whitening (operator 12).

Entries become integers, x = floor(64 c) + 1000000, so counts and sums are exact. The covariance is summed by tasks over
centred vectors: x minus the integer next to the mean is exact, and only the fraction that is left is rounded. Tasks send
the rows of their matrix, one by one, to be summed over the cluster; what reaches the driver is one matrix of dimension by
dimension, whatever the number of vectors. There Householder reflections make it tridiagonal, bisection over Sturm counts
finds the leading eigenvalues, and inverse iteration their vectors, made orthogonal again inside clusters of close
eigenvalues. The components are broadcast and every vector is projected where it is read.

Cases: rows without a vec_id, and vectors that are null, hold a null or non-finite entry, are empty, or have another
dimension than the most frequent one (the smaller of two equally frequent), are dropped; zero vectors stay; rows that repeat
a vec_id or are equal are rows of their own; entries whose 64-fold passes 2^62 count as 2^62 with their sign; components
whose eigenvalue is nothing but rounding (at most dimension times 2^-52 of the trace: constant or dependent dimensions, or a
single vector) can't be scaled to unit variance and are left out; an empty table gives an empty result. deviation is null
where it passes 64 bits; deviation_exact holds it up to 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

COMPONENTS = 32
SCALE, SHIFT, FAR = 64.0, 1_000_000, 1 << 62
EPS = 2.0**-52
#: Neighbouring eigenvalues closer than this share of the matrix's norm form a cluster.
CLUSTER = 1e-3
ITERATIONS = 5
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections that led there."""
    a, n = a.copy(), len(a)
    off, mirrors = np.zeros(max(n - 1, 0)), []
    for k in range(n - 1):
        x = a[k + 1 :, k]
        length = np.linalg.norm(x)
        if length == 0 or k == n - 2:
            off[k] = x[0]
            mirrors.append(None)
            continue
        off[k] = -length if x[0] > 0 else length
        v = x.copy()
        v[0] -= off[k]
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        mirrors.append(v)
    return a.diagonal().copy(), off, mirrors


def sturm_counts(diagonal: np.ndarray, squares: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """For each x the number of eigenvalues below it: the negative pivots of the shifted matrix."""
    count, q = np.zeros(len(x), np.int64), np.ones(len(x))
    for d, s in zip(diagonal, np.concatenate([[0], squares])):
        q = d - x - s / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, by bisection of all of them side by side."""
    n = len(diagonal)
    around = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    norm = max(np.abs(diagonal).max() + around.max(), np.finfo(float).tiny)
    low, high = np.full(k, (diagonal - around).min() - EPS * norm), np.full(k, (diagonal + around).max() + EPS * norm)
    wanted = n - 1 - np.arange(k)  # so many eigenvalues lie below it
    least = EPS * EPS * norm
    for _ in range(200):
        middle = (low + high) / 2
        above = sturm_counts(diagonal, off * off, middle, least) > wanted
        low, high = np.where(above, low, middle), np.where(above, middle, high)
        if (high - low <= EPS * np.maximum(np.abs(low), np.abs(high)) + least).all():
            break
    return (low + high) / 2


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Solves (T - shift) z = right for each column, by elimination with row exchanges."""
    n, b = len(diagonal), right.copy()
    d = diagonal[:, None] - shifts
    u = np.repeat(np.append(off, 0.0)[:, None], len(shifts), axis=1)
    u2 = np.zeros_like(u)
    for i in range(n - 1):
        below = off[i]
        swap = np.abs(below) > np.abs(d[i])
        pivot = np.where(swap, below, np.where(np.abs(d[i]) < least, least, d[i]))
        factor = np.where(swap, d[i], below) / pivot
        first, second = u[i].copy(), d[i + 1].copy()
        third = u[i + 1].copy() if i < n - 2 else np.zeros(len(shifts))
        d[i + 1] = np.where(swap, first - factor * second, second - factor * first)
        u[i] = np.where(swap, second, first)
        u2[i] = np.where(swap, third, 0.0)
        if i < n - 2:
            u[i + 1] = np.where(swap, -factor * third, third)
        top, bottom = b[i].copy(), b[i + 1].copy()
        b[i] = np.where(swap, bottom, top)
        b[i + 1] = np.where(swap, top - factor * bottom, bottom - factor * top)
        d[i] = pivot
    for i in range(n - 1, -1, -1):
        known = (u[i] * b[i + 1] if i + 1 < n else 0.0) + (u2[i] * b[i + 2] if i + 2 < n else 0.0)
        b[i] = (b[i] - known) / np.where(np.abs(d[i]) < least, least, d[i])
    return b


def leading_eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of falling eigenvalues, as columns: inverse iteration from random starts. Members of a cluster are
    made orthogonal to the ones before them after every solution."""
    n, k = len(diagonal), len(values)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    apart = np.abs(np.diff(values)) > CLUSTER * norm
    cluster = np.concatenate([[0], np.cumsum(apart)])
    shifts = values.copy()
    for j in range(1, k):  # equal shifts would give equal vectors
        if cluster[j] == cluster[j - 1] and shifts[j - 1] - shifts[j] < 2 * EPS * norm:
            shifts[j] = shifts[j - 1] - 2 * EPS * norm
    z = np.random.default_rng(12).standard_normal((n, k))
    for _ in range(ITERATIONS):
        z /= np.linalg.norm(z, axis=0)
        z = solve_shifted(diagonal, off, shifts, z, EPS * norm)
        z /= np.linalg.norm(z, axis=0)
        for j in range(k):
            mates = z[:, :j][:, cluster[:j] == cluster[j]]
            for _ in range(2):
                z[:, j] -= mates @ (mates.T @ z[:, j])
            z[:, j] /= np.linalg.norm(z[:, j])
    return z


def leading_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues, falling, and their unit eigenvectors as columns."""
    if not covariance.any():
        return np.zeros(k), np.eye(len(covariance), k)
    diagonal, off, mirrors = tridiagonal(covariance)
    values = leading_eigenvalues(diagonal, off, k)
    z = leading_eigenvectors(diagonal, off, values)
    for j in range(len(mirrors) - 1, -1, -1):
        if (v := mirrors[j]) is not None:
            z[j + 1 :] -= 2 * np.outer(v, v @ z[j + 1 :])
    return values, z


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * entries), -FAR, FAR - 1024).astype(np.int64) + SHIFT


class Centre:
    """n, the exact sums S and the mean S/n as an integer and a fraction of each dimension."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.fraction = np.array([(s % n) / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 for each row, exact."""
        rest = np.array([s % self.n for s in self.sums], object)
        near = x - self.whole
        bound = self.n * (int(np.abs(near).max(initial=0)) + 1)
        if bound * bound * max(1, x.shape[1]) < 1 << 63:
            y = self.n * near - rest.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * near.astype(object) - rest
        return (y * y).sum(axis=1).tolist()


def _entries(b: pa.RecordBatch) -> np.ndarray:
    return whole_numbers(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))


def exact_sums(rows: DataFrame, dimension: int) -> list[int]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimension, object)
        for b in batches:
            if b.num_rows:
                x = _entries(b)
                total += (x.sum(axis=0) if int(np.abs(x).max()) < (1 << 62) // len(x) else x.astype(object).sum(axis=0)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension, dtype=np.int32)), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["k", "total"])

    found = rows.mapInArrow(add, "k int, total decimal(38,0)").groupBy("k").agg(F.sum("total").alias("total")).collect()  # a row for each dimension
    by = {r.k: int(r.total) for r in found}
    return [by[k] for k in range(dimension)]


def summed_products(rows: DataFrame, size: int, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of y y' over all rows, with y = project(x), a row of the matrix at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            if b.num_rows:
                y = project(_entries(b))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array([row.tobytes() for row in total], pa.binary())], names=["k", "row"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for row in b.column(1).to_pylist():
                total += np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "row"])

    out = np.zeros((size, size))
    for r in rows.mapInArrow(add, "k int, row binary").groupBy("k").applyInArrow(merge, "k int, row binary").collect():  # size rows
        out[r.k] = np.frombuffer(r.row)
    return (out + out.T) / 2


def usable(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """(vec_id, v) of the rows that remain, their number and their dimension."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not common:
        return rows, 0, 0
    return rows.where(F.size("v") == common.d), common["count"], common.d


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    spark = vectors.sparkSession
    small_batches(spark)
    rows, n, dimension = usable(vectors)
    if not n:
        return spark.createDataFrame([], RESULT)
    centre = Centre(n, exact_sums(rows, dimension))
    covariance = summed_products(rows, dimension, centre.centred) / n
    trace = float(np.trace(covariance))
    values, unit = leading_components(covariance, min(components, dimension))
    real = values > dimension * EPS * trace
    values, unit = values[real], unit[:, real]
    if not len(values):
        return spark.createDataFrame([], RESULT)
    shared = spark.sparkContext.broadcast((centre, unit / np.sqrt(values)))  # dimension x components
    covered = summed_products(rows, len(values), lambda x: shared.value[0].centred(x) @ shared.value[1]) / n
    error = float(np.abs(covered - np.eye(len(values))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, scaled = shared.value
        for b in batches:
            if b.num_rows:
                x = _entries(b)
                y = centre.centred(x) @ scaled
                exact = centre.deviations(x)
                white = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
                deviation = pa.array([t if t < 1 << 63 else None for t in exact], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), deviation, pa.array([str(t) for t in exact]), white], names=["vec_id", "deviation", "digits", "white"])

    explained = F.array(*[F.lit(float(e) / trace) for e in values])
    each = rows.mapInArrow(project, "vec_id long, deviation long, digits string, white array<double>").select("vec_id", "deviation", "digits", F.posexplode("white").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"), F.expr("try_cast(digits AS decimal(38,0))").alias("deviation_exact"),
    )
