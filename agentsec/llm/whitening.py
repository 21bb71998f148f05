"""Operator 12, embedding whitening: exact distributed covariance, our own symmetric eigensolver, one projection.

1. Entries become integers x = floor(scale * c) + shift. A first pass adds them up by dimension; a second adds up the
   products of y = x - round(mean), so of centred integers. All sums are exact, so the covariance doesn't depend on
   how rows are dealt to tasks, nor on a task run again after a lost executor. Sums of a task leave it as one row
   for each pair of dimensions; only the d x d matrix, whose size doesn't grow with the rows, comes to the driver.
2. There: Householder reflections make it tridiagonal, bisection on Sturm counts finds the leading eigenvalues, inverse
   iteration their vectors, orthogonalised again inside clusters of close eigenvalues, and the reflections are undone.
3. Components (d x k) go out with the projection's tasks. The whitened table is written once, and its covariance is
   measured again from that table.

Rows whose vector is null or holds a null or a non-finite entry take no part and are not returned. Repeated rows and
ids all count, and a null id is kept. Vectors of several lengths have no common covariance: ValueError. Components of
(numerically) zero variance can't be whitened and are left out: so one row, or all rows equal, give an empty result,
as does an empty table. Equal eigenvalues (ties) get some orthonormal basis of their space, the same for all rows.
Of each component the largest coefficient is positive. `deviation` is null where it exceeds a long. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Eigenvalues closer than this share of the matrix's norm form a cluster.
CLUSTER = 1e-3


# --- exact sums ----------------------------------------------------------------------------------------------
def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v) of the rows whose vector is complete and finite."""
    v = F.col(vector_col).cast("array<double>")
    broken = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.col(vector_col).isNotNull() & ~broken).select(F.col(id_col).alias("_id"), v.alias("_v"))


def scaled(column: pa.Array, scale: int, shift: int) -> Iterator[np.ndarray]:
    """Integer matrices of the runs of equal length in a batch."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    at, row = 0, 0
    while row < len(sizes):
        stop = row + (int(np.argmax(sizes[row:] != sizes[row])) or len(sizes) - row)
        n = int(sizes[row])
        x = np.floor(scale * values[at : at + n * (stop - row)].reshape(stop - row, n))
        if np.abs(x).max(initial=0) >= 2**62:
            raise ValueError("an entry is too large to be scaled to a long")
        yield x.astype(np.int64) + shift
        at, row = at + n * (stop - row), stop


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y' y in exact integers: by floating point where every partial sum stays under 2^53, else by Python's integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < 2**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    big = y.astype(object)
    return big.T @ big


def dimension_sums(vectors: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """(rows, sum of x for each dimension)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in scaled(batch.column("_v"), scale, shift):
                d = x.shape[1]
                rows[d] = rows.get(d, 0) + len(x)
                exact = x.sum(0) if int(np.abs(x).max(initial=0)) * len(x) < 2**62 else x.astype(object).sum(0)
                sums[d] = sums.get(d, np.zeros(d, object)) + exact.astype(object)
        for d, n in rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), pa.array([str(n), *map(str, sums[d])])], ["d", "i", "s"])

    parts = map_arrow(vectors.select("_v"), task, "d int, i int, s string")
    rows = parts.groupBy("d", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    if len({r.d for r in rows}) > 1:
        raise ValueError(f"vectors of several lengths: {sorted({r.d for r in rows})}")
    by = {r.i: int(r.s) for r in rows}
    return by.get(-1, 0), [by[i] for i in range(len(by) - 1)]


def covariance(vectors: DataFrame, n: int, sums: list[int], scale: int, shift: int) -> np.ndarray:
    """Covariance of x with divisor n, each entry the exact value rounded once."""
    d = len(sums)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    at = np.array(middle, np.int64)
    upper = np.triu_indices(d)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in scaled(batch.column("_v"), scale, shift):
                gram = exact_gram(x - at)[upper].astype(object)
                total = gram if total is None else total + gram
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(list(map(str, total)))], ["i", "j", "s"])

    parts = map_arrow(vectors.select("_v"), task, "i int, j int, s string")
    v, rest = np.zeros((d, d)), [s - n * m for s, m in zip(sums, middle)]
    for r in parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).toLocalIterator():
        v[r.i, r.j] = v[r.j, r.i] = float(Fraction(n * int(r.s) - rest[r.i] * rest[r.j], n * n))
    return v


# --- eigenvalues and vectors of the d x d matrix ---------------------------------------------------------------
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, Householder vectors) of a symmetric matrix."""
    a, d, mirrors = a.copy(), len(a), []
    for k in range(d - 2):
        x = a[k + 1 :, k]
        size = np.abs(x).max(initial=0.0)
        u = np.zeros(d - k - 1)
        if np.any(x[1:]):
            u = x / size
            u[0] += np.copysign(np.linalg.norm(u), u[0] or 1.0)
            u /= np.linalg.norm(u)
            block = a[k + 1 :, k + 1 :]
            p = block @ u
            w = 2 * (p - (u @ p) * u)
            block -= np.outer(u, w) + np.outer(w, u)
            x -= 2 * (u @ x) * u
            a[k, k + 1 :] = x
        mirrors.append(u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def sturm_counts(diagonal: np.ndarray, off2: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each point."""
    tiny = np.finfo(float).tiny
    q = diagonal[0] - at
    count = (q < 0).astype(int)
    for k in range(1, len(diagonal)):
        q = diagonal[k] - at - off2[k - 1] / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, all bisected at once."""
    d = len(diagonal)
    around = np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])
    low, high = np.full(k, (diagonal - around).min()), np.full(k, (diagonal + around).max())
    wanted, off2 = d - np.arange(k), off * off
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return np.maximum(low, high)
        over = sturm_counts(diagonal, off2, middle) >= wanted
        high, low = np.where(over, middle, high), np.where(over, low, middle)


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, floor: float) -> np.ndarray:
    """Solve (T - shift) x = b by elimination with row exchanges; pivots under `floor` count as `floor`."""
    d = len(diagonal)
    main, up, up2, x = diagonal - shift, np.r_[off, 0.0], np.zeros(d), b.copy()
    for k in range(d - 1):
        low = off[k]
        if abs(low) > abs(main[k]):
            main[k], up[k], low, main[k + 1], up2[k], up[k + 1] = low, main[k + 1], main[k], up[k], up[k + 1], 0.0
            x[k], x[k + 1] = x[k + 1], x[k]
        if abs(main[k]) < floor:
            main[k] = floor
        f = low / main[k]
        main[k + 1] -= f * up[k]
        up[k + 1] -= f * up2[k]
        x[k + 1] -= f * x[k]
    if abs(main[-1]) < floor:
        main[-1] = floor
    for k in range(d - 1, -1, -1):
        x[k] = (x[k] - (up[k] * x[k + 1] if k + 1 < d else 0.0) - (up2[k] * x[k + 2] if k + 2 < d else 0.0)) / main[k]
    return x


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix: the k largest."""
    d = len(v)
    norm = float(np.abs(v).sum(0).max(initial=0.0))
    if not norm:
        return np.zeros(0), np.zeros((d, 0))
    diagonal, off, mirrors = tridiagonal(v / norm)
    values = leading_eigenvalues(diagonal, off, min(k, d))
    rng, eps = np.random.default_rng(0), np.finfo(float).eps
    vectors, cluster = np.zeros((d, len(values))), 0
    for c, value in enumerate(values):
        if c and values[c - 1] - value > CLUSTER:
            cluster = c
        shift = min(value, shift - 2 * eps) if c > cluster else value  # equal values in a cluster are told apart
        x = rng.standard_normal(d)
        for _ in range(6):
            for _ in range(2):  # twice is enough to be orthogonal to working precision
                x -= vectors[:, cluster:c] @ (vectors[:, cluster:c].T @ x)
            x = solve_shifted(diagonal, off, shift, x / np.linalg.norm(x), eps)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= vectors[:, cluster:c] @ (vectors[:, cluster:c].T @ x)
        vectors[:, c] = x / np.linalg.norm(x)
    for k_, u in reversed(list(enumerate(mirrors))):
        vectors[k_ + 1 :] -= 2 * np.outer(u, u @ vectors[k_ + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    keep = values > d * eps
    vectors = vectors[:, keep]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values[keep] * norm, vectors


# --- projection ------------------------------------------------------------------------------------------------
def project(vectors: DataFrame, n: int, sums: list[int], values: np.ndarray, components: np.ndarray, scale: int, shift: int) -> DataFrame:
    """(_id, deviation, whitened array) of every row."""
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([float(Fraction(s, n) - int(m)) for s, m in zip(sums, middle)])
    matrix = components / np.sqrt(values)

    def deviations(y: np.ndarray) -> list[int | None]:
        # n*x - S = n*(x - middle) - (S - n*middle)
        less = np.array([s - n * int(m) for s, m in zip(sums, middle)], object)
        most = n * int(np.abs(y).max(initial=0)) + max(map(abs, less), default=0)
        if most * most * max(1, y.shape[1]) < 2**63:
            z = n * y - less.astype(np.int64)
            return (z * z).sum(1).tolist()
        exact = ((n * y.astype(object) - less) ** 2).sum(1)
        return [int(e) if e < 2**63 else None for e in exact]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for x in scaled(batch.column("_v"), scale, shift):
                y = x - middle
                w = (y - rest) @ matrix
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(row, len(x)), pa.array(deviations(y), pa.int64()), flat], ["_id", "deviation", "whitened"])
                row += len(x)

    kind = vectors.schema["_id"].dataType.simpleString()
    return map_arrow(vectors, task, f"_id {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """Largest absolute entry of the whitened table's covariance minus the identity."""
    w = lambda i: F.col("whitened")[i]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*[F.covar_pop(w(i), w(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and leading component."""
    rows = usable(vectors, id_col, vector_col)
    n, sums = dimension_sums(rows, scale, shift)
    v = covariance(rows, n, sums, scale, shift) if n and sums else np.zeros((0, 0))
    values, vectors_ = leading_components(v, components)
    names = f"{id_col} {rows.schema['_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(values):
        return vectors.sparkSession.createDataFrame([], names)
    table_ = materialize(project(rows, n, sums, values, vectors_, scale, shift), "whitened")
    error, trace = identity_error(table_, len(values)), float(np.trace(v))
    explained = F.array(*[F.lit(float(e) / trace) for e in values])
    out = table_.select("_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return out.select(F.col("_id").alias(id_col), (F.col("_k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("_k")].alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
