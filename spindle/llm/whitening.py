"""Whitening of embeddings: streaming moments, merged over partitions, and a symmetric eigen-solve.

Each partition's iterator updates a mean and a matrix of co-moments by one rank a vector (Welford); states of
partitions are merged in a tree by the parallel formula, a few at a time, so that no task holds more than two. What
reaches the driver is one state: as large as the dimension squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import copysign, hypot

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: An entry c counts as the whole number floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: States merged by one task of the tree.
FAN = 16
#: Entries are held within these bounds, far beyond any embedding, so that whole numbers stay in 64 bits.
_MOST = float(1 << 62)

_STATE = "part long, n long, sums string, mean binary, co binary"
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ------------------------------------------------------------------ moments


@dataclass
class Moments:
    """Number, exact sums (of whole numbers; else None), mean and sum of co-deviations of vectors."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    co: np.ndarray

    @staticmethod
    def none(dim: int, exact: bool) -> Moments:
        return Moments(0, [0] * dim if exact else None, np.zeros(dim), np.zeros((dim, dim)))

    def add(self, rows: np.ndarray) -> None:
        """One rank-one update a row."""
        mean, co, step = self.mean, self.co, np.empty_like(self.co)
        for row in rows.astype(np.float64):
            self.n += 1
            off = row - mean
            mean += off / self.n
            np.multiply.outer(off * ((self.n - 1) / self.n), off, out=step)
            co += step
        if self.sums is not None and len(rows):
            fits = float(np.abs(rows).max()) * len(rows) < _MOST
            self.sums = [a + b for a, b in zip(self.sums, rows.sum(axis=0).tolist() if fits else (sum(map(int, c)) for c in rows.T))]

    def merge(self, other: Moments) -> Moments:
        """Moments of both together."""
        if not self.n or not other.n:
            return self if self.n else other
        n, off = self.n + other.n, other.mean - self.mean
        sums = None if self.sums is None else [a + b for a, b in zip(self.sums, other.sums)]
        return Moments(n, sums, self.mean + off * (other.n / n), self.co + other.co + np.multiply.outer(off, off) * (self.n / n * other.n))

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": None if self.sums is None else ",".join(map(str, self.sums)), "mean": self.mean.tobytes(), "co": self.co.tobytes()}

    @staticmethod
    def of(row: dict) -> Moments:
        mean = np.frombuffer(row["mean"]).copy()
        return Moments(row["n"], None if row["sums"] is None else [int(s) for s in row["sums"].split(",")], mean, np.frombuffer(row["co"]).reshape(len(mean), -1).copy())


def _merged(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])  # one order, so that reruns agree to the last bit
    total = Moments.of(rows[0])
    for r in rows[1:]:
        total = total.merge(Moments.of(r))
    return pa.Table.from_pylist([total.row(rows[0]["part"] // FAN)], schema=table.schema)


def moments(vectors: DataFrame, dim: int, exact: bool, of: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Moments:
    """Moments of of(x) for all vectors x, whose last column has ``dim`` entries each; of keeps or changes their number to dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            rows = of(_whole(batch.column(batch.num_columns - 1)))
            state = state or Moments.none(rows.shape[1], exact)
            state.add(rows)
        if state is not None and state.n:
            yield pa.RecordBatch.from_pylist([state.row(TaskContext.get().partitionId())], schema=arrow)

    arrow = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.string()), ("mean", pa.binary()), ("co", pa.binary())])
    states = first = C.materialize(vectors.mapInArrow(run, _STATE))
    top = states.agg(F.max("part")).first()[0]
    if top is None:
        return Moments.none(dim, exact)
    while top:
        states, top = states.groupBy(F.floor(F.col("part") / FAN).alias("_group")).applyInArrow(_merged, _STATE), top // FAN
    out = Moments.of(states.first().asDict())
    C.discard(first)
    return out


# ------------------------------------------------------------------ eigen-solve


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and rows of the orthogonal matrix of Householder's reduction of a symmetric matrix."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        scale = float(np.abs(v).max())  # squares of tiny entries would vanish
        if scale < np.finfo(float).tiny:
            a[k + 1, k] = 0.0
            continue
        v /= scale
        alpha = -copysign(np.linalg.norm(v), v[0])
        v[0] -= alpha
        v /= np.linalg.norm(v)
        alpha *= scale
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= v * (v @ w)
        rest -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        a[k + 1, k] = alpha
        q[k + 1 :] -= 2 * np.multiply.outer(v, v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows) of a symmetric matrix: tridiagonal form, then implicit QR steps with Wilkinson's shift.

    Each vector's entry of greatest size is positive.
    """
    d, e, q = _tridiagonal(np.asarray(a, dtype=np.float64))
    eps, hi = np.finfo(float).eps, len(d) - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1])) + np.finfo(float).tiny
        e[:hi][small] = 0.0
        if small[hi - 1]:
            hi -= 1
            continue
        gaps = np.flatnonzero(small)
        lo = int(gaps[-1]) + 1 if len(gaps) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + copysign(hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            here, there, off = d[k], d[k + 1], e[k]
            d[k] = c * c * here + 2 * c * s * off + s * s * there
            d[k + 1] = s * s * here - 2 * c * s * off + c * c * there
            e[k] = c * s * (there - here) + (c * c - s * s) * off
            x = e[k]
            if k < hi - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    d, q = d[order], q[order]
    return d, q * np.where(q[np.arange(len(q)), np.abs(q).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]


# ------------------------------------------------------------------ whitening


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: number and sums of the vectors, the projection (dim by components) and each component's share."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: int64 where that is enough, else Python's integers."""
        if max(float(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0)) < _MOST:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64) @ self.projection


def _whole(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    scaled = np.floor(SCALE * flat.astype(np.float64)).clip(-_MOST, _MOST)
    return scaled.astype(np.int64).reshape(len(column), -1) + OFFSET


def usable(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """vec_id and embedding of the rows whose vector counts, and the dimension, which is the commonest length (of equals the greatest)."""
    vec = F.col(vec_col).cast("array<double>")
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("embedding")).filter(
        F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & (F.size("embedding") > 0))
    common = good.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = common.dim if common else 0
    return good.filter(F.size("embedding") == dim), dim


def fit(vectors: DataFrame, dim: int, components: int) -> Whitening | None:
    """The whitening of vectors as ``usable`` gives them; None if there are none.

    A component without variance (eigenvalue at most 1e-13 of the sum of all) projects everything on 0.
    """
    found = moments(vectors, dim, exact=True)
    if not found.n:
        return None
    values, axes = symmetric_qr(found.co / found.n)
    total, k = float(np.trace(found.co / found.n)), min(components, dim)
    values, axes = values[:k], axes[:k]
    live = values > 1e-13 * total
    projection = np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0) * axes.T
    return Whitening(found.n, found.sums, projection, np.where(live, values, 0.0) / total if total else np.zeros(k))


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every usable row and component.

    A row is dropped if its vector is null or empty, holds a null or non-finite entry, or has another length than most
    vectors (which has no place in a covariance). Null and repeated ids keep their rows; repeated vectors count as
    often as they stand. Other columns are ignored. An empty table gives no rows. One vector, and components without
    variance, are whitened to 0 (the identity error is then 1). A deviation beyond a long is null. An entry beyond
    2**52 counts as about that. identity_error is measured by a second pass over the whitened values.
    """
    vectors, dim = usable(rows, id_col, vec_col)
    vectors = C.spread(vectors)
    model = fit(vectors, dim, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], _RESULT)
    k = model.projection.shape[1]
    after = moments(vectors, k, exact=False, of=model)
    error = float(np.abs(after.co / after.n - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column(1))
            off, n = model.deviations(x), len(x)
            small = off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * dim < _MOST
            squares = (off**2).sum(axis=1) if small else [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in r) for r in off)]
            yield pa.RecordBatch.from_arrays([
                pa.array(batch.column(0)).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n, dtype=np.int64)),
                pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(n), k))), pa.array(model(x).ravel()), pa.array(np.tile(model.explained, n)), pa.array(np.full(n * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, _RESULT)
