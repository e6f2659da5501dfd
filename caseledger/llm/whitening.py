"""Whitening of embeddings by the leading eigenvectors of their covariance.

Vectors are put on a grid of 1/64 and the covariance is that of the distinct grid
vectors: exact sums first, then each task adds up products of centred vectors, and the
tasks' matrices are summed in the cluster. Only matrices of dimension by dimension reach
the driver, where the leading eigenpairs are found: Householder reflections make the
matrix tridiagonal, bisection on Sturm counts finds the largest eigenvalues, and inverse
iteration, orthogonalised again within clusters of close eigenvalues, their vectors. The
projection goes to the tasks with the closure, sixteen columns at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseledger.llm.sums import PARTS, rows_of, summed
from caseledger.storage import discard, stored

COMPONENTS = 16
LEAST_SHARE = 1e-9  # of the largest eigenvalue; smaller ones are rounding errors of zero
_GRID, _SHIFT = 64, 1_000_000
_LARGEST = 1 << 52  # of a grid coordinate
_LOW = 26  # bits of the lower part in exact sums

# --- eigenpairs of a symmetric matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and Householder vectors of a symmetric matrix."""
    a = np.array(matrix, float)
    d = len(a)
    mirrors = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        if scale == 0 or not np.abs(x[1:]).max():
            mirrors.append(np.zeros(d - k - 1))
            continue
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0] if v[0] else 1.0)
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        q = p - v * (v @ p)
        rest -= 2 * (np.outer(v, q) + np.outer(q, v))
        x -= 2 * v * (v @ x)
        a[k + 1, k] = x[0]
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def above(diagonal: np.ndarray, below: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix are larger than each x."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    squares = below**2
    q = diagonal[0] - x
    count = (q > 0).astype(int)
    for a, b2 in zip(diagonal[1:], squares, strict=True):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = a - x - b2 / q
        count += q > 0
    return count


def largest_eigenvalues(diagonal: np.ndarray, below: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest, falling, each bisected until the interval cannot be halved."""
    off = np.abs(below)
    radius = np.append(off, 0) + np.insert(off, 0, 0)
    low = np.full(k, (diagonal - radius).min())
    high = np.full(k, (diagonal + radius).max())
    slack = 4 * np.finfo(float).eps * max(abs(low[0]), abs(high[0]))
    low, high = low - slack, high + slack
    place = np.arange(1, k + 1)
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        enough = above(diagonal, below, middle) >= place
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)


def _solver(diagonal: np.ndarray, below: np.ndarray, value: float, least: float):
    """Solves with the matrix less ``value`` on its diagonal, by elimination with row exchanges."""
    d = len(diagonal)
    main, up, up2 = diagonal - value, np.append(below, 0.0), np.zeros(d)
    swaps, factors = [], []
    for i in range(d - 1):
        swap = abs(below[i]) > abs(main[i])
        if swap:
            main[i], low = below[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
        else:
            low = below[i]
        if abs(main[i]) < least:
            main[i] = least
        factor = low / main[i]
        main[i + 1] -= factor * up[i]
        up[i + 1] -= factor * up2[i]
        swaps.append(swap)
        factors.append(factor)
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(y: np.ndarray) -> np.ndarray:
        x = y.copy()
        for i, (swap, factor) in enumerate(zip(swaps, factors, strict=True)):
            if swap:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor * x[i]
        for i in range(d - 1, -1, -1):
            if i + 1 < d:
                x[i] -= up[i] * x[i + 1]
            if i + 2 < d:
                x[i] -= up2[i] * x[i + 2]
            x[i] /= main[i]
        return x

    return solve


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    d = len(matrix)
    k = min(k, d)
    scale = np.abs(matrix).max() if d else 0.0
    if not scale:
        return np.zeros(k), np.eye(d, k)
    diagonal, below, mirrors = tridiagonal(matrix / scale)
    values = largest_eigenvalues(diagonal, below, k)
    norm = max(np.abs(diagonal).max(), np.abs(below).max(initial=0.0))
    rng = np.random.default_rng(0)
    vectors = np.zeros((d, k))
    for j, value in enumerate(values):
        first = j  # of the cluster that the value is in
        while first and values[first - 1] - values[first] < 1e-3 * norm:
            first -= 1
        near = vectors[:, first:j]
        solve = _solver(diagonal, below, value, np.finfo(float).eps * norm)
        x = rng.standard_normal(d)
        for _ in range(5):
            x -= near @ (near.T @ x)
            x = solve(x / np.linalg.norm(x))
            x /= np.abs(x).max()
        for _ in range(2):
            x -= near @ (near.T @ x)
        vectors[:, j] = x / np.linalg.norm(x)
    for at, v in reversed(list(enumerate(mirrors, 1))):
        vectors[at:] -= 2 * np.outer(v, v @ vectors[at:])
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)


# --- grid vectors


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grid coordinates as the bytes of 64-bit integers, of rows that have them all."""
    for batch in batches:
        lists = batch.column(1).cast(pa.large_list(pa.float64()))
        there = np.asarray(lists.is_valid())
        ends = np.asarray(lists.offsets)
        sizes = np.diff(ends)
        values = lists.flatten()  # without what null lists may hold
        x = np.floor(_GRID * np.asarray(values.fill_null(np.nan)))
        good = np.abs(x) < _LARGEST  # not of NaN and infinity
        starts = np.cumsum(np.where(there, sizes, 0))
        bad = np.append(0, np.cumsum(~good))
        keep = there & (sizes > 0)
        begin = starts - np.where(there, sizes, 0)
        keep &= bad[starts] == bad[begin]
        x = np.where(good, x, 0).astype(np.int64) + _SHIFT
        raw = x.tobytes()
        rows = [raw[8 * a : 8 * b] for a, b in zip(begin[keep].tolist(), starts[keep].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(pa.array(keep)), pa.array(rows, pa.binary())], names=["vec_id", "x"]
        )


def _coordinates(column: pa.Array, dims: int) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), dims)


def _sums(dims: int):
    """A task's number of vectors and exact sum of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, [0] * dims
        for batch in batches:
            x = _coordinates(batch.column(0), dims)
            high, low = (x >> _LOW).sum(0).tolist(), (x & ((1 << _LOW) - 1)).sum(0).tolist()
            totals = [t + (h << _LOW) + v for t, h, v in zip(totals, high, low, strict=True)]
            n += len(x)
        exact = pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), exact], names=["i", "n", "s"]
        )

    return run


class Centre:
    """The mean of the fit list, held exactly: ``n``, and S = n * base + rest with 0 <= rest < n."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over coordinates of (n*x - S)^2, exact; null where 64 bits cannot hold it."""
        y = x - self.base
        rest = self.rest
        most = int(np.abs(y).max(initial=0))
        if len(rest) * max(most * most, most * self.n) >= 1 << 63:
            y, rest = y.astype(object), rest.astype(object)
        squares, products = (y * y).sum(1).astype(object), (y * rest).sum(1).astype(object)
        own = sum(r * r for r in self.rest.tolist())
        exact = self.n * self.n * squares - 2 * self.n * products + own
        return pa.array([int(e) if e < 1 << 63 else None for e in exact], pa.int64())


def _products(dims: int, centre: Centre, projection: np.ndarray | None = None):
    """A task's sum of products of centred (and projected) vectors; the last row is their plain sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = dims if projection is None else projection.shape[1]
        total = np.zeros((width + 1, width))
        for batch in batches:
            y = centre.centred(_coordinates(batch.column(0), dims))
            y = y if projection is None else y @ projection
            total[:-1] += y.T @ y
            total[-1] += y.sum(0)
        yield rows_of(total)

    return run


def _covariance(fit: DataFrame, dims: int, centre: Centre, projection: np.ndarray | None = None) -> np.ndarray:
    width = dims if projection is None else projection.shape[1]
    total = summed(fit.mapInArrow(_products(dims, centre, projection), PARTS), width + 1, width)
    off = total[-1] / centre.n  # rounding only, as vectors are centred already
    covariance = total[:-1] / centre.n - np.outer(off, off)
    return (covariance + covariance.T) / 2


_OUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: its whitened coordinate, with the fit's figures.

    Coordinates ``c`` become ``x = floor(64 * c) + 1000000``. The fit list is each distinct
    ``x`` once. ``n`` is its length, ``deviation`` the row's exact sum of ``(n*x - S)^2``
    (null beyond 64 bits), ``whitened`` the centred row on the unit eigenvector over the
    root of its eigenvalue, ``explained`` the eigenvalue's share of the trace and
    ``identity_error`` the largest entry of the whitened covariance less the identity.

    Left out are rows whose vector is null, empty, or holds a null, an entry that is not
    finite or one whose ``64 * c`` reaches 2^52; and rows whose vector has not the length
    that most distinct vectors have (of equally many the longer). A direction without
    variance cannot be whitened, so there are as many components as eigenvalues above
    ``LEAST_SHARE`` of the largest; an empty table and one of equal vectors give no rows.
    Ids are not read: rows that repeat one, or have none, are rows like all others.
    Columns other than the two are ignored. Either sign of an eigenvector may come out,
    the same for all rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id].dataType.simpleString()
    grid = vectors.select(F.col(id).alias("vec_id"), F.col(vector).alias("v")).mapInArrow(_grid, f"vec_id {kind}, x binary")
    fit = stored(grid.select("x").distinct(), "grid")
    empty = spark.createDataFrame([], f"vec_id {kind}, {_OUT}")
    sizes = fit.groupBy(F.octet_length("x").alias("bytes")).agg(F.count(F.lit(1)).alias("held"))
    most = sizes.orderBy(F.desc("held"), F.desc("bytes")).limit(1).collect()
    if not most:
        return empty
    dims = most[0].bytes // 8
    like = F.octet_length("x") == 8 * dims
    fit = fit.filter(like)
    exact = fit.mapInArrow(_sums(dims), "i int, n bigint, s decimal(38,0)").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")
    )
    exact = sorted(exact.collect())
    centre = Centre(exact[0].n, [int(r.s) for r in exact])
    covariance = _covariance(fit, dims, centre)
    values, axes = leading_eigenpairs(covariance, components)
    real = (values > LEAST_SHARE * values[0]) & (values > 0)
    values, axes = values[real], axes[:, real]
    if not len(values):
        return empty
    projection = axes / np.sqrt(values)
    error = float(np.abs(_covariance(fit, dims, centre, projection) - np.eye(len(values))).max())
    discard(fit)
    shares, k = values / np.trace(covariance), len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _coordinates(batch.column(1), dims)
            found = centre.centred(x) @ projection
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), centre.n)),
                    centre.deviation(x).take(each),
                    pa.array(found.ravel()),
                    pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(len(each), error)),
                ],
                names=["vec_id", *(c.split()[0] for c in _OUT.split(", "))],
            )

    return grid.filter(like).mapInArrow(run, f"vec_id {kind}, {_OUT}")
