"""Whitening of embeddings: the leading components of their covariance, scaled to unit variance.

Spark sums the covariance over the distinct quantised vectors. What reaches the
driver are its ``d * (d + 1) / 2`` numbers, however many vectors there are: it
is brought to tridiagonal form by Householder reflections, its leading
eigenvalues are found by bisection on Sturm counts and its vectors by inverse
iteration, those of close eigenvalues made orthogonal. The components, ``k * d``
numbers, go back to the tasks that project the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsengine.llm.frames import cut, fresh, prepare_workers

#: Steps of the grid that entries are rounded down to, and components asked for.
GRID, COMPONENTS = 256, 4
#: Eigenvalues closer than this part of the matrix's norm are one cluster.
CLUSTER = 1e-3
EPS = float(np.finfo(float).eps)
LOW = (1 << 22) - 1


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, reflectors) of the symmetric ``a``; column k of ``reflectors`` is the k-th unit Householder vector."""
    a = a.copy()
    n = len(a)
    hold = np.zeros((n, max(n - 2, 0)))
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        if scale == 0 or not np.abs(x[1:]).max():
            continue
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        hold[k + 1 :, k] = v
        rest = a[k + 1 :, k + 1 :]
        p = 2 * (rest @ v)
        p -= v * (v @ p)
        rest -= np.outer(v, p) + np.outer(p, v)
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), hold


def sturm_counts(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie under each of ``at``: the negative pivots of its shifts."""
    tiny = max(EPS * EPS * max(np.abs(d).max(), np.abs(e).max(initial=0.0)), np.finfo(float).tiny)
    q = d[0] - at
    below = (q < 0).astype(int)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[k] - at - e[k - 1] ** 2 / q
        below += q < 0
    return below


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each halved down to neighbouring doubles of the matrix's norm."""
    n = len(d)
    side = np.concatenate([[0.0], np.abs(e)]) + np.concatenate([np.abs(e), [0.0]])
    norm = max(np.abs(d - side).max(), np.abs(d + side).max(), np.finfo(float).tiny)
    low = np.full(k, (d - side).min() - EPS * norm)
    high = np.full(k, (d + side).max() + EPS * norm)
    rank = n - np.arange(k)  # the k-th largest has this many eigenvalues at or under it
    while True:
        mid = (low + high) / 2
        if np.all((high - low <= EPS * norm / 4) | (mid <= low) | (mid >= high)):
            return mid
        over = sturm_counts(d, e, mid) >= rank
        low, high = np.where(over, low, mid), np.where(over, mid, high)


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift) x = b by elimination with row exchanges; pivots under ``least`` count as ``least``."""
    n = len(d)
    diag, up, up2, b = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    low = e.copy()
    for k in range(n - 1):
        if abs(low[k]) > abs(diag[k]):  # exchange rows k and k + 1
            diag[k], low[k] = low[k], diag[k]
            up[k], diag[k + 1] = diag[k + 1], up[k]
            up2[k], up[k + 1] = up[k + 1], 0.0
            b[k], b[k + 1] = b[k + 1], b[k]
        if abs(diag[k]) < least:
            diag[k] = least
        f = low[k] / diag[k]
        diag[k + 1] -= f * up[k]
        up[k + 1] -= f * up2[k]
        b[k + 1] -= f * b[k]
    if abs(diag[-1]) < least:
        diag[-1] = least
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x[k] = (b[k] - (up[k] * x[k + 1] if k + 1 < n else 0.0) - (up2[k] * x[k + 2] if k + 2 < n else 0.0)) / diag[k]
    return x


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors of the falling ``values`` as columns; those of one cluster are kept orthogonal in every round."""
    n, k = len(d), len(values)
    norm = max(np.abs(d).max() + 2 * np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    out, first = np.zeros((n, k)), 0
    rng = np.random.default_rng(1)
    shift = values.astype(float)
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * norm:
            first = j
        if j > first:  # equal shifts would give one vector again
            shift[j] = min(shift[j], shift[j - 1] - 10 * EPS * norm)
        x = rng.uniform(0.5, 1.5, n)
        for _ in range(rounds):
            x = solve_shifted(d, e, shift[j], x / np.linalg.norm(x), EPS * norm)
            x /= np.abs(x).max()
            for _twice in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            if not np.abs(x).max():
                x = rng.uniform(0.5, 1.5, n)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading_components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``k`` largest eigenvalues of a symmetric matrix, falling."""
    k, scale = min(k, len(cov)), float(np.abs(cov).max())
    if scale == 0:
        return np.zeros(k), np.eye(len(cov), k)
    d, e, hold = tridiagonal(cov / scale)
    values = leading_eigenvalues(d, e, k)
    vectors = inverse_iteration(d, e, values)
    for j in range(hold.shape[1] - 1, -1, -1):
        v = hold[:, j : j + 1]
        vectors -= 2 * v @ (v.T @ vectors)
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)


@dataclass(frozen=True)
class Whitener:
    """``n`` fitted vectors with sums ``total``; column j of ``scaled`` is component j + 1 over the root of its eigenvalue."""

    n: int
    total: tuple[int, ...]
    scaled: np.ndarray
    explained: tuple[float | None, ...]
    identity_error: float | None


def usable(vec: Column) -> Column:
    """Whether a vector is there, with entries that are all there and finite."""
    entry = vec.cast("array<double>")
    bad = F.exists(entry, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & ~bad, F.lit(False))


def gridded(vec: Column, grid: int = GRID) -> Column:
    return F.transform(vec.cast("array<double>"), lambda x: F.floor(x * grid))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def offsets(x: np.ndarray, n: int, total: tuple[int, ...]) -> np.ndarray:
    """n * x - total, in integers of any size where 64 bits do not hold them."""
    widest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    wide = widest * n + max(map(abs, total), default=0) >= 2**62
    return x.astype(object) * n - np.array(total, object) if wide else x * n - np.array(total, np.int64)


def centred(x: np.ndarray, n: int, total: tuple[int, ...]) -> np.ndarray:
    return offsets(x, n, total).astype(float) / n


def summed(fit: DataFrame, dims: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all vectors of the matrices that ``rows_of`` gives for those of one Arrow batch.

    Each task sends the rows of its own sum; those of one row number meet and
    are added one after the other, so the driver gets one matrix.
    """
    like = rows_of(np.zeros((1, dims), np.int64))
    kind, item = (pa.int64(), "bigint") if like.dtype.kind == "i" else (pa.float64(), "double")

    def batch(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate([*held.values(), like[:0].ravel()])
        v = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * like.shape[1], pa.int32()), pa.array(flat, kind))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), v], names=["k", "v"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros_like(like)
        for b in batches:
            if b.num_rows:
                held = held + rows_of(matrix(b.column(0), dims))
        if held.any():
            yield batch(dict(enumerate(held)))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), matrix(b.column(1), like.shape[1]), strict=True):
                held[k] = held[k] + v if k in held else v
        yield batch(held)

    schema = f"k int, v array<{item}>"
    out = np.zeros_like(like)
    for row in fit.mapInArrow(own, schema).repartition("k").mapInArrow(together, schema).collect():
        out[row["k"]] = row["v"]
    return out


def fit_whitener(vectors: DataFrame, vec: str = "embedding", k: int = COMPONENTS, grid: int = GRID) -> Whitener | None:
    """Components of the distinct gridded vectors of ``vectors``; None if there are none.

    The vectors of the most frequent length count (at a tie the longer one).
    Each pass reads the distinct vectors and gives the driver at most d * d
    numbers, d the vectors' length.
    """
    prepare_workers(vectors.sparkSession)
    # Repeated vectors, however many, meet in the task that reads them before they are shuffled.
    every = cut(vectors.where(usable(F.col(vec))).select(gridded(F.col(vec), grid).alias("x")).distinct())
    lengths = every.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).where("dims > 0").orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return None
    dims, n = lengths[0]["dims"], lengths[0]["n"]
    fit = every.where(F.size("x") == dims)
    # The bits of the entries in three parts: their sums stay within 64 bits for 2^41 vectors.
    parts = summed(fit, dims, lambda x: np.array([(x >> 44).sum(axis=0), (x >> 22 & LOW).sum(axis=0), (x & LOW).sum(axis=0)]))
    total = tuple((int(a) << 44) + (int(b) << 22) + int(c) for a, b, c in parts.T)
    cov = summed(fit, dims, lambda x: (c := centred(x, n, total)).T @ c) / n
    cov = (cov + cov.T) / 2
    values, components = leading_components(cov, k)
    trace = float(np.trace(cov))
    real = values > dims * EPS * max(trace, 0.0)
    scaled = np.where(real, components / np.sqrt(np.where(real, values, 1.0)), np.nan)
    good = np.flatnonzero(real)
    error = None
    if len(good):
        w = scaled[:, good]
        mean = summed(fit, dims, lambda x: (centred(x, n, total) @ w).sum(axis=0, keepdims=True))[0] / n
        found = summed(fit, dims, lambda x: (y := centred(x, n, total) @ w - mean).T @ y)
        error = float(np.abs(found / n - np.eye(len(good))).max())
    return Whitener(n, total, scaled, tuple(float(v) / trace if trace > 0 else None for v in values), error)


def whiten(vectors: DataFrame, model: Whitener | None, vec: str = "embedding", keep: list[str] | None = None, grid: int = GRID) -> DataFrame:
    """A row for each usable vector of the fitted length and each component.

    Columns: ``keep``, component (from 1), n, deviation (null where 64 bits do
    not hold it), whitened, explained and identity_error. A component of no
    variance has null ``whitened``. Null vectors, those with null or
    non-finite entries and those of another length give no row, and without a
    model there are none.
    """
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = dict(zip(names, ["int", "bigint", "bigint", "double", "double", "double"], strict=True))
    keep = [c for c in (vectors.columns if keep is None else keep) if c.lower() not in names]
    if model is None:
        return vectors.where("1 = 0").select(*keep, *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    dims, parts = model.scaled.shape
    n, total, scaled, explained, error = model.n, model.total, model.scaled, model.explained, model.identity_error
    grids = fresh(vectors, "x")
    given = vectors.where(usable(F.col(vec)) & (F.size(vec) == dims)).select(*keep, gridded(F.col(vec), grid).alias(grids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(len(keep)), dims)
            far = offsets(x, n, total)
            if far.dtype != object and max(int(far.max()), -int(far.min())) ** 2 * dims >= 2**63:
                far = far.astype(object)
            squares = [int(v) if v < 2**63 else None for v in (far * far).sum(axis=1)]
            white = (far.astype(float) / n) @ scaled
            rows = np.repeat(np.arange(b.num_rows), parts)
            kept = [b.column(i).take(pa.array(rows)) for i in range(len(keep))]
            tile = lambda v, kind: pa.array(list(v) * b.num_rows, kind)  # noqa: E731, B023
            made = [tile(range(1, parts + 1), pa.int32()), tile([n] * parts, pa.int64()), pa.array(squares, pa.int64()).take(pa.array(rows))]
            made += [pa.array(white.ravel(), pa.float64(), from_pandas=True), tile(explained, pa.float64()), tile([error] * parts, pa.float64())]
            yield pa.RecordBatch.from_arrays(kept + made, names=[*keep, *names])

    prepare_workers(vectors.sparkSession)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.drop(grids).schema] + [f"{c} {kinds[c]}" for c in names]
    return given.mapInArrow(run, ", ".join(columns))
