"""Whitening of embeddings by their leading principal components.

Vectors are put on a grid of whole numbers, so that every sum over the table is
exact and a restarted or otherwise partitioned run gives the same bits. One pass
sums the dimensions, a second one the centred products of each task, which meet
as one number for each pair of dimensions. Only that matrix, whose size the
dimensions set and the rows don't, reaches the driver: it is tridiagonalised by
reflections, the leading eigenvalues are bisected by Sturm counts, and inverse
iteration finds their vectors. The components are broadcast, and the vectors
projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Components that are kept, at most.
COMPONENTS = 32
#: Dimensions of a vector, at most: the driver holds their matrix of doubles.
MOST_DIMENSIONS = 1_024
#: Whole numbers up to here are exact as doubles.
EXACT = 2**53
#: Eigenvalues nearer than this share of the norm are one cluster, whose vectors are kept orthogonal.
CLUSTER = 1e-3
DECIMAL = pa.decimal128(38, 0)


# --- eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder's reduction: ``diagonal, off, q`` with ``q.T @ a @ q`` tridiagonal."""
    a, n = a.astype(float).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            continue
        v = x.copy()
        v[0] += size if x[0] >= 0 else -size
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = x - 2 * v * (v @ x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: the negative terms of the Sturm sequence."""
    least = np.finfo(float).tiny * max(1.0, float(np.max(off**2, initial=0)))
    count, d = np.zeros(len(shifts), int), np.ones(len(shifts))
    for own, beside in zip(diagonal, np.concatenate([[0.0], off])):
        d = own - shifts - beside**2 / d
        d = np.where(np.abs(d) < least, -least, d)
        count += d < 0
    return count


def largest(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each by bisection down to neighbouring doubles."""
    radius = np.concatenate([np.abs(off), [0]]) + np.concatenate([[0], np.abs(off)])
    n, slack = len(diagonal), np.finfo(float).eps * (np.abs(diagonal) + radius).max()
    low, high = np.full(k, (diagonal - radius).min() - slack), np.full(k, (diagonal + radius).max() + slack)
    wanted = n - np.arange(k)  # this many lie at or below the j-th largest
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return high
        under = below(diagonal, off, middle) >= wanted
        high, low = np.where(under, middle, high), np.where(under, low, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """Solves the shifted tridiagonal system by elimination with row exchanges; a zero pivot becomes tiny."""
    n, tiny = len(diagonal), np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300)
    rows, x = [], b.astype(float).tolist()
    d, e, f = diagonal[0] - shift, off[0] if n > 1 else 0.0, 0.0
    for i in range(n - 1):
        below_, d2, e2 = off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0
        if abs(below_) > abs(d):
            m = d / below_
            rows.append((below_, d2, e2))
            x[i], x[i + 1] = x[i + 1], x[i] - m * x[i + 1]
            d, e, f = e - m * d2, f - m * e2, 0.0
        else:
            d = d if abs(d) > tiny else tiny
            m = below_ / d
            rows.append((d, e, f))
            x[i + 1] -= m * x[i]
            d, e, f = d2 - m * e, e2 - m * f, 0.0
    rows.append((d if abs(d) > tiny else tiny, 0.0, 0.0))
    for i in range(n - 1, -1, -1):
        d, e, f = rows[i]
        x[i] = (x[i] - e * (x[i + 1] if i + 1 < n else 0.0) - f * (x[i + 2] if i + 2 < n else 0.0)) / d
        if abs(x[i]) > 1e250:
            x = [v * 1e-200 for v in x]
    return np.array(x)


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Unit eigenvectors of falling ``values``, one a row, by inverse iteration; those of a cluster are made orthogonal at each round."""
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0))
    draw, found, first = np.random.default_rng(0), [], 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * norm:
            first = i
        x = draw.normal(size=len(diagonal))
        for _ in range(rounds):
            for _ in range(2):
                for other in found[first:i]:
                    x = x - (other @ x) * other
                x = x / np.linalg.norm(x)
            x = _solve(diagonal, off, value, x)
            x = x / np.abs(x).max()
        for _ in range(2):
            for other in found[first:i]:
                x = x - (other @ x) * other
            x = x / np.linalg.norm(x)
        found.append(x)
    return np.array(found).reshape(len(values), len(diagonal))


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors, one a row.

    Values that can't be told from 0 beside the largest are left out.
    """
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(a).max()
    if scale == 0:
        return np.zeros(0), np.zeros((0, len(a)))
    diagonal, off, q = tridiagonal(a / scale)
    values = largest(diagonal, off, min(k, len(a)))
    values = values[values > 4 * len(a) * np.finfo(float).eps * max(values[0], 0)]
    return values * scale, vectors_of(diagonal, off, values) @ q.T


# --- sums over the table


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _exact_total(x: np.ndarray) -> list[int]:
    """Sums of the columns as Python's integers."""
    most = int(np.abs(x).max(initial=0))
    return [int(v) for v in (x.sum(axis=0) if most * len(x) < 2**62 else x.astype(object).sum(axis=0))]


def _exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` as Python's integers: products of doubles over as many rows as stay exact."""
    most = max(1, int(np.abs(y).max(initial=0)))
    at_once = EXACT // most**2
    if not at_once:
        whole = y.astype(object)
        return whole.T @ whole
    total = np.zeros((y.shape[1],) * 2, object)
    for begin in range(0, len(y), at_once):
        part = y[begin : begin + at_once].astype(float)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _numbers(keys: list[tuple[int, int]], values: list) -> pa.RecordBatch:
    i, j = (pa.array([k[at] for k in keys], pa.int32()) for at in (0, 1))
    return pa.RecordBatch.from_arrays([i, j, pa.array([Decimal(v) for v in values], DECIMAL)], ["i", "j", "s"])


@dataclass(frozen=True)
class Whitener:
    """What a fit found: ``n`` rows, the dimensions' exact sums, eigenvalues (falling), unit components (one a row), and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def middle(self) -> np.ndarray:
        """The means, rounded to whole numbers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """n times what the rounding took from the means: at most n / 2."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]


def on_grid(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``key, x``: each component as ``floor(scale * component) + offset``, in doubles.

    Rows whose vector is null, or holds a null or a component that isn't finite,
    are left out. A component that the grid can't hold exactly (2**52 steps) raises.
    """
    whole = vectors.select(F.col(key).alias(key), F.col(column).cast("array<double>").alias("_v"))
    whole = whole.where(F.col("_v").isNotNull() & F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    step = lambda c: F.when(F.abs(c) * scale < 2.0**52, F.floor(c * scale) + offset).otherwise(F.raise_error(F.lit("a component is too large for the grid")).cast("long"))
    return whole.select(key, F.transform("_v", step).alias("x"))


def _totals(x: DataFrame) -> tuple[int, int, list[int]]:
    """The length that most vectors have (of equals, the greater), how many have it, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in batches:
            sizes = np.diff(batch.column("x").offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                own = batch.column("x").filter(pa.array(sizes == d))
                part = [len(own), *_exact_total(_matrix(own, d) if d else np.zeros((len(own), 0), np.int64))]
                held[d] = [a + b for a, b in zip(held[d], part)] if d in held else part
        for d, part in held.items():
            yield _numbers([(d, j) for j in range(d + 1)], part)

    sums = materialize(x.select("x").mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")))
    top = sums.where("j = 0").orderBy(F.desc("s"), F.desc("i")).first()
    if top is None:
        return 0, 0, []
    if top.i > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {top.i} dimensions, more than {MOST_DIMENSIONS}")
    return top.i, int(top.s), [int(r.s) for r in sums.where((F.col("i") == top.i) & (F.col("j") > 0)).orderBy("j").collect()]


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitening of ``x`` as ``on_grid`` gives it; None without rows or dimensions.

    Vectors of another length than most don't belong to the space and aren't
    counted. The covariance divides by the number of rows; vectors are centred to
    the nearest whole number before they are multiplied, and what that leaves is
    taken off exactly.
    """
    d, n, sums = _totals(x)
    if not n or not d:
        return None
    unfitted = Whitener(n, tuple(sums), np.zeros(0), np.zeros((0, d)), 0.0)
    middle, rest = unfitted.middle, unfitted.rest
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            total = total + _exact_products(_matrix(batch.column("x"), d) - middle)
        yield _numbers(pairs, [total[i, j] for i, j in pairs])

    own = x.where(F.size("x") == d).select("x").mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    v = np.zeros((d, d))
    trace = 0
    for i, j, s in own.collect():  # a number for each pair of dimensions
        exact = n * int(s) - rest[i] * rest[j]
        v[i, j] = v[j, i] = exact / n**2
        trace += exact if i == j else 0
    values, vectors = leading(v, components)
    return Whitener(n, tuple(sums), values, vectors, trace / n**2)


def whiten(x: DataFrame, model: Whitener, key: str = "vec_id") -> DataFrame:
    """``key, deviation, whitened``: the exact sum over dimensions of ``(n * x - sum)**2`` as a decimal (null beyond 38 digits), and one number for each component.

    Rows of another length than the fit's are left out. Narrow: the components are broadcast.
    """
    d, n, k = len(model.sums), model.n, len(model.values)
    middle, rest = model.middle, np.array(model.rest, object)
    projection = x.sparkSession.sparkContext.broadcast((model.components / np.sqrt(model.values)[:, None]).T)
    shift = np.array([r / n for r in model.rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column("x"), d) - middle
            made = (y - shift) @ projection.value if k else np.zeros((len(y), 0))
            most = n * int(np.abs(y).max(initial=0)) + n
            if most**2 * d < 2**63:
                apart = ((y * n - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                apart = [int(v) for v in ((y.astype(object) * n - rest) ** 2).sum(axis=1)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(made.ravel()))
            exact = pa.array([Decimal(v) if v < 10**38 else None for v in apart], DECIMAL)
            yield pa.RecordBatch.from_arrays([batch.column("key"), exact, lists], [key, "deviation", "whitened"])

    kind = dict(x.dtypes)[key]
    return x.where(F.size("x") == d).select(F.col(key).alias("key"), "x").mapInArrow(run, f"{key} {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance, less the identity: 0 without rows or components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            z = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total[0] += z.sum(axis=0)
            total[1:] += z.T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    if not k or not n:
        return 0.0
    total = np.zeros((k + 1, k))
    for i, j, s in whitened.select("whitened").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[i, j] = s
    mean = total[0] / n  # rounding alone, as the vectors are centred before they are projected
    return float(np.abs(total[1:] / n - np.outer(mean, mean) - np.eye(k)).max())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each remaining row of ``embeddings`` and each component up to 32, one row.

    Null ids and repeated rows stay, each row by itself, and count in the fit.
    Components without variance are left out, so equal vectors, a single one, and
    an empty table give no rows; so do vectors of another length than most have.
    ``deviation`` is null where a long can't hold it. Other columns are left out.
    """
    x = on_grid(table(spark, sf_dir, "embeddings"))
    model = fit(x)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    made = materialize(whiten(x, model))
    explained = F.array(*(F.lit(float(e) / model.trace) for e in model.values))
    error = identity_error(made, model.n, len(model.values))
    each = made.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
