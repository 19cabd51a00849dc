"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Entries become integers x. Two passes over the vectors give n, the sums S and the scatter around
integers near the mean; both are exact, so the covariance V is that of the whole table to the last
bit, whatever the number of tasks. Only matrices of the dimension reach the driver, never vectors.
There V = P L L' P' by pivoted Cholesky, and Jacobi rotations make the columns of the triangular
factor L orthogonal: their squared norms are the eigenvalues, the normalised columns the components.

Vectors that are null, or hold a null or a non-finite entry, are dropped. So are vectors of another
length than most have (of two lengths that are equally frequent the larger counts). Entries beyond
LIMIT in size count as LIMIT. A repeated or null vec_id is a row like others. Components beyond the
numerical rank have no variance and no rows, so equal vectors, one vector, and an empty table give
none. A deviation that does not fit a long is null. Extra columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
LIMIT = float(1 << 40)
_EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: sums over n vectors, components as columns, their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: int64, or Python integers where that is too short."""
        if self.n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(float) / self.n) @ self.components / np.sqrt(self.variances)


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * np.clip(vectors, -LIMIT, LIMIT)).astype(np.int64) + SHIFT


def usable(embeddings: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """The rows with a usable vector, and its length (0 if there is none)."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = embeddings.where(F.col(column).isNotNull() & (F.size(column) > 0) & finite)
    size = whole.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    length = size["size"] if size else 0
    return whole.where(F.size(column) == length), length


def _vectors(column: pa.Array, length: int) -> np.ndarray:
    return integers(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length))


def _exact_sums(vectors: DataFrame, length: int, of_batch, size: int) -> list[int]:
    """Sums over all vectors of the `size` integers that of_batch gives for a block of them.

    Each task sends one row an integer, in two halves that do not overflow when added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(_vectors(batch.column(0), length))
        high, low = [int(t) >> 32 for t in total], [int(t) & 0xFFFFFFFF for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["i", "high", "low"])

    added = vectors.mapInArrow(run, "i int, high bigint, low bigint").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    total = [0] * size
    for row in added.collect():
        total[row["i"]] = (row["high"] << 32) + row["low"]
    return total


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y of integers. In blocks whose sums stay below 2**53 products of doubles are exact, too."""
    largest = int(np.abs(y).max(initial=0))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    if largest >= 1 << 26:
        y = y.astype(object)
        return y.T @ y
    rows = max(1, (1 << 53) // max(1, largest * largest) - 1)
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(float)
        total += (part.T @ part).astype(np.int64)
    return total


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): a[order][:, order] = factor factor'; as many columns as the numerical rank."""
    d = len(a)
    order, factor, left = np.arange(d), np.zeros((d, d)), a.diagonal().copy()
    least = d * _EPS * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if not left[p] > least:
            return factor[:, :k], order
        for rows in (order, left, factor):
            rows[[k, p]] = rows[[p, k]]
        factor[k, k] = left[k] ** 0.5
        below = slice(k + 1, d)
        factor[below, k] = (a[order[below], order[k]] - factor[below, :k] @ factor[k, :k]) / factor[k, k]
        left[below] -= factor[below, k] ** 2
    return factor, order


def one_sided_jacobi(a: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of a, rotated in pairs until they are orthogonal.

    The pairs of a sweep come in rounds of disjoint ones, as in a tournament; a round is one step.
    """
    a = np.hstack([a, np.zeros((len(a), a.shape[1] % 2))])
    m = a.shape[1]
    seats = np.arange(m)
    for _ in range(sweeps if m else 0):
        turned = False
        for _ in range(m - 1):
            p, q = seats[: m // 2], seats[m // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > 4 * _EPS * np.sqrt(xx * yy)
            zeta = (yy - xx) / np.where(turn, 2 * xy, 1.0)
            tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = np.where(turn, 1 / np.hypot(1.0, tangent), 1.0)
            sin = np.where(turn, tangent * cos, 0.0)
            a[:, p], a[:, q] = cos * x - sin * y, sin * x + cos * y
            turned = turned or bool(turn.any())
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    return a


def decompose(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variances falling, components as columns) of the numerical rank of a covariance."""
    factor, order = pivoted_cholesky(covariance)
    columns = one_sided_jacobi(factor)
    norms = np.sqrt((columns * columns).sum(0))
    ranked = np.argsort(-norms, kind="stable")[: factor.shape[1]]
    components = np.empty((len(covariance), len(ranked)))
    components[order] = columns[:, ranked] / norms[ranked]
    return norms[ranked] ** 2, components


def fit(vectors: DataFrame, length: int, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of one usable vector column; None if nothing varies."""
    if not length:
        return None
    n, *sums = _exact_sums(vectors, length, lambda x: np.concatenate([[len(x)], x.sum(0)]).astype(object), 1 + length)
    if n == 0:
        return None
    near = np.array([s // n for s in sums], np.int64)
    i, j = np.triu_indices(length)
    products = _exact_sums(vectors, length, lambda x: exact_products(x - near)[i, j], len(i))
    rest = [s - n * int(m) for s, m in zip(sums, near)]
    covariance = np.zeros((length, length))
    scaled = [n * p - rest[a] * rest[b] for p, a, b in zip(products, i.tolist(), j.tolist())]
    covariance[i, j] = covariance[j, i] = [s / (n * n) for s in scaled]
    trace = sum(s for s, a, b in zip(scaled, i.tolist(), j.tolist()) if a == b) / (n * n)
    variances, components = decompose(covariance)
    if not len(variances):
        return None
    return Whitening(n, sums, components[:, :most], variances[:most], trace)


def identity_error(vectors: DataFrame, length: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors, less the identity.

    Each task centres its own rows; the means of the tasks are put together by sums.
    """
    k = len(model.variances)
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                rows = model.whitened(model.deviations(_vectors(batch.column(0), length)))
                middle = rows.mean(0)
                apart, m = middle - mean, n + len(rows)
                spread += (rows - middle).T @ (rows - middle) + np.outer(apart, apart) * (n * len(rows) / m)
                mean, n = mean + apart * (len(rows) / m), m
        sums = np.concatenate([n * mean, (spread + n * np.outer(mean, mean))[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["i", "v"])

    total = np.zeros(k + len(i))
    for row in vectors.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[row["i"]] = row["v"]
    mean = total[:k] / model.n
    return float(np.abs(total[k:] / model.n - mean[i] * mean[j] - (i == j)).max())


_SCHEMA = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of embeddings(vec_id, embedding).

    One row for each usable vector and component, at most `most`.
    """
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows, length = usable(embeddings)
    vectors = rows.select("embedding")
    model = fit(vectors, length, most)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], _SCHEMA.format(kind))
    error = identity_error(vectors, length, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = model.deviations(_vectors(batch.column(1), length))
                exact = apart if float(np.abs(apart.astype(float)).max()) ** 2 * length < 2.0**62 else apart.astype(object)
                squares = [int(s) if s < 1 << 63 else None for s in (exact * exact).sum(1).tolist()]
                values = pa.array(list(model.whitened(apart)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares, pa.int64()), values], names=["vec_id", "deviation", "values"])

    scored = rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, deviation bigint, values array<double>")
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.variances])
    return scored.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
