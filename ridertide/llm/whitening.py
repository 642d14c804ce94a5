"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Entries become whole numbers, floor(64 c) + 1000000, so that equal vectors are equal bytes. The covariance is that of
the distinct vectors, taken about their mean: sums of whole numbers are exact, products are summed after centring. With
V = L L', where pivoting stops at the numerical rank, rotations make the columns of L orthogonal: their squared norms are
the eigenvalues of V, the normalised columns its eigenvectors.

The table is read three times: for the distinct vectors (one exchange of vectors, copies merged before it), for their
scatter (one row for each cell and task) and for the result. Only matrices of dimension x dimension reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ridertide.llm.arrays import flat
from ridertide.llm.tables import arrow_batches, stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Vectors of more entries are an error: their matrix is solved on the driver.
MOST_DIMENSIONS = 4096
#: Entries whose whole number needs more bits count as not finite; sums and differences stay exact below.
MOST_BITS = 52
SWEEPS = 60


@dataclass
class Whitening:
    """n vectors with the exact sums by dimension; eigenvectors as columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def middle(self) -> np.ndarray:
        """The floor of the mean: differences to it are small whole numbers."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """Sums less n times the middle, from 0 to n - 1."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        d = (x - self.middle) - self.rest / self.n
        return d @ self.vectors[:, :components] / np.sqrt(self.values[:components])


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L', the largest remaining diagonal entry first, as many columns as the numerical rank."""
    k = len(v)
    rest, columns = v.diagonal().copy(), []
    least = k * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for _ in range(k):
        pivot = int(rest.argmax())
        if rest[pivot] <= least:
            break
        column = v[:, pivot] - sum((c * c[pivot] for c in columns), np.zeros(k))
        column = column / np.sqrt(column[pivot])
        rest -= column * column
        rest[pivot] = -1.0
        columns.append(column)
    return np.array(columns).T if columns else np.zeros((k, 0))


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of factor factor', by rotating pairs of its columns.

    Each round rotates disjoint pairs at once, as in a round-robin tournament; a sweep meets every pair once."""
    a = factor.T.copy()  # one row for each column
    r = len(a)
    if r % 2:
        a = np.vstack([a, np.zeros((1, a.shape[1]))])
    seats = np.arange(len(a))
    near = len(factor) * np.finfo(float).eps
    for _ in range(SWEEPS if r > 1 else 0):
        turned = False
        for _ in range(len(a) - 1):
            p, q = seats[: len(a) // 2], seats[len(a) // 2 :][::-1]
            x, y = a[p], a[q]
            alpha, beta, gamma = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            turn = np.abs(gamma) > near * np.sqrt(alpha * beta)
            if turn.any():
                turned = True
                zeta = (beta - alpha)[turn] / (2 * gamma[turn])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                a[p[turn]] = c[:, None] * x[turn] - s[:, None] * y[turn]
                a[q[turn]] = s[:, None] * x[turn] + c[:, None] * y[turn]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    values = (a * a).sum(1)
    order = np.argsort(-values, kind="stable")[:r]
    vectors = a[order] / np.sqrt(values[order])[:, None]
    # The entry of largest size is positive, so that runs agree.
    lead = vectors[np.arange(r), np.abs(vectors).argmax(1)]
    return values[order], (vectors * np.where(lead < 0, -1.0, 1.0)[:, None]).T


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers of all entries, offsets by row, which rows are whole): null vectors are empty and not whole."""
    lists = column.cast(pa.large_list(pa.float64()))
    lengths = np.asarray(pa.compute.list_value_length(lists).fill_null(0), np.int64)
    c = np.asarray(lists.flatten().fill_null(np.nan), np.float64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * c)
    bad = ~(np.abs(scaled) < 2.0**MOST_BITS)
    before = np.concatenate([[0], np.cumsum(bad)])
    whole = (before[offsets[1:]] == before[offsets[:-1]]) & np.asarray(column.is_valid())
    return np.where(bad, 0.0, scaled).astype(np.int64) + SHIFT, offsets, whole


def vectors_of(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the rows with a whole vector of that dimension, their whole numbers as a matrix)."""
    x, offsets, whole = entries(column)
    rows = np.flatnonzero(whole & (np.diff(offsets) == dimension))
    return rows, x[(offsets[rows][:, None] + np.arange(dimension)).astype(np.int64)].reshape(len(rows), dimension)


def packed(binary: pa.Array, dimension: int) -> np.ndarray:
    """The matrix of vectors that were written as bytes."""
    return flat(binary)[0].view(np.int64).reshape(-1, dimension)


def dimension_of(rows: DataFrame, vector: str) -> int:
    """The number of entries that most vectors have, the smaller of two that tie; 0 without a vector."""
    sizes = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("k")).count().where("k > 0")
    first = sizes.orderBy(F.desc("count"), "k").first()
    if first and first.k > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {first.k} entries, more than {MOST_DIMENSIONS}")
    return first.k if first else 0


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct whole vectors of rows; None without one."""
    arrow_batches(rows.sparkSession)
    k = dimension_of(rows, vector)

    def quantized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = vectors_of(batch.column(0), k)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], ["x"])

    fit_list = stage(rows.select(vector).mapInArrow(quantized, "x binary").distinct())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(k, np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            x = packed(batch.column(0), k)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            columns = [np.arange(k, dtype=np.int32), high, low, np.full(k, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "high", "low", "n"])

    if not k:
        return None
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]
    totals = fit_list.mapInArrow(summed, "i int, high long, low long, n long").groupBy("i").agg(*exact).orderBy("i").collect()
    if not totals:
        return None
    model = Whitening(int(totals[0].n), [(int(t.high) << 32) + int(t.low) for t in totals], np.empty(0), np.empty((k, 0)), 0.0)

    v = scatter(fit_list, k, lambda x: (x - model.middle) - model.rest / model.n, k) / model.n
    model.trace = float(v.trace())
    model.values, model.vectors = jacobi(pivoted_cholesky(v))
    m = min(components, len(model.values))
    if m:
        means = scatter(fit_list, k, lambda x: np.hstack([model.whitened(x, m), np.ones((len(x), 1))]), m + 1) / model.n
        mean = means[m, :m]
        model.identity_error = float(np.abs(means[:m, :m] - np.outer(mean, mean) - np.eye(m)).max())
    return model


def scatter(fit_list: DataFrame, k: int, centred, width: int) -> np.ndarray:
    """The sum of the outer products of centred(x) over the fit list: a row for each cell above the diagonal and task."""
    i, j = np.triu_indices(width)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width)), False
        for batch in batches:
            d = centred(packed(batch.column(0), k))
            total += d.T @ d
            some = True
        if some:
            columns = [i.astype(np.int32), j.astype(np.int32), total[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "v"])

    cells = fit_list.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width))
    a, b, value = (cells.column(c).to_numpy() for c in ("i", "j", "v"))
    out[a, b] = value
    out[b, a] = value
    return out


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """The sums of (n x - S) squared by row, exact; None beyond a long."""
    u, n = x - model.middle, model.n
    most = int(np.abs(u).max(initial=0)) * n + n
    if most * most * x.shape[1] < 1 << 63:
        return ((u * n - model.rest) ** 2).sum(1).tolist()
    sums = [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, model.rest, strict=True)) for row in u]
    return [s if s < 1 << 63 else None for s in sums]


def whitened(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(the rows with a whole vector, with `whitened` (array of up to `components` numbers) and `deviation` (long) added,
    the fitted whitening).

    Rows go whose vector is null, has a null, NaN or infinite entry or one whose whole number needs more than 52 bits,
    or has not as many entries as most vectors have. Repeated rows stay, each with the same numbers; they count once in
    the fit. Components end at the numerical rank: equal vectors alone have none. An empty table gives an empty table
    and no whitening. Columns named `whitened` or `deviation` are replaced, all others are kept. A deviation beyond a
    long is null."""
    spark = rows.sparkSession
    rows = rows.select(*[c for c in rows.columns if c not in ("whitened", "deviation")])
    model = fit(rows, vector, components)
    added = [StructField("whitened", ArrayType(DoubleType(), False)), StructField("deviation", LongType())]
    schema = StructType([*rows.schema.fields, *added])
    if model is None:
        return spark.createDataFrame([], schema), None
    shared, m = spark.sparkContext.broadcast(model), min(components, len(model.values))
    place = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            kept, x = vectors_of(batch.column(place), len(w.sums))
            values = pa.array(w.whitened(x, m).ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * m, pa.int32()), values)
            out = batch.take(pa.array(kept))
            columns = [*out.columns, lists, pa.array(deviations(x, w), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "whitened", "deviation"])

    return rows.mapInArrow(run, schema), model


def components_of(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each whole vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    out, model = whitened(rows.select(key, vector), vector, components)
    n, error = (model.n, model.identity_error) if model else (0, 0.0)
    shares = [float(e / model.trace) for e in model.values[:components]] if model and model.trace else []
    each = out.select(key, "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("place") + 1) if shares else F.lit(0.0)
    return each.select(
        key,
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
