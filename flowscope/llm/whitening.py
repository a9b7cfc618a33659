"""Whitening of embeddings by refined eigenvectors of their covariance.

Entries become whole numbers, so that counts, sums and products over all rows are exact,
whatever the number of partitions. Each different vector counts once. The covariance is
added up where the data lie: whole-number means are taken off before multiplying, and only
sums for each pair of dimensions reach the driver.

Its eigenvectors come from a single-precision solver and are corrected by the iteration of
Ogita and Aishima, which is matrix products only, in extended precision. Eigenvalues closer
than the iteration can tell apart form a cluster: of it the iteration finds the space, and a
small solve inside that space, shifted by the cluster's mean, finds the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.sizing import stored

#: an entry c counts as floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
#: entries from here on have no whole number of 64 bits; they count as not finite
LARGEST = 2.0 ** 56
#: components of a result
COMPONENTS = 16
#: entries worked on at once, and entries that are worth a task with sums of its own
SLICE, TASK = 2_000_000, 8_000_000
#: steps of the iteration, which ends earlier when nothing changes any more
STEPS = 16

_HIGH = np.longdouble


@dataclass
class Whitening:
    """What is learned from the vectors of one length; vectors are whole numbers less ``SHIFT``."""

    n: int
    sums: list[int]
    centre: np.ndarray  # whole-number means
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # a unit eigenvector in each column
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def rest(self) -> np.ndarray:
        """The part of each sum that the whole-number means leave, from 0 to n - 1."""
        return np.array([s - self.n * int(m) for s, m in zip(self.sums, self.centre)], np.float64)

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        """Rows on the first components, NaN on those that have no variance."""
        values, axes = self.values[:COMPONENTS], self.axes[:, :COMPONENTS]
        centred = (rows - self.centre).astype(np.float64) - self.rest / self.n
        has = values > 0
        return np.where(has, (centred @ axes) / np.sqrt(np.where(has, values, 1.0)), np.nan)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n * x - S) ** 2, exactly; null where 64 bits do not hold it."""
        centred, rest = rows - self.centre, self.rest.astype(np.int64)
        most = self.n * (int(np.abs(centred).max(initial=0)) + 1)
        if most * most * rows.shape[1] < 2 ** 63:
            return ((self.n * centred - rest) ** 2).sum(1).tolist()
        exact = ((self.n * centred.astype(object) - rest.astype(object)) ** 2).sum(1).tolist()
        return [x if x < 2 ** 63 else None for x in exact]


# --- whole numbers ---------------------------------------------------------------------------


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and whole numbers of the vectors that count, for each length by itself.

    A vector that is null, empty, or holds null or non-finite entries does not count.
    """
    sizes = column.value_lengths().fill_null(0).to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # a null entry is NaN
    bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < LARGEST))])
    good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    for size in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == size))
        step = max(1, SLICE // size)
        for i in range(0, len(rows), step):
            some = rows[i:i + step]
            yield some, np.floor(flat[(ends[some] - size)[:, None] + np.arange(size)] * SCALE).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as bytes, in the fewest bytes an entry that hold it, so that equal vectors are equal."""
    for batch in batches:
        for _, rows in _matrices(batch.column("vector")):
            most = np.maximum(rows.max(1), ~rows.min(1))
            low = -1
            for width in (1, 2, 4, 8):
                high = 2 ** (8 * width - 1) - 1
                some = rows[(most > low) & (most <= high)].astype(f"<i{width}")
                low = high
                if len(some):
                    yield pa.RecordBatch.from_pydict({
                        "dims": pa.array(np.full(len(some), rows.shape[1], np.int32)),
                        "packed": pa.array([x.tobytes() for x in some], pa.binary())})


def _unpacked(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        by_width: dict[int, list[bytes]] = {}
        for packed in batch.column("packed").to_pylist():
            by_width.setdefault(len(packed) // dims, []).append(packed)
        for width, some in by_width.items():
            step = max(1, SLICE // dims)
            for i in range(0, len(some), step):
                rows = np.frombuffer(b"".join(some[i:i + step]), f"<i{width}")
                yield rows.reshape(-1, dims).astype(np.int64)


def _exact_product(rows: np.ndarray) -> np.ndarray:
    """rows.T @ rows without rounding; floats are exact while all sums stay below 2 ** 53."""
    most = int(np.abs(rows).max(initial=0))
    if most * most * len(rows) < 2 ** 53:
        wide = rows.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    wide = rows.astype(object)
    return wide.T @ wide


def _totals(vectors: DataFrame, dims: int, cells: int, add: Callable, kind: str) -> list:
    """Per cell the sum of what ``add`` makes of blocks of rows, added up in each partition first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for rows in _unpacked(batches, dims):
            part = add(rows)
            total = part if total is None else total + part
        if total is not None:
            values = [Decimal(int(x)) for x in total] if kind == "decimal(38,0)" else total.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(cells, dtype=np.int32)),
                 pa.array(values, pa.decimal128(38, 0) if kind == "decimal(38,0)" else pa.float64())],
                names=["cell", "value"])

    found = (
        vectors.mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect())
    sums = [0] * cells
    for row in found:
        sums[row.cell] = int(row.value) if kind == "decimal(38,0)" else row.value
    return sums


# --- eigenvectors ----------------------------------------------------------------------------


def refined_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix.

    The matrix may have more than double precision; the result is rounded to doubles.
    """
    size = len(matrix)
    largest = float(np.abs(matrix).max(initial=0))
    if not largest:
        return np.zeros(size), np.eye(size)
    a = matrix.astype(_HIGH) / _HIGH(2.0 ** np.frexp(largest)[1])  # a power of two, so nothing is rounded
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(_HIGH)
    size_a, best = np.sqrt((a * a).sum()), np.inf
    for _ in range(STEPS):
        x, change = _step(a, x, size_a)
        if change < np.finfo(np.float64).eps / 8 or change >= best < 1e-12:
            break
        best = min(best, change)
    values = (x * (a @ x)).sum(0) / (x * x).sum(0)
    order = np.argsort(-values, kind="stable")
    axes = (x / np.sqrt((x * x).sum(0)))[:, order]
    return (values[order] * _HIGH(2.0 ** np.frexp(largest)[1])).astype(np.float64), axes.astype(np.float64)


def _step(a: np.ndarray, x: np.ndarray, size_a) -> tuple[np.ndarray, float]:
    """One step of the iteration and its largest correction, sub-solves included."""
    r = np.eye(len(a), dtype=_HIGH) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    # what the present errors can hide: eigenvalues closer than this are not told apart
    width = 2 * (np.sqrt((off * off).sum()) + size_a * np.sqrt((r * r).sum()))
    gaps = values[None, :] - values[:, None]
    near = np.abs(gaps) <= width
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gaps))
    correction = x @ e
    x = x + correction
    turned = 0.0
    for members in _clusters(values, width):
        x[:, members], angle = _solved(a, x[:, members], size_a)
        turned = max(turned, angle)
    return x, max(float(np.abs(correction).max()), turned)


def _clusters(values: np.ndarray, width) -> list[np.ndarray]:
    """Members of each run of eigenvalues whose neighbours are at most ``width`` apart."""
    order = np.argsort(values)
    borders = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [part for part in np.split(order, borders) if len(part) > 1]


def _solved(a: np.ndarray, basis: np.ndarray, size_a) -> tuple[np.ndarray, float]:
    """A cluster's vectors inside the space of ``basis``, and how far they turned.

    The shift leaves the differences of the eigenvalues only, which a solver then sees at
    their own scale. Without differences beyond rounding any basis will do.
    """
    shift = (basis * (a @ basis)).sum() / (basis * basis).sum()
    small = basis.T @ (a @ basis) - shift * (basis.T @ basis)
    small = (small + small.T) / 2
    off = np.abs(small - np.diag(np.diag(small))).max()
    if off <= 16 * np.finfo(_HIGH).eps * size_a * np.sqrt(_HIGH(len(small))):
        return basis, 0.0
    turn = np.linalg.eigh((small / np.abs(small).max()).astype(np.float64))[1].astype(_HIGH)
    # the solver's vectors are unit vectors to double precision; the next step mends the rest
    return basis @ turn, float(off / np.abs(small).max())


# --- learning and applying -------------------------------------------------------------------


def _covariance(n: int, sums: list[int], centre: list[int], products: np.ndarray) -> list[list[Fraction]]:
    """From sums over the rows of products of entries less whole-number means, exactly."""
    dims, rest = len(sums), [s - n * m for s, m in zip(sums, centre)]
    return [
        [Fraction(n * products[i, j] - rest[i] * rest[j], n * n) for j in range(dims)] for i in range(dims)]


def _squared(cells: list, dims: int, kind: type) -> np.ndarray:
    """The symmetric matrix of its upper triangle."""
    whole, upper = np.empty((dims, dims), kind), np.triu_indices(dims)
    whole[upper] = cells
    whole.T[upper] = cells
    return whole


def _high(x: Fraction):
    """A fraction as the sum of its double and the double of what that leaves."""
    whole = float(x)
    return _HIGH(whole) + _HIGH(float(x - Fraction(whole)))


def _learned(vectors: DataFrame, dims: int, n: int) -> Whitening:
    """From ``n`` different vectors of one length."""
    sums = _totals(vectors, dims, dims, lambda rows: rows.astype(object).sum(0), "decimal(38,0)")
    means = [s // n for s in sums]
    centre = np.array(means, np.int64)
    upper = np.triu_indices(dims)
    products = _totals(
        vectors, dims, len(upper[0]), lambda rows: _exact_product(rows - centre)[upper], "decimal(38,0)")
    covariance = _covariance(n, sums, means, _squared(products, dims, object))
    values, axes = refined_eigen(np.array([[_high(x) for x in row] for row in covariance], _HIGH).reshape(dims, dims))
    # below the rounding of the largest one an eigenvalue is no variance
    values = np.where(values > dims * np.finfo(np.float64).eps * values[0], values, 0.0)
    trace = float(sum(covariance[i][i] for i in range(dims)))
    explained = [float(v) / trace if trace else None for v in values[:COMPONENTS]]
    model = Whitening(n, sums, centre, values, axes, explained)
    model.identity_error = _identity_error(vectors, dims, model)
    return model


def _identity_error(vectors: DataFrame, dims: int, model: Whitening) -> float | None:
    """The largest entry of the covariance of what the fitted vectors become, less the identity.

    Measured on all of them, about their measured means; components without variance are
    left out. Null if there is none with variance.
    """
    k = int((model.values[:COMPONENTS] > 0).sum())
    if not k:
        return None
    white = lambda rows: model.whitened(rows)[:, :k]
    means = np.array(_totals(vectors, dims, k, lambda rows: white(rows).sum(0), "double")) / model.n

    upper = np.triu_indices(k)

    def products(rows):
        centred = white(rows) - means
        return (centred.T @ centred)[upper]

    found = _squared(_totals(vectors, dims, len(upper[0]), products, "double"), k, np.float64) / model.n
    return float(np.abs(found - np.eye(k)).max())


def fit(vectors: DataFrame, vector: str = "embedding") -> dict[int, Whitening]:
    """What whitens the vectors of each length.

    Each different vector counts once, by its whole numbers. Null and empty vectors, and
    those with null or non-finite entries (also those of 2 ** 56 and more, which have no
    whole number), do not count. Vectors of different lengths are learned from separately.
    A table without any that counts gives no entry.
    """
    columns = vectors.select(F.col(vector).cast("array<double>").alias("vector"))
    different = stored(columns.mapInArrow(_pack, "dims int, packed binary").distinct())
    numbers = {r.dims: r["n"] for r in different.groupBy("dims").agg(F.count("*").alias("n")).collect()}

    def of_length(dims: int) -> DataFrame:
        # a task's sums are as many numbers as pairs of dimensions, whatever its rows are
        tasks = -(-numbers[dims] * dims // TASK)
        return different.filter(F.col("dims") == dims).select("packed").coalesce(tasks)

    return {dims: _learned(of_length(dims), dims, n) for dims, n in sorted(numbers.items())}


def _apply(models: dict[int, Whitening]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, rows in _matrices(batch.column("vector")):
                model = models[rows.shape[1]]
                white = model.whitened(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(places)),
                     pa.array(np.full(len(rows), model.n)),
                     pa.array(model.deviations(rows), pa.int64()),
                     pa.ListArray.from_arrays(
                         pa.array(np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1]),
                         pa.array(white.reshape(-1), pa.float64(), from_pandas=True)),
                     pa.array([model.explained] * len(rows), pa.list_(pa.float64())),
                     pa.array([model.identity_error] * len(rows), pa.float64())],
                    names=["key", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, models: dict[int, Whitening], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per vector that counts (see ``fit``): ``key``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``whitened`` and ``explained`` have an entry for each component, of which there are as
    many as dimensions but ``COMPONENTS`` at most. On a component without variance the
    whitened entry is null; ``explained`` is null where no component has any. ``n`` is the
    number of different vectors of the length, ``deviation`` the sum over the dimensions of
    (n * x - S) ** 2, null where 64 bits do not hold it. Rows keep their multiplicity, null
    keys included; other columns do not matter. ``models`` has to come from the same table.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    schema = (
        f"key {rows.schema['key'].dataType.simpleString()}, n long, deviation long, whitened array<double>, "
        "explained array<double>, identity_error double")
    return rows.mapInArrow(_apply(models), schema).withColumnRenamed("key", key)
