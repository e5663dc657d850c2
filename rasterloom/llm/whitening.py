"""Embedding whitening by the singular vectors of centred, distributed rows.

Entries become whole numbers x = floor(SCALE * entry) + SHIFT, so sums are exact and a row's distance to the
mean is an exact whole number over n: n * x - S, S being the sums of all rows. These rows, divided by n,
are what computeSVD decomposes: its right singular vectors are the eigenvectors of the covariance, and a
singular value squared over n is an eigenvalue. The total variance is not read off the decomposition
but summed from the exact deviations. How well the result whitens is measured on the result: its mean,
then its covariance about that mean, against the identity.

The vectors are read by row in every pass and never shuffled; tasks return one row of sums a batch, whose
size is set by the dimension. The driver holds the components, at most dimension x COMPONENTS numbers,
and Spark's matrix of inner products, dimension squared.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry take no part, nor do empty
vectors or vectors of another dimension than most have (of equally many, the larger dimension counts); null
ids take part and stay null; repeated rows count and are returned each; components without variance
(a singular value that is zero within 1e-9 of the largest) can not be scaled and are left out, so that
one row, or equal rows, give no rows; no rows give no rows. A deviation beyond the range of long is null and
stands in `deviation_digits`, a decimal, all the same. Entries beyond +-2**40 raise an error. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_memo, single_threaded

#: Entries are multiplied by SCALE, rounded down and moved by SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components returned, at most.
COMPONENTS = 32
#: Entries beyond this are an error.
LARGEST = float(1 << 40)


def usable(column: pa.ListArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that take part, their vectors in whole numbers)."""
    place = np.flatnonzero(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) == dimension)
    v = column.take(pa.array(place)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(place), dimension)
    fine = np.isfinite(v).all(1)
    v = v[fine]
    if len(v) and np.abs(v).max() > LARGEST:
        raise ValueError("an entry is beyond 2**40")
    return place[fine], (np.floor(v * SCALE) + SHIFT).astype("i8")


def dimension_of(rows: DataFrame) -> int:
    """The dimension of most rows that take part, 0 without any."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memo("whitening")
        for part in parts:
            lengths = np.unique(pc.fill_null(pc.list_value_length(part.column(0)), 0).to_numpy(zero_copy_only=False))
            told = [(int(d), len(usable(part.column(0), int(d))[0])) for d in lengths if d]
            yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], pa.int64()) for k in (0, 1)], names=["d", "n"])

    best = rows.mapInArrow(count, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), F.desc("d")).first()
    return best["d"] if best else 0


def summed(rows: DataFrame, dimension: int, part_sums: Callable[[np.ndarray], np.ndarray]) -> list:
    """The sums over all batches of part_sums(x), a vector of numbers whose length doesn't grow with the rows."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memo("whitening")
        single_threaded()
        total = None
        for part in parts:
            x = usable(part.column(0), dimension)[1]
            if len(x):
                found = part_sums(x)
                total = found if total is None else total + found
        if total is not None:
            exact = total.dtype.kind == "O"
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0)) if exact else pa.array(total, pa.float64())
            other = pa.nulls(len(total), pa.float64() if exact else pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype="i4")), *((values, other) if exact else (other, values))], names=["i", "exact", "near"])

    found = rows.mapInArrow(add, "i int, exact decimal(38,0), near double")
    sums = found.groupBy("i").agg(F.sum("exact").alias("exact"), F.sum("near").alias("near")).orderBy("i").collect()  # as many rows as a batch has sums
    return [int(r["exact"]) if r["exact"] is not None else r["near"] for r in sums]


def distances(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: long while it fits, else Python's whole numbers."""
    if n * (float(np.abs(x).max(initial=0)) + 1) * 2 < 2**62:
        return x * n - sums.astype("i8")
    return x.astype(object) * n - sums


def deviations(away: np.ndarray) -> np.ndarray:
    """The exact sum of squares of each row."""
    if away.dtype != object and len(away) and float(np.abs(away).max()) ** 2 * away.shape[1] < 2**62:
        return (away * away).sum(1)
    return (away.astype(object) ** 2).sum(1)


class Whitening:
    """What is learned: n, sums, unit components as columns, their eigenvalues, and the total variance."""

    def __init__(self, n: int, sums: np.ndarray, components: np.ndarray, eigenvalues: np.ndarray, total: float):
        self.n, self.sums, self.components, self.eigenvalues, self.total = n, sums, components, eigenvalues, total

    def whitened(self, away: np.ndarray) -> np.ndarray:
        return (away.astype("f8") / self.n) @ self.components / np.sqrt(self.eigenvalues)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from the only column of rows, the vectors; None if no component has variance."""
    dimension = dimension_of(rows)
    if not dimension:
        return None
    told = summed(rows, dimension, lambda x: np.append(x.astype(object).sum(0) if float(np.abs(x).max()) * len(x) >= 2**62 else x.sum(0).astype(object), len(x)))
    n, sums = told[-1], np.array(told[:-1], object)
    spread = summed(rows, dimension, lambda x: np.array([deviations(distances(x, n, sums)).astype(object).sum()], object))[0]
    if spread == 0:
        return None

    def centre(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            away = distances(usable(part.column(0), dimension)[1], n, sums).astype("f8") / n
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(away) + 1, dtype="i4") * dimension, pa.array(away.ravel()))], names=["v"])

    vectors = MLUtils.convertVectorColumnsFromML(rows.mapInArrow(centre, "v array<double>").select(array_to_vector("v").alias("v")), "v")
    svd = RowMatrix(vectors, n, dimension).computeSVD(min(components, dimension), computeU=False)
    values = svd.s.toArray()
    return Whitening(n, sums, svd.V.toArray()[:, : len(values)], values**2 / n, spread / n**3)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry, without sign, of the whitened rows' covariance minus the identity."""
    mean = np.array(summed(rows, len(model.sums), lambda x: model.whitened(distances(x, model.n, model.sums)).sum(0))) / model.n

    def products(x: np.ndarray) -> np.ndarray:
        w = model.whitened(distances(x, model.n, model.sums)) - mean
        return (w.T @ w).ravel()

    found = np.array(summed(rows, len(model.sums), products)).reshape(len(mean), -1) / model.n
    return float(np.abs(found - np.eye(len(mean))).max())


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error, deviation_digits."""
    vectors = df.select(F.col(vec_col).alias("v"))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits decimal(38,0)"
    model = fit(vectors, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error, explained = identity_error(vectors, model), model.eigenvalues / model.total
    names = [id_col, *(c.split()[0] for c in schema.split(", ")[1:])]

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded()
        for part in parts:
            place, x = usable(part.column(1), len(model.sums))
            away = distances(x, model.n, model.sums)
            far, many, k = deviations(away), len(place), len(explained)
            each = pa.array(np.repeat(np.arange(many), k))
            columns = [
                part.column(0).take(pa.array(place)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), many)), pa.array(np.full(many * k, model.n)),
                pa.array([int(v) if v < 2**63 else None for v in far], pa.int64()).take(each), pa.array(model.whitened(away).ravel()), pa.array(np.tile(explained, many)),
                pa.array(np.full(many * k, error)), pa.array([Decimal(int(v)) for v in far], pa.decimal128(38, 0)).take(each),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col(id_col), F.col(vec_col).alias("__vector")).mapInArrow(project, schema)
