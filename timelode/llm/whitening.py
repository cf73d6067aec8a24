"""Whitening of embeddings by a two-pass covariance.

Components become integers, so the first pass sums them exactly, whatever the order and number of tasks: it
gives the mean without error. The second pass centres every vector by that mean and adds up outer products,
one matrix product of numpy a batch; one matrix a task is merged by treeAggregate, so that the driver takes
in a few of them however many tasks there are. The symmetric eigenvectors come from LAPACK. What is sent
back to the tasks is a mean and a projection. A third pass takes the covariance of what the projection gives,
with means and products merged from task to task, and tells how far it is from the identity.

The driver and each task hold matrices of dimension x dimension; nothing there grows with the rows.

Cases: vectors that are null, empty, or hold null or non-finite components (or some beyond 2^48) are left
out, as are those of another than the commonest length (of equally common ones, the smaller); a null vec_id
stays null; repeated rows are vectors of their own; ties between eigenvalues give any basis of their space; a
component without variance has null whitened values and stays out of identity_error, and where no component
varies explained is null; a deviation beyond a long is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from timelode.llm._common import lean, small_batches, table
from timelode.llm._vectors import LONG, column_sums, finite, largest, longs, matrix, scaled, square_sums

SHIFT, COMPONENTS = 100_000, 8
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """What is fitted: exact sums, and the leading components of the covariance. Its size is that of a few vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if self.n * largest(x) + largest(self.sums) < LONG:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def varies(self) -> np.ndarray:
        """Which components have a variance beyond what rounding alone makes."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps

    def apply(self, centred: np.ndarray) -> np.ndarray:
        """The whitened values of vectors given as n * x - S; nan in components without variance."""
        varies = self.varies()
        out = np.full((len(centred), len(self.values)), np.nan)
        out[:, varies] = (centred.astype(np.float64) / self.n) @ (self.vectors[:, varies] / np.sqrt(self.values[varies]))
        return out


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in small_batches(batches):
        if batch.num_rows:
            yield batch, scaled(matrix(batch.column(column)), SHIFT)


def _merged(frame: DataFrame, merge):
    """What the tasks' rows come to under merge, in a tree; None where there are none."""
    return frame.rdd.treeAggregate(None, merge, lambda a, b: a if b is None else merge(a, b))


def _sums(vectors: DataFrame) -> tuple[int, np.ndarray] | None:
    """(number, exact sums) of the vectors of the commonest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in small_batches(batches):
            size = np.asarray(batch.column(0).value_lengths())
            for d in np.unique(size).tolist():
                x = scaled(matrix(batch.column(0).filter(pa.array(size == d))), SHIFT)
                own = seen.setdefault(d, [0, 0])
                own[0], own[1] = own[0] + len(x), own[1] + column_sums(x)
        # A sum may need more than 64 bits, and goes as decimal digits.
        yield pa.RecordBatch.from_pylist([{"d": d, "n": n, "sums": list(map(str, s))} for d, (n, s) in seen.items()], pa.schema([("d", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]))

    def merge(own: dict | None, row) -> dict:
        out = dict(own or {})
        for d, (n, s) in [(row.d, (row.n, np.array(list(map(int, row.sums)), object)))] if isinstance(row, Row) else row.items():
            m, t = out.get(d, (0, 0))
            out[d] = m + n, t + s
        return out

    by = _merged(vectors.select("embedding").mapInArrow(lean(run), "d int, n long, sums array<string>"), merge)
    if not by:
        return None
    return by[min(by, key=lambda d: (-by[d][0], d))]


def _products(vectors: DataFrame, make) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, sum of centred outer products) of make(x) over the vectors, merged pairwise with a correction for unequal means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for _, x in _blocks(batches, 0):
            y = make(x)
            mean = y.mean(axis=0)
            own = _joined(own, (len(y), mean, (y - mean).T @ (y - mean)))
        if own:
            yield pa.RecordBatch.from_pylist([{"n": own[0], "mean": own[1].tobytes(), "products": own[2].tobytes()}])

    def merge(own, row):
        return _joined(own, (row.n, np.frombuffer(row.mean), np.frombuffer(row.products).reshape(len(row.mean) // 8, -1)) if isinstance(row, Row) else row)

    return _merged(vectors.select("embedding").mapInArrow(lean(run), "n long, mean binary, products binary"), merge)


def _joined(a, b):
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows whose vectors take part, whatever their lengths."""
    e = F.col("embedding")
    return vectors.filter(finite(e) & (F.size(e) > 0)).select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding"))


def fit(good: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of usable vectors; None where there are none."""
    spark, summed = good.sparkSession, _sums(good)
    if summed is None:
        return None
    n, sums = summed
    own = good.filter(F.size("embedding") == len(sums))
    model = Whitening(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    shared = spark.sparkContext.broadcast(model)
    # The mean is exact, so products are of centred vectors; what rounding leaves of their mean is taken off at the end.
    count, _, products = _products(own, lambda x: shared.value.centred(x).astype(np.float64) / shared.value.n)
    values, basis = np.linalg.eigh(products / count)
    model.values, model.vectors, model.trace = values[::-1][:components].copy(), basis[:, ::-1][:, :components].copy(), float(np.trace(products) / count)
    varies = model.varies()
    if varies.any():
        shared = spark.sparkContext.broadcast(model)
        count, _, products = _products(own, lambda x: shared.value.apply(shared.value.centred(x))[:, varies])
        model.identity_error = float(np.abs(products / count - np.eye(int(varies.sum()))).max())
    return model


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector of vectors (vec_id, embedding) and each of the leading components."""
    spark, good = vectors.sparkSession, usable(vectors)
    model = fit(good, components)
    if model is None:
        return spark.createDataFrame([], RESULT)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.values)
        explained = own.values / own.trace if own.trace > 0 else np.full(k, np.nan)
        for batch, x in _blocks(batches, 1):
            rows, centred = len(x), own.centred(x)
            row, number = pa.array(np.repeat(np.arange(rows), k)), lambda v: pa.array(v, pa.float64(), from_pandas=True)
            columns = [batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, own.n))]
            columns += [longs(square_sums(centred)).take(row), number(own.apply(centred).ravel()), number(np.tile(explained, rows)), pa.array([own.identity_error] * (rows * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return good.filter(F.size("embedding") == len(model.sums)).mapInArrow(lean(run), RESULT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the eight leading components of their covariance, at unit variance."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
