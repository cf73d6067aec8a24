"""Many logistic regressions at once: every model of a study takes a step in the same job.

A study fits tasks x sizes x replicates x penalties. Its samples overlap, so each row of features is kept once,
with the samples that it is in; a model is a sample and a penalty. A step sends the models' weights out, and one
aggregate over the rows brings back the loss and gradient of all of them, merged from task to task in a tree.
The driver keeps a limited-memory BFGS state for each model, a few vectors, and models that have converged
drop out of later steps. So the number of jobs is that of the slowest model, not of all models together.

The objective is that of pyspark.ml's LogisticRegression without standardisation: mean loss plus half of
1 / (C n) times the squared weights, with a free intercept; features are divided by their greatest absolute value in
the sample, as MaxAbsScaler does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Rows whose margins under all models a task holds at a time.
BATCH = 256
MEMORY, MOST_STEPS, TOLERANCE = 10, 400, 1e-9


def grouped(rows: DataFrame, samples: DataFrame, ident: tuple[str, ...]) -> DataFrame:
    """(ident, idx, val, parts): feature rows (ident, idx, val) with the samples that they are in, from samples (ident, sample, weight, y). Rows in no sample are left out."""
    parts = samples.groupBy(*ident).agg(F.sort_array(F.collect_list(F.struct("sample", F.col("weight").cast("double").alias("weight"), F.col("y").cast("double").alias("y")))).alias("parts"))
    return rows.select(*ident, F.col("idx").cast("array<int>").alias("idx"), F.col("val").cast("array<double>").alias("val")).join(parts, list(ident))


def _batches(batches: Iterator[pa.RecordBatch]):
    """(lengths, idx, val, row, sample, weight, y) of the batches' rows and memberships."""
    for whole in batches:
        for a in range(0, whole.num_rows, BATCH):
            b = whole.slice(a, BATCH)
            idx, val, parts = b.column(0), b.column(1), b.column(2)
            p = parts.flatten()
            yield np.asarray(idx.value_lengths()).astype(np.int64), np.asarray(idx.flatten()), np.asarray(val.flatten()), np.repeat(np.arange(len(parts)), np.asarray(parts.value_lengths())), *(np.asarray(p.field(k)) for k in range(3))


def _summed(data: DataFrame, make, shape: tuple[int, ...], merge=np.add) -> np.ndarray:
    """The arrays that make gives for the tasks' batches, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in _batches(batches):
            own = make(*b) if own is None else merge(own, make(*b))
        if own is not None:
            yield pa.RecordBatch.from_pylist([{"v": own.tobytes()}])

    def joined(own, other):
        other = np.frombuffer(other.v).reshape(shape) if isinstance(other, Row) else other
        return other if own is None else own if other is None else merge(own, other)

    out = data.select("idx", "val", "parts").mapInArrow(run, "v binary").rdd.treeAggregate(None, joined, joined)
    return np.zeros(shape) if out is None else out


def _by_feature(length: np.ndarray, idx: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """Add values (entries x models) to the rows of out that idx names."""
    order = np.argsort(idx, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(idx[order]) != 0)) if len(idx) else np.zeros(0, int)
    if len(first):
        out[idx[order][first]] += np.add.reduceat(values[order], first, axis=0)


@dataclass
class Models:
    """The fitted models: sample, penalty and weights (the intercept last), on unscaled features."""

    sample: np.ndarray
    penalty: np.ndarray
    weight: np.ndarray
    converged: np.ndarray
    #: Jobs that steps took.
    jobs: int = 0
    n: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, rows: DataFrame, ident: list[str]) -> DataFrame:
        """ident, model and pred of rows (ident, idx, val): the probability of class 1 under every model."""
        shared = rows.sparkSession.sparkContext.broadcast(self.weight)
        fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*ident).dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            for whole in batches:
                for a in range(0, whole.num_rows, BATCH):
                    b = whole.slice(a, BATCH)
                    idx, val = b.column(len(ident)), b.column(len(ident) + 1)
                    margin = _margins(np.asarray(idx.value_lengths()).astype(np.int64), np.asarray(idx.flatten()), np.asarray(val.flatten()), w)
                    row = pa.array(np.repeat(np.arange(b.num_rows), len(w)))
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in range(len(ident))), pa.array(np.tile(np.arange(len(w), dtype=np.int32), b.num_rows)), pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))).ravel())], [*ident, "model", "pred"])

        return rows.select(*ident, F.col("idx").cast("array<int>").alias("idx"), F.col("val").cast("array<double>").alias("val")).mapInArrow(run, f"{fields}, model int, pred double")


def _margins(length: np.ndarray, idx: np.ndarray, val: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Rows x models: the weighted sums of the rows' features, with the intercepts."""
    out = np.tile(weight[:, -1], (len(length), 1))
    some = np.flatnonzero(length)
    if len(some):
        first = (np.cumsum(length) - length)[some]
        out[some] += np.add.reduceat(val[:, None] * weight[:, idx].T, first, axis=0)
    return out


def fit(data: DataFrame, width: int, penalties: list[float], most: int = MOST_STEPS, tolerance: float = TOLERANCE) -> Models:
    """The models of every sample of data (idx, val, parts) under every penalty C; features are numbered below width."""
    some = data.select(F.explode("parts.sample").alias("s")).agg(F.max("s")).first()[0]
    if some is None:
        return Models(np.zeros(0, int), np.zeros(0), np.zeros((0, width + 1)), np.zeros(0, bool))
    samples = int(some) + 1

    def counted(length, idx, val, row, sample, weight, y):
        out = np.zeros((samples, width + 1))
        np.add.at(out[:, -1], sample, weight)
        at = np.cumsum(length) - length
        for s in np.unique(sample).tolist():
            for r in row[sample == s].tolist():
                own = slice(at[r], at[r] + length[r])
                np.maximum.at(out[s], idx[own], np.abs(val[own]))
        return out

    both = lambda a, b: np.column_stack([np.maximum(a[:, :-1], b[:, :-1]), a[:, -1] + b[:, -1]])
    facts = _summed(data, counted, (samples, width + 1), both)
    present = np.flatnonzero(facts[:, -1] > 0)
    sample, penalty = np.repeat(present, len(penalties)), np.tile(penalties, len(present))
    n = facts[sample, -1]
    scale = np.where(facts[sample, :-1] > 0, facts[sample, :-1], 1.0)
    ridge = 1 / (penalty * n)
    x = np.zeros((len(sample), width + 1))
    models = Models(sample, penalty, x, np.zeros(len(sample), bool), 1, n)

    def evaluate(live: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses and gradients of the live models at x: one job."""
        own_sample, real = sample[live], np.column_stack([x[:, :-1] / scale[live], x[:, -1]])
        shared = data.sparkSession.sparkContext.broadcast((own_sample, real))

        def sums(length, idx, val, row, part, weight, y):
            of, w = shared.value
            margin = _margins(length, idx, val, w)
            rest = np.zeros((len(length), len(of)))
            out = np.zeros((len(of), w.shape[1] + 1))
            for s in np.unique(part).tolist():
                own, here = part == s, np.flatnonzero(of == s)
                if len(here):
                    m, r = margin[np.ix_(row[own], here)], row[own]
                    out[here, -1] += (weight[own][:, None] * (np.logaddexp(0, m) - y[own][:, None] * m)).sum(axis=0)
                    np.add.at(rest, np.ix_(r, here), weight[own][:, None] * (1 / (1 + np.exp(-np.clip(m, -500, 500))) - y[own][:, None]))
            slopes = np.zeros((w.shape[1] - 1, len(of)))
            _by_feature(length, idx, val[:, None] * np.repeat(rest, length, axis=0), slopes)
            out[:, :-2], out[:, -2] = slopes.T, rest.sum(axis=0)
            return out

        models.jobs += 1
        got = _summed(data, sums, (len(live), width + 2))
        loss, slope = got[:, -1] / n[live], got[:, :-1] / n[live, None]
        slope[:, :-1] = slope[:, :-1] / scale[live] + ridge[live, None] * x[:, :-1]
        return loss + ridge[live] / 2 * (x[:, :-1] ** 2).sum(axis=1), slope

    live = np.arange(len(sample))
    f, g = evaluate(live, x)
    states = [([], []) for _ in live]
    step = np.array([1 / max(1.0, np.abs(v).sum()) for v in g])
    for _ in range(most):
        models.converged[live[np.abs(g[live]).max(axis=1) <= tolerance]] = True
        live = live[~models.converged[live]]
        if not len(live):
            break
        way = np.array([_direction(g[k], *states[k]) for k in live])
        fresh = x[live] + step[live, None] * way
        loss, slope = evaluate(live, fresh)
        downhill = (g[live] * way).sum(axis=1)
        # What rounding leaves of a decrease counts as one.
        good = loss <= f[live] + 1e-4 * step[live] * downhill + 1e-15 * np.abs(f[live])
        for i, k in enumerate(live.tolist()):
            if not good[i]:
                step[k] *= 0.4
                if step[k] < 1e-12:
                    states[k], step[k] = ([], []), 1 / max(1.0, np.abs(g[k]).sum())
                continue
            moved, turned = fresh[i] - x[k], slope[i] - g[k]
            if moved @ turned > 1e-300:
                states[k][0].append(moved)
                states[k][1].append(turned)
                del states[k][0][:-MEMORY], states[k][1][:-MEMORY]
            x[k], f[k], g[k], step[k] = fresh[i], loss[i], slope[i], 1.0
    models.weight = np.column_stack([x[:, :-1] / scale, x[:, -1]])
    return models


def _direction(slope: np.ndarray, moved: list[np.ndarray], turned: list[np.ndarray]) -> np.ndarray:
    """The quasi-Newton direction by the two-loop recursion."""
    q, kept = slope.copy(), []
    for s, y in zip(reversed(moved), reversed(turned), strict=True):
        a = (s @ q) / (s @ y)
        kept.append(a)
        q -= a * y
    if moved:
        q *= (moved[-1] @ turned[-1]) / (turned[-1] @ turned[-1])
    for (s, y), a in zip(zip(moved, turned, strict=True), reversed(kept), strict=True):
        q += (a - (y @ q) / (s @ y)) * s
    return -q
