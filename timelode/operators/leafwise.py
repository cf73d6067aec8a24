"""Gradient-boosted trees grown leaf by leaf, best gain first, over histograms of the rows' partitions.

Features are cut at quantiles of all rows, and each row is written once as its bins. A job adds up gradients
by (leaf, feature, bin) in its tasks, and one histogram a task is merged in a tree; the driver sees histograms,
never rows. Of two children only the smaller is summed, the other is the parent less it. The leaf of the
greatest gain is split next, so what a tree has is its number of leaves, with or without a depth. Children of the
few most promising leaves are summed in one job ahead of their turn; the order of splits stays that of the gains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from timelode.sources.shared import written

#: Bins of a feature, features whose quantiles are asked for in one job, leaves whose children are summed ahead, trees after which rows are written with their scores.
BINS, AT_ONCE, AHEAD, KEPT_FOR = 64, 256, 8, 16


@dataclass
class Tree:
    """Nodes in arrays: a leaf has feature -1 and a value; bins up to cut go to left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, leaf: int, feature: int, cut: int) -> tuple[int, int]:
        ends = len(self.feature), len(self.feature) + 1
        self.feature[leaf], self.cut[leaf], self.left[leaf], self.right[leaf] = feature, cut, *ends
        for name, v in (("feature", -1), ("cut", 0), ("left", 0), ("right", 0), ("value", 0.0)):
            getattr(self, name).extend([v, v])
        return ends

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        go = np.flatnonzero(feature[at] >= 0)
        while len(go):
            f = feature[at[go]]
            at[go] = np.where(bins[go, f] <= cut[at[go]], left[at[go]], right[at[go]])
            go = go[feature[at[go]] >= 0]
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Boosted:
    """The fitted trees. Its size is that of the trees and the features' edges."""

    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.base + sum((t.scores(bins) for t in self.trees), np.zeros(len(bins)))

    def transform(self, rows: DataFrame, features: str = "features", out: str = "pred") -> DataFrame:
        """rows (features an array<double>) with the probability of class 1."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for c in columns:
                x = np.asarray(c.flatten()).reshape(len(c), -1)
                yield pa.array(1 / (1 + np.exp(-shared.value.raw(shared.value.bins(x))))) if len(c) else pa.array([], pa.float64())

        return rows.withColumn(out, score(F.col(features)))


def edges_of(rows: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Each feature's quantiles over all rows, without repeats: at most bins - 1 of them."""
    shares = [i / bins for i in range(1, bins)]
    out: list[np.ndarray] = []
    for a in range(0, width, AT_ONCE):
        some = range(a, min(width, a + AT_ONCE))
        got = rows.agg(*(F.percentile_approx(F.col("features")[k], shares, 100 * bins).alias(f"q{k}") for k in some)).first()
        out += [np.unique(np.array(got[f"q{k}"] or [], float)) for k in some]
    return out


def gains(h: np.ndarray, least: int) -> np.ndarray:
    """The gain of each cut (feature, bin) of a leaf's histogram (feature, bin, (gradient, curvature, rows)); -inf where a side has too few rows."""
    left = h.cumsum(axis=1)
    all_ = left[:, -1:, :]
    right = all_ - left
    part = lambda s: np.divide(s[..., 0] ** 2, s[..., 1], out=np.zeros(s.shape[:-1]), where=s[..., 1] > 0)
    gain = part(left) + part(right) - part(all_)
    return np.where((left[..., 2] >= least) & (right[..., 2] >= least), gain, -np.inf)


def best_cut(h: np.ndarray, least: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut of a leaf; of equals the first feature and bin. Gains are compared to nine digits, so that the order of sums doesn't tell."""
    g = gains(h, least)
    top = g.max()
    if not np.isfinite(top) or top <= 1e-12:
        return 0.0, -1, 0
    k = int(np.argmax(g.ravel() >= top * (1 - 1e-9)))
    return float(top), k // g.shape[1], k % g.shape[1]


def fit(rows: DataFrame, leaves: int = 31, depth: int = -1, rate: float = 0.1, trees: int = 100, least: int = 20, bins: int = BINS) -> Boosted:
    """Trees for rows (features array<double>, y). depth -1 is without end; least is the fewest rows of a leaf."""
    spark = rows.sparkSession
    facts = rows.agg(F.max(F.size("features")), F.avg(F.col("y").cast("double")), F.count(F.lit(1))).first()
    width, share, n = facts
    if not n:
        return Boosted([], 0.0, [])
    share = min(max(share, 1e-15), 1 - 1e-15)
    model = Boosted(edges_of(rows, width, bins), float(np.log(share / (1 - share))), [])
    shared = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = shared.value.bins(np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in own], pa.binary()), b.column(1), pa.array(np.full(b.num_rows, model.base))], ["bins", "y", "raw"])

    state = written(rows.select(F.col("features").cast("array<double>").alias("features"), F.col("y").cast("double").alias("y")).mapInArrow(binned, "bins binary, y double, raw double"), "binned")
    fresh: list[Tree] = []

    def columns(b: pa.RecordBatch, since: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
        return own, b.column(1).to_numpy(), b.column(2).to_numpy() + sum((t.scores(own) for t in since), np.zeros(b.num_rows))

    def histograms(tree: Tree, wanted: list[int]) -> np.ndarray:
        """Of each leaf wanted: gradients, curvatures and rows by feature and bin. One job."""
        sent = spark.sparkContext.broadcast((tree, wanted, list(fresh)))
        shape = (len(wanted), width, bins, 3)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree_, wanted_, since = sent.value
            out, slot = np.zeros((3, shape[0] * width * bins)), np.full(len(tree_.feature), -1)
            slot[wanted_] = np.arange(len(wanted_))
            for b in batches:
                if not b.num_rows:
                    continue
                own, y, raw = columns(b, since)
                at = slot[tree_.leaves(own)]
                here = at >= 0
                own, y, p, at = own[here], y[here], 1 / (1 + np.exp(-raw[here])), at[here]
                cell = ((at[:, None] * width + np.arange(width)) * bins + own).ravel()
                for i, v in enumerate((p - y, p * (1 - p), np.ones(len(y)))):
                    out[i] += np.bincount(cell, np.repeat(v, width), out.shape[1])
            yield pa.RecordBatch.from_pylist([{"v": out.tobytes()}])

        def joined(a, b):
            b = np.frombuffer(b.v) if isinstance(b, Row) else b
            return b if a is None else a if b is None else a + b

        got = state.mapInArrow(run, "v binary").rdd.treeAggregate(None, joined, joined)
        return np.zeros(shape) if got is None else got.reshape(3, *shape[:3]).transpose(1, 2, 3, 0)

    for _ in range(trees):
        tree = _grown(histograms, leaves, depth, rate, least)
        if len(tree.feature) == 1:
            break
        model.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == KEPT_FOR:
            sent = spark.sparkContext.broadcast(list(fresh))

            def scored(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(columns(b, sent.value)[2])], ["bins", "y", "raw"])

            state, fresh = written(state.mapInArrow(scored, "bins binary, y double, raw double"), "binned"), []
    return model


def _grown(histograms, leaves: int, depth: int, rate: float, least: int) -> Tree:
    """One tree, by histograms(tree, leaves) of its leaves."""
    tree = Tree()
    held = {0: histograms(tree, [0])[0]}
    level, cuts, ready = {0: 0}, {}, {}

    def look(leaf: int) -> None:
        cuts[leaf] = best_cut(held[leaf], least) if depth < 0 or level[leaf] < depth else (0.0, -1, 0)

    look(0)
    ends = {0}
    while len(ends) < leaves:
        # Of equal gains the older leaf.
        leaf = min(ends, key=lambda k: (-cuts[k][0], k))
        if cuts[leaf][1] < 0:
            break
        if leaf not in ready:
            likely = [k for k in sorted(ends, key=lambda k: (-cuts[k][0], k)) if cuts[k][1] >= 0 and k not in ready][: min(AHEAD, leaves - len(ends))]
            ahead = Tree(*(list(x) for x in (tree.feature, tree.cut, tree.left, tree.right, tree.value)))
            small = {}
            for k in likely:
                _, f, c = cuts[k]
                rows = held[k][f, :, 2]
                small[k] = ahead.split(k, f, c), 0 if rows[: c + 1].sum() <= rows[c + 1 :].sum() else 1
            for (k, (pair, side)), h in zip(small.items(), histograms(ahead, [pair[side] for pair, side in small.values()]), strict=True):
                ready[k] = (h, held[k] - h) if side == 0 else (held[k] - h, h)
        pair = tree.split(leaf, *cuts[leaf][1:])
        for end, h in zip(pair, ready.pop(leaf), strict=True):
            held[end], level[end] = h, level[leaf] + 1
            look(end)
        ends = (ends - {leaf}) | set(pair)
        del held[leaf]
    for k in ends:
        s = held[k][0].sum(axis=0)
        tree.value[k] = float(-rate * s[0] / s[1]) if s[1] > 0 else 0.0
    return tree
