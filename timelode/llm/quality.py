"""Quality scores by histogram gradient-boosted trees over document statistics.

Every text is turned into some twenty statistics of its bytes, words and lines, for many texts at once in
numpy. Trees are grown level by level on histograms of binned statistics and logistic loss, and flattened
into arrays (statistic, threshold, children, value) that a batch walks down together.

Cases: null, empty and wordless texts have statistics of zero and get that leaf's score; labels without a
text, or null, teach nothing; an id with several labels counts with the greatest, one with several texts with
the greatest by order, once; with no labelled rows at all every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm._common import bucket_of, lean, small_arrow, small_batches, table, text_slices
from timelode.llm._words import BLOCK, SPACE, mix, scan
from timelode.llm.toxicity import labelled_sample

#: Labelled ids that the trees are grown on, at most; chosen by a hash of the id.
SAMPLE_ROWS = 20_000
BINS, DEPTH, TREES, RATE, LEAST_HESSIAN, RIDGE = 64, 4, 80, 0.15, 3.0, 1.0
HELD_OUT = 2

_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 11, 12]] = 4
_CLASS[[10, 13]] = 5
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 6
_CLASS[33] = 7
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 8
_CLASS[124] = 9
_CLASS[128:] = 10
CLASSES = 11
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True

NAMES = [*(f"share_{k}" for k in range(1, CLASSES)), "log_bytes", "log_words", "mean_word", "log_longest_word", "distinct_words", "repeated_next", "repeated_pairs", "odd_word_ends", "log_lines", "distinct_lines", "mean_line", "distinct_shingles", "capital_words", "digit_words"]


def _distinct(hashes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Distinct hashes in each document."""
    own = mix(doc.astype(np.uint64), 3)
    _, first = np.unique(hashes ^ own, return_index=True)
    return np.bincount(doc[first], minlength=docs).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[texts, len(NAMES)] statistics of texts."""
    docs, size = len(offsets) - 1, np.diff(offsets).astype(float)
    counts = np.zeros(docs * CLASSES, np.int64)
    for a in range(0, len(data), BLOCK):
        row = np.repeat(np.arange(docs), np.diff(np.clip(offsets, a, a + BLOCK)))
        counts += np.bincount(row * CLASSES + _CLASS[data[a : a + BLOCK]], minlength=docs * CLASSES)
    share = counts.reshape(docs, CLASSES)[:, 1:] / np.maximum(size, 1)[:, None]
    words = scan(data, offsets, lower=False, parts=SPACE)
    h, doc, n = words.hashes(), words.doc, np.diff(words.first).astype(float)
    length = (words.ends - words.starts).astype(float)
    per = lambda values, which: np.bincount(which, values, docs)
    some = np.maximum(n, 1)
    longest = np.zeros(docs)
    if len(length):
        has = n > 0
        longest[has] = np.maximum.reduceat(length, words.first[:-1][has])
    next_same = np.zeros(docs)
    pairs = np.zeros(docs)
    if len(h) > 1:
        within = doc[1:] == doc[:-1]
        next_same = per(((h[1:] == h[:-1]) & within).astype(float), doc[1:])
        pair = mix(h[:-1] * np.uint64(3) + h[1:], 1)
        pairs = 1 - _distinct(pair[within], doc[1:][within], docs) / np.maximum(n - 1, 1)
    five = np.ones(docs)
    if len(h) > 4:
        within = doc[4:] == doc[:-4]
        code = h[4:].copy()
        for k in range(4):
            code = code * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - 4 + k]
        five = np.where(n > 4, _distinct(mix(code[within]), doc[4:][within], docs) / np.maximum(n - 4, 1), 1.0)
    last, head = _CLASS[data[words.ends - 1]] if len(h) else np.zeros(0), _CLASS[data[words.starts]] if len(h) else np.zeros(0)
    second = _CLASS[data[np.minimum(words.starts + 1, words.ends - 1)]] if len(h) else np.zeros(0)
    lines = scan(data, offsets, lower=False, parts=NEWLINE)
    k = np.diff(lines.first).astype(float)
    distinct_lines = _distinct(lines.hashes(), lines.doc, docs) / np.maximum(k, 1)
    columns = [np.log1p(size), np.log1p(n), per(length, doc) / some, np.log1p(longest), _distinct(h, doc, docs) / some, next_same / some, pairs, per((last >= 7).astype(float) * (last <= 9), doc) / some, np.log1p(k), distinct_lines, n / np.maximum(k, 1), five, per(((head == 2) & (second == 2)).astype(float), doc) / some, per((head == 3).astype(float), doc) / some]
    return np.column_stack([share, *columns])


@dataclass
class Forest:
    """Trees as arrays: node 0 of each tree is its root, and a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row: all trees and rows go down a level together."""
        trees, rows = len(self.feature), np.arange(len(x))[:, None]
        out = np.full(len(x), self.base)
        if trees and len(x):
            tree = np.arange(trees)[None, :]
            node = np.zeros((len(x), trees), np.int64)
            for _ in range(DEPTH):
                right = x[rows, self.feature[tree, node]] > self.threshold[tree, node]
                node = np.where(right, self.right[tree, node], self.left[tree, node])
            out = out + self.value[tree, node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost trees on rows x with labels y in {0, 1}."""
    empty = np.zeros((0, 1))
    if not len(y):
        return Forest(empty.astype(int), empty, empty.astype(int), empty.astype(int), empty, 0.0)
    rows, wide = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(wide)]
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin, nodes = np.full(rows, base), 2 ** (DEPTH + 1) - 1
    shape = (TREES, nodes)
    feature, threshold, value = np.zeros(shape, int), np.full(shape, np.inf), np.zeros(shape)
    left = np.tile(np.arange(nodes), (TREES, 1))
    right = left.copy()
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(rows, int)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            at, best = node - first, np.full(count, 1e-6)
            inside = (at >= 0) & (at < count)
            choice = np.full((count, 2), -1)
            for f in range(wide):
                key = at[inside] * BINS + bins[inside, f]
                gs = np.bincount(key, g[inside], count * BINS).reshape(count, BINS)
                hs = np.bincount(key, h[inside], count * BINS).reshape(count, BINS)
                gl, hl, ga, ha = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1], gs.sum(1)[:, None], hs.sum(1)[:, None]
                gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gain[(hl < LEAST_HESSIAN) | (ha - hl < LEAST_HESSIAN)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(count), top] > best
                best[better] = gain[np.arange(count), top][better]
                choice[better] = np.column_stack([np.full(count, f), top])[better]
            for k in np.flatnonzero(choice[:, 0] >= 0).tolist():
                f, b = choice[k].tolist()
                if b >= len(cuts[f]):
                    continue
                own = first + k
                feature[t, own], threshold[t, own] = f, cuts[f][b]
                left[t, own], right[t, own] = 2 * own + 1, 2 * own + 2
                mine = node == own
                node[mine] = np.where(bins[mine, f] > b, 2 * own + 2, 2 * own + 1)
        total_g, total_h = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
        value[t] = -RATE * total_g / (total_h + RIDGE)
        margin += value[t][node]
    return Forest(feature, threshold, left, right, value, base)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, rows: int = SAMPLE_ROWS) -> Forest:
    """Trees of a bounded sample of the labelled rows; statistics are made on the executors."""
    train = bucket_of(n=4) != HELD_OUT if train is None else train

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for i, j, data, offsets in text_slices(batch.column(1)):
                x = statistics(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, j - i), lists], ["y", "x"])

    with small_arrow(docs.sparkSession):
        got = labelled_sample(docs, labels, label, train, rows).mapInArrow(lean(run), "y int, x array<double>").toArrow()
    if not got.num_rows:
        return grow(np.zeros((0, len(NAMES))), np.zeros(0))
    y, x = got["y"].to_numpy().astype(float), got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    order = np.lexsort([y, *x.T])  # arrival order differs between runs; the fit must not
    return grow(x[order], y[order])


def scored(docs: DataFrame, model: Forest, text: str = "text") -> Column:
    """A column of scores of a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @lean
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for column in columns:
            parts = [own.score(statistics(data, offsets)) for _, _, data, offsets in text_slices(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.coalesce(F.col(text), F.lit("")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by trees of the labelled ones outside the held-out quarter."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    out = docs.select("doc_id", (F.coalesce(bucket_of(n=4), F.lit(0)) == HELD_OUT).alias("held_out"), scored(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
