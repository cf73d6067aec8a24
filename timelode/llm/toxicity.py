"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between, as hashes of letter runs with
A-Z lower-cased. Learning rates are per coordinate, and the L1 term leaves most weights at zero, so that
what is broadcast is a short list of (feature, weight), bounded by the number of hash buckets.

Words of a text of any length are turned into features SEGMENT words at a time.

Cases: null, empty and wordless texts get the score of the bias alone; labels without a text, or null,
teach nothing; an id with several labels counts with the greatest, one with several texts with the greatest
by order, once; with no labelled rows at all every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm._common import bucket_of, discard, lean, small_batches, table, text_slices, written
from timelode.llm._words import NOT_LETTER, mix, scan

BITS = 22
#: Labelled ids that the model is fitted on, at most, in the order of a hash of the id; and features of their texts in all, at which the sample ends.
SAMPLE_ROWS, SAMPLE_FEATURES = 12_000, 24_000_000
#: Words that scoring looks at together.
SEGMENT = 1 << 17
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 8.0, 0.0, 10


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, text) of every word, pair and skip-pair of the texts, repeats included, a segment of words after the other."""
    words = scan(data, offsets, parts=NOT_LETTER)
    hashes, shift = words.hashes(), np.uint64(64 - bits)
    for a in range(0, len(hashes), SEGMENT):
        # Pairs belong to the segment of their second word.
        low, b = max(0, a - 2), min(len(hashes), a + SEGMENT)
        h, doc = hashes[low:b], words.doc[low:b]
        out, owner = [h[a - low :] >> shift], [doc[a - low :]]
        for gap in (1, 2):
            first = max(a - low, gap)
            left, right = h[first - gap : len(h) - gap], h[first:]
            same = doc[first - gap : len(h) - gap] == doc[first:]
            pair = mix(left * np.uint64(2 * gap + 1) + (right >> np.uint64(7)), gap)
            out.append((pair >> shift)[same])
            owner.append(doc[first:][same])
        yield np.concatenate(out).astype(np.int64), np.concatenate(owner)


def distinct_features(data: np.ndarray, offsets: np.ndarray, of: np.ndarray | None = None, bits: int = BITS) -> np.ndarray:
    """The distinct text << bits | feature of texts, in order; only of the features that of marks, if given."""
    parts = [np.zeros(0, np.int64)]
    for feature, doc in features(data, offsets, bits):
        if of is not None:
            hit = np.flatnonzero(of[feature])
            feature, doc = feature[hit], doc[hit]
        parts.append(np.unique(doc << bits | feature))
    return parts[1] if len(parts) == 2 else np.unique(np.concatenate(parts))


@dataclass
class Sparse:
    """What is left of the model: its non-zero weights and its bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS

    def scorer(self):
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.index] = self.weight
        kept = dense != 0

        def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            pair = distinct_features(data, offsets, kept, self.bits)
            margin = self.bias + np.bincount(pair >> self.bits, dense[pair & ((1 << self.bits) - 1)], len(offsets) - 1)
            return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))

        return score


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> Sparse:
    """FTRL-proximal over rows of distinct features, in a fixed shuffled order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias, rng = 1 << bits, np.random.default_rng(7)
    l1 = np.full(1, L1)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)).tolist():
            idx = np.append(rows[r], bias)
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2), 0.0)
            w[-1] = -zi[-1] / ((BETA + root[-1]) / ALPHA + L2)
            g = 1 / (1 + np.exp(-min(max(w.sum(), -35), 35))) - labels[r]
            z[idx] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[idx] = ni + g * g
    index = np.flatnonzero(np.abs(z[:-1]) > L1)
    zi, root = z[index], np.sqrt(n[index])
    weight = -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2)
    last = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2)
    return Sparse(index, weight.astype(np.float32), float(last), bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """(place, text, y) of at most so many labelled documents whose id meets train, by the least hashes (place) of their ids; an id counts once."""
    ids = labels.filter(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    some = ids.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id", "place", "y").agg(F.max("text").alias("text")).select("place", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None, rows: int = SAMPLE_ROWS, most: int = SAMPLE_FEATURES) -> Sparse:
    """The model of a bounded sample of the labelled rows; features are made on the executors."""
    train = bucket_of() != 0 if train is None else train

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for i, j, data, offsets in text_slices(batch.column(1)):
                pair = distinct_features(data, offsets)
                ends = np.searchsorted(pair >> BITS, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((pair & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), lists], ["place", "y", "f"])

    made = written(labelled_sample(docs, labels, label, train, rows).mapInArrow(lean(run), "place long, y int, f array<int>"), "toxic-features")
    # One row for each of at most so many rows. A text whose features would be too many is passed over, those behind it are not.
    sizes = made.select("place", F.size("f").alias("n")).toArrow().sort_by("place")
    kept, taken = [], 0
    for place, n in zip(sizes["place"].to_pylist(), sizes["n"].to_pylist(), strict=True):
        if taken + n <= most:
            kept.append((place,))
            taken += n
    if not taken:
        return Sparse(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)
    some = made if len(kept) == sizes.num_rows else made.join(F.broadcast(made.sparkSession.createDataFrame(kept, "place long")), "place").select(*made.columns)
    got = some.toArrow()
    discard(made)
    y = got["y"].to_numpy()
    lists = got["f"].combine_chunks()
    flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    rows_ = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
    # Arrival order differs between runs; the fit must not.
    order = sorted(range(len(rows_)), key=lambda r: (len(rows_[r]), int(y[r]), rows_[r][:50].tobytes()))
    return fit_ftrl([rows_[r] for r in order], y[order].astype(float))


def scored(docs: DataFrame, model: Sparse, text: str = "text") -> Column:
    """A column of scores of a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @lean
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value.scorer()
        for column in columns:
            parts = [own(data, offsets) for _, _, data, offsets in text_slices(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.coalesce(F.col(text), F.lit("")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled ones outside the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    out = docs.select("doc_id", (F.coalesce(bucket_of(), F.lit(1)) == 0).alias("held_out"), scored(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
