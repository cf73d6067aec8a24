"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Best fit decreasing depends on lengths alone, and pieces of one length are interchangeable. So the
packer works on the histogram of lengths, which has at most as many rows as the capacity: for each
length, longest first, a segment tree over the remaining capacities finds the tightest open bins in
logarithmic time, and all such bins are filled at once, each with as many pieces as it has room for
before the next. The outcome is the one that best fit decreasing gives piece by piece. It is written down as runs: "pieces number a..b of this
length go to sequences s.. at offset o". Only the histogram and the runs reach the driver; both are
bounded by the capacity, not by the corpus.

Pieces are numbered within their length by two counts: within their input partition while they are
tokenised, and over the partitions by a window on the table of (partition, length) counts.

Cases: a null or empty text is one piece that holds the end token alone; a longer document is cut from
its end into full pieces, so that its first piece may be shorter; repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelode.llm._common import lean, small_batches, table, written
from timelode.llm.bpe import TOKENIZER, encoded_slices

CAPACITY = 1024
END_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """The pieces of each document (doc_id, text): where they start, their length and digest, and their number nth among those of that length in partition part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in small_batches(batches):
            for i, j, ids, at in encoded_slices(batch.column(1), tokenizer):
                n = np.diff(at) + 1
                flat = np.full(len(ids) + j - i, end_id, "<u4")
                keep = np.ones(len(flat), bool)
                keep[np.cumsum(n) - 1] = False
                flat[keep] = ids
                count = -(-n // capacity)
                row = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                short = n - (count - 1) * capacity
                start = np.where(piece > 0, short[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, short[row])
                begin = (np.cumsum(n) - n)[row] + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(nth)]
                names = [c.split()[0] for c in PIECES.split(", ")]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(length)])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), PIECES + (", ids array<int>" if with_ids else ""))


class CapacityTree:
    """A segment tree over remaining capacities 0..n: how many open bins have each, and the tightest that still fits."""

    def __init__(self, n: int) -> None:
        self.leaves = 1 << n.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        k = self.leaves + capacity
        while k:
            self.sums[k] += bins
            k //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity >= length that an open bin has."""
        k = self.leaves + length
        if self.sums[k]:
            return length
        while k > 1:
            if k % 2 == 0 and self.sums[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.sums[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, last + 1, sequence of the first, offset) that place histogram[length] pieces of each length."""
    tree, open_bins, runs, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        placed, total = 0, histogram[length]
        while placed < total:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length
                # New bins open one at a time, and each is filled as long as it is the tightest that fits.
                full, rest = divmod(total - placed, per)
                for k, count in ((per, full), (rest, 1 if rest else 0)):
                    if count and k:
                        for slot in range(k):
                            runs.append((length, placed + slot * count, placed + (slot + 1) * count, bins, slot * length))
                        left = capacity - k * length
                        open_bins.setdefault(left, []).append((bins, count))
                        tree.add(left, count)
                        bins, placed = bins + count, placed + k * count
                continue
            # A bin just filled is the tightest, so it takes pieces as long as they fit before the next bin is begun.
            first, count = open_bins[room].pop()
            per = room // length
            full = min(count, (total - placed) // per)
            rest = total - placed - full * per if full < count else 0
            for k, n in ((per, full), (rest, 1 if rest else 0)):
                if n:
                    for slot in range(k):
                        runs.append((length, placed + slot * n, placed + (slot + 1) * n, first, capacity - room + slot * length))
                    left = room - k * length
                    open_bins.setdefault(left, []).append((first, n))
                    tree.add(left, n)
                    tree.add(room, -n)
                    first, count, placed = first + n, count - n, placed + k * n
            if count:
                open_bins[room].append((first, count))
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (a written table of pieces()) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    # At most one row for each length up to the capacity.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(best_fit_runs(histogram, capacity)) or [(0, 0, 0, 0, 0)], np.int64)
    shared = spark.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        wide = int(own[:, 2].max()) + 1
        keys = own[:, 0] * wide + own[:, 1]
        for batch in batches:
            names = batch.schema.names
            length, number = np.asarray(batch.column(names.index("length"))), np.asarray(batch.column(names.index("number")))
            run = np.searchsorted(keys, length * wide + number, "right") - 1
            out = [batch.column(k) for k in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(own[run, 3] + number - own[run, 1]), pa.array(own[run, 4])], [*names[:-1], "sequence_id", "offset"])

    kept = [c for c in cut.columns if c not in ("part", "nth")]
    numbered = cut.join(counts.select("part", "length", "base"), ["part", "length"]).select(*kept, (F.col("nth") + F.col("base")).alias("number"))
    from pyspark.sql.types import LongType, StructField, StructType

    return numbered.mapInArrow(lean(place), StructType([*numbered.schema.fields[:-1], StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(written(pieces(table(spark, sf_dir, "documents")), "pieces"))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
