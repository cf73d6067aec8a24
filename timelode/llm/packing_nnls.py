"""Packing by non-negative least squares over the histogram of lengths.

Documents are cut into full windows and a last piece. A combination is up to three lengths that fill a
window, or one of its halves, quarters and so on, exactly. How often each combination is to be repeated
solves a non-negative least squares problem against the histogram of lengths; the counts are rounded, and what
they leave of the histogram is packed greedily: first by the exact combinations that still fit most often, then
by cutting the pieces that remain into powers of two. So everything becomes full blocks whose sizes are powers
of two, blocks of one size stack up to whole windows, and the odd ones at the end to sequences whose
lengths are powers of two: nothing is padded, and no piece is cut that a combination takes.

Only the histogram reaches the driver, and only runs of equal pieces go back ("pieces a..b of this length
are the second part of blocks c.. of that size"): both are bounded by the window, whatever the corpus, and so is
the solver's work. Pieces are numbered within their length, as in best-fit packing, by their place in
their partition and the counts of the partitions before; the join that brings the two together moves a
few numbers a piece and no text.

Cases: a null or empty text is one piece that holds the end token alone; repeated rows and null ids are packed
each; texts of any length are cut into windows; however many pieces share one length, they are one row of the
histogram; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from timelode.llm._common import lean, small_batches, table, written
from timelode.llm.bpe import TOKENIZER, encoded_slices

WINDOW, END_ID = 2048, 1
#: Steps of the solver, at most, and the relative change of the counts at which it ends.
STEPS, SETTLED = 200, 1e-4

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, parts array<long>, part int, nth long"


def binary_parts(length: int) -> list[int]:
    """The powers of two that add up to length, largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of each document (doc_id, text): place, length, digest, digests of the binary parts of a piece below the window, and number nth among those of its length in partition part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in small_batches(batches):
            for i, j, ids, at in encoded_slices(batch.column(1), tokenizer):
                n = np.diff(at) + 1
                flat = np.full(len(ids) + j - i, end_id, "<u4")
                keep = np.ones(len(flat), bool)
                keep[np.cumsum(n) - 1] = False
                flat[keep] = ids
                count = -(-n // window)
                row = np.repeat(np.arange(j - i), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(n[row] - start, window)
                begin = ((np.cumsum(n) - n)[row] + start).tolist()
                raw, crc, parts, ends = memoryview(flat).cast("B"), [], [], [0]
                for a, m in zip(begin, length.tolist(), strict=True):
                    crc.append(zlib.crc32(raw[4 * a : 4 * (a + m)]))
                    if m < window:
                        for p in binary_parts(m):
                            parts.append(zlib.crc32(raw[4 * a : 4 * (a + p)]))
                            a += p
                    ends.append(len(parts))
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.searchsorted(ranked, ranked) + seen[ranked]
                seen += np.bincount(length, minlength=window + 1)
                columns = [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row])]
                columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(parts, pa.int64())), pa.array(np.full(len(row), part), pa.int32()), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), PIECES)


def sizes(window: int) -> list[int]:
    """The sizes of blocks: the window and the powers of two below it."""
    return [window >> k for k in range(window.bit_length())]


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows (size, a, b, c) with a >= b >= c and a + b + c = size, of lengths that occur; 0 stands for none."""
    there = np.append(True, histogram[1:] > 0)
    out = []
    for size in sizes(window):
        a, b = np.meshgrid(np.arange(size + 1), np.arange(size // 2 + 1), indexing="ij")
        c = size - a - b
        a, b, c = (x[(b <= a) & (c <= b) & (c >= 0)] for x in (a, b, c))
        fit = there[a] & there[b] & there[c]
        out.append(np.column_stack([np.full(int(fit.sum()), size), a[fit], b[fit], c[fit]]))
    return np.concatenate(out)


def repeats(histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """How often each combination is to be repeated: the non-negative x of the least |A x - histogram|, by accelerated projected gradients."""
    if not len(combos):
        return np.zeros(0)
    goal, top = histogram.astype(float), len(histogram)
    goal[0] = 0.0
    members = [np.ascontiguousarray(combos[:, k]) for k in (1, 2, 3)]

    def used(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(m, x, top) for m in members)
        out[0] = 0.0
        return out

    back = lambda r: sum(r[m] for m in members)
    # The largest eigenvalue of A'A is at most the largest sum of a row of it.
    steep = float(back(used(np.ones(len(combos)))).max())
    x = ahead = np.zeros(len(combos))
    t = 1.0
    for _ in range(STEPS):
        fresh = np.maximum(ahead - back(used(ahead) - goal) / steep, 0.0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        step = fresh - x
        ahead = fresh + (before - 1) / t * step
        x = fresh
        if np.abs(step).sum() <= SETTLED * x.sum():
            break
    return x


def rounded(x: np.ndarray, combos: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whole repeats, what they leave of the histogram): fractions are carried from one combination to the next that has the same longest length, and no length is overdrawn."""
    left, out, carried = histogram.tolist(), np.zeros(len(x), np.int64), [0.0] * len(histogram)
    order = np.argsort(-x, kind="stable")
    order = order[x[order] > 1e-6]
    for j, want, (a, b, c) in zip(order.tolist(), x[order].tolist(), combos[order, 1:].tolist(), strict=True):
        carried[a] += want
        n = int(carried[a] + 0.5)
        if n > 0:
            n = fitting(left, a, b, c, n)
            carried[a] -= n
            out[j] = n
    return out, np.array(left)


def fitting(left: list[int], a: int, b: int, c: int, most: int) -> int:
    """Take a, b and c from what is left as often as it has them, most times at most."""
    need: dict[int, int] = {}
    for k in (a, b, c):
        if k:
            need[k] = need.get(k, 0) + 1
    n = min(most, *(left[k] // m for k, m in need.items()))
    for k, m in need.items():
        left[k] -= n * m
    return n


def greedy(left: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, a, b, c, repeats) that use up what is left, as far as exact combinations go: longest lengths first, each with the partners that are most plentiful."""
    own, out = left.tolist(), []
    for size in sizes(window):
        for a in range(size, 0, -1):
            while own[a]:
                low, high = max(0, -(-(size - a) // 2)), min(a, size - a)
                if low > high:
                    break
                b = np.arange(low, high + 1)
                c = size - a - b
                stock = np.array(own)
                stock[0] = 1 << 62
                have = np.minimum(stock[b], stock[c])
                k = int(have.argmax())
                if not have[k] or not (n := fitting(own, a, int(b[k]), int(c[k]), 1 << 62)):
                    break
                out.append((size, a, int(b[k]), int(c[k]), n))
    left[:] = own
    return out


@dataclass
class Plan:
    """Where the pieces of each length go; bounded by the window and the combinations used."""

    window: int
    #: Runs of pieces, sorted by (length, first number): length, first number, size of the blocks, first block, offset in the block.
    runs: np.ndarray
    #: The number from which pieces of a length are cut, and the first block that its parts of each size go to.
    cut_from: np.ndarray
    cut_base: np.ndarray
    #: Blocks of each size in all.
    blocks: np.ndarray

    def sequences(self, size: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of blocks of the given sizes (as powers of two) and numbers."""
        stack = self.window >> np.arange(len(self.blocks))
        full, odd = self.blocks // stack, self.blocks % stack
        first = np.cumsum(full) - full
        # Odd blocks follow each other, largest first, so that none crosses a border.
        own = (odd << np.arange(len(odd)))[::-1]
        begin = (np.cumsum(own) - own)[::-1]
        total = int(own.sum())
        inner, rest = full.sum() + total // self.window, total % self.window
        ends = np.cumsum([0, *binary_parts(rest)])
        place = begin[size] + ((block - full[size] * stack[size]) << size)
        late = place - total // self.window * self.window
        segment = np.searchsorted(ends, late, "right") - 1
        stacked, whole = block < full[size] * stack[size], late < 0
        seq = np.where(stacked, first[size] + block // stack[size], np.where(whole, full.sum() + place // self.window, inner + segment))
        return seq, np.where(stacked, (block % stack[size]) << size, np.where(whole, place % self.window, late - ends[np.maximum(segment, 0)]))


def planned(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """A plan for histogram[length] pieces of each length up to the window."""
    combos = combinations(histogram, window)
    counts, left = rounded(repeats(histogram, combos), combos, histogram)
    left[0] = 0
    used = np.flatnonzero(counts)
    rows = [*map(tuple, np.column_stack([combos[used], counts[used]]).tolist()), *greedy(left, window)]
    given, blocks, runs = [0] * (window + 1), [0] * window.bit_length(), []
    for size, a, b, c, n in rows:
        k, offset = size.bit_length() - 1, 0
        for length in (a, b, c):
            if length:
                runs.append((length, given[length], k, blocks[k], offset))
                given[length] += n
                offset += length
        blocks[k] += n
    base = np.zeros((window + 1, len(blocks)), np.int64)
    for length in np.flatnonzero(left).tolist():
        for part in binary_parts(length):
            k = part.bit_length() - 1
            base[length, k] = blocks[k]
            blocks[k] += int(left[length])
    return Plan(window, np.array(sorted(runs) or [(0, 0, 0, 0, 0)], np.int64), np.array(given), base, np.array(blocks, np.int64))


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces (a written table of pieces()) with sequence_id and offset, some of them cut into powers of two."""
    spark = cut.sparkSession
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    histogram = np.zeros(window + 1, np.int64)
    # At most one row for each length up to the window.
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    shared = spark.sparkContext.broadcast(planned(histogram, window))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        wide = int(plan.cut_from.max()) + 1
        keys = plan.runs[:, 0] * wide + plan.runs[:, 1]
        for batch in small_batches(batches):
            length, number = np.asarray(batch.column("length")), np.asarray(batch.column("number"))
            whole = np.flatnonzero(number < plan.cut_from[length])
            run = plan.runs[np.searchsorted(keys, length[whole] * wide + number[whole], "right") - 1]
            yield _placed(batch, plan, whole, np.asarray(batch.column("start"))[whole], length[whole], batch.column("ids_crc32").take(pa.array(whole)), run[:, 2], run[:, 3] + number[whole] - run[:, 1], run[:, 4])
            odd = np.flatnonzero(number >= plan.cut_from[length])
            if len(odd):
                parts = [binary_parts(n) for n in length[odd].tolist()]
                row = np.repeat(odd, [len(p) for p in parts])
                start = np.concatenate([np.cumsum([0, *p[:-1]]) for p in parts]) + np.asarray(batch.column("start"))[row]
                own = np.array([x for p in parts for x in p], np.int64)
                k = np.log2(own).astype(np.int64)
                block = plan.cut_base[length[row], k] + number[row] - plan.cut_from[length[row]]
                yield _placed(batch, plan, row, start, own, batch.column("parts").take(pa.array(odd)).flatten(), k, block, np.zeros(len(row), np.int64))

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts"]
    # Pieces are many and their counts grow with the partitions, so neither side is broadcast.
    numbered = cut.join(counts.select("part", "length", "base").hint("merge"), ["part", "length"]).select(*kept, (F.col("nth") + F.col("base")).alias("number"))
    fields = [f for f in numbered.schema.fields if f.name not in ("parts", "number")]
    return numbered.mapInArrow(lean(place), StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def _placed(batch: pa.RecordBatch, plan: Plan, row: np.ndarray, start: np.ndarray, length: np.ndarray, crc: pa.Array, size: np.ndarray, block: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    seq, at = plan.sequences(size, block)
    ids, tokens = (batch.column(c).take(pa.array(row)) for c in ("doc_id", "doc_tokens"))
    return pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(length), crc, tokens, pa.array(seq), pa.array(at + offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens without padding."""
    return pack(written(pieces(table(spark, sf_dir, "documents")), "window-pieces"))


QUERIES = {"op12_packing": op12_packing}
ORACLES: dict[str, str] = {}
