"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of fixed size. The hash of a chunk is a polynomial of its bytes at four bases
modulo four primes below 2^31; chunks of all texts of a batch are hashed at once. Hashes compose: that of
ab is hash(a) * base^len(b) + hash(b), so the chunks of a huge document can be hashed apart, in any order
and on any machine, and combined by length-shifted sums. The fingerprint of a text is the four residues
and its length.

Texts of equal fingerprint are then compared, chunk by chunk: the chunks of the texts in question stream
through an aggregate of least and greatest chunk, first for each (text key, chunk number), which pre-aggregates
before the shuffle and collapses copies, then for each (fingerprint, chunk number). So a group of any size
neither meets in one task nor is paired. Should the two differ anywhere, the fingerprint's group is split by
the texts themselves. The text key is a hash of the text as it stands; rows are never found again by doc_id, so
ids that repeat or are null change nothing. A filter of bounded size over the keys in question keeps other
texts away from Python and from the shuffle; what passes it by chance goes in the join on keys. The filter
fills up at some 10 million distinct texts with copies; from there on the comparison shuffles the corpus once.

Chunks of a text of any length are hashed a block at a time.

Cases: null counts as an empty text, and all empty texts are one group; rows with equal doc_id and text are
counted and given out each, and are kept or dropped together; a null doc_id loses against any other and is
kept only if no row of its group has one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm._common import hash_filter, lean, passing, small_batches, table, text_slices, written
from timelode.llm._words import BLOCK, LOWER

CHUNK = 8192
#: Four primes below 2^31, and a base for each.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
BASES = np.array([911382323, 972663749, 1165701469, 1301081933], np.uint64)
FINGERPRINT = ["f1", "f2", "n_bytes"]
#: Chunks given out at a time.
CHUNKS_OUT = 256
UPPER, LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _powers(n: int) -> np.ndarray:
    """base^i modulo prime for i < n, one row for each prime."""
    out = np.ones((len(PRIMES), n), np.uint64)
    for k, (p, b) in enumerate(zip(PRIMES.tolist(), BASES.tolist(), strict=True)):
        step = 1
        while step < n:
            m = min(step, n - step)
            out[k, step : step + m] = out[k, :m] * np.uint64(pow(b, step, p)) % np.uint64(p)
            step *= 2
    return out


_CHUNK_POWERS = _powers(CHUNK)[:, ::-1].copy()


def _power_of(k: int, exponents: np.ndarray) -> np.ndarray:
    """BASES[k] to each exponent, modulo its prime, by squaring."""
    p, square = PRIMES[k], np.uint64(int(BASES[k]))
    out, e = np.ones(len(exponents), np.uint64), exponents.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * square % p, out)
        square, e = square * square % p, e >> np.uint64(1)
    return out


def combine(hashes: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints [4, texts] of texts from the hashes [4, chunks] and lengths of their chunks first[i]:first[i+1], in order."""
    ends = np.cumsum(lengths)
    total = np.concatenate([[0], ends])[first]
    after = np.repeat(total[1:], np.diff(first)) - ends
    out = np.zeros((len(PRIMES), len(first) - 1), np.uint64)
    some = np.flatnonzero(np.diff(first))
    for k, p in enumerate(PRIMES):
        if len(some):
            out[k, some] = np.add.reduceat(hashes[k] * _power_of(k, after) % p, first[some]) % p
    return out


def chunk_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes [4, chunks], lengths, first chunk of each text) of the texts data[offsets[i]:offsets[i+1]]; the last chunk of a text may be short."""
    size = np.diff(offsets)
    count = -(-size // CHUNK)
    first = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - first[:-1][text]
    start = offsets[:-1][text] + nth * CHUNK
    length = np.minimum(CHUNK, offsets[1:][text] - start)
    hashes = np.zeros((len(PRIMES), len(text)), np.uint64)
    # Runs of chunks of BLOCK bytes: temporaries don't grow with the text.
    cut = np.unique(np.searchsorted(start, np.arange(0, len(data) + BLOCK, BLOCK)))
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        low, high = start[i], start[j - 1] + length[j - 1]
        # The power of a byte is that of its distance from its chunk's end.
        place = np.arange(low, high) - np.repeat(start[i:j] + length[i:j] - CHUNK, length[i:j])
        wide = data[low:high].astype(np.uint64) + np.uint64(1)
        for k, p in enumerate(PRIMES):
            hashes[k, i:j] = np.add.reduceat(wide * _CHUNK_POWERS[k][place], start[i:j] - low) % p
    return hashes, length, first


def _text_key() -> Column:
    """A hash of the text as it stands, by which rows are found again."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, the fingerprint (f1, f2, n_bytes) and text_sha256 of each row's text, A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for i, j, data, offsets in text_slices(batch.column(2)):
                data = LOWER[data]
                f = combine(*chunk_hashes(data, offsets))
                packed = [pa.array((f[a] << np.uint64(31) | f[b]).astype(np.int64)) for a, b in ((0, 1), (2, 3))]
                raw, at = memoryview(data), offsets.tolist()
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
                kept = [batch.column(k).slice(i, j - i) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, *packed, pa.array(np.diff(offsets)), pa.array(sha)], ["doc_id", "text_key", *FINGERPRINT, "text_sha256"])

    return docs.select(F.col("doc_id").cast("long"), _text_key(), "text").mapInArrow(lean(run), "doc_id long, text_key long, f1 long, f2 long, n_bytes long, text_sha256 string")


def _chunks(texts: DataFrame) -> DataFrame:
    """The chunks of each text, numbered, with the text's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for i, j, data, offsets in text_slices(batch.column(0)):
                data, at = LOWER[data], offsets.tolist()
                key = batch.column(1).slice(i, j - i)
                for r, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    starts = range(a, b, CHUNK)
                    for k in range(0, len(starts), CHUNKS_OUT):
                        cut = [data[x : min(b, x + CHUNK)].tobytes() for x in starts[k : k + CHUNKS_OUT]]
                        same = pa.array(np.full(len(cut), r))
                        yield pa.RecordBatch.from_arrays([key.take(same), pa.array(np.arange(k, k + len(cut)), pa.int32()), pa.array(cut, pa.binary())], ["text_key", "nth", "chunk"])

    return texts.select("text", "text_key").mapInArrow(lean(run), "text_key long, nth int, chunk binary")


def unequal(docs: DataFrame, marks: DataFrame, groups: DataFrame) -> DataFrame:
    """The fingerprints that texts with different bytes share: chunkwise comparison of all rows whose fingerprint is not alone."""
    again = groups.filter((F.col("group_size") > 1) & (F.col("n_bytes") > 0)).select(*FINGERPRINT)
    # Texts that meet in a key by chance are compared under the fingerprints of both, whose groups are then split by the texts themselves.
    keys = written(marks.select("text_key", *FINGERPRINT).distinct().join(again, FINGERPRINT, "left_semi"), "texts-in-question")
    bits = written(hash_filter(keys, "text_key"), "filter-of-texts")
    texts = passing(docs.select("text", _text_key().alias("text_key")), F.col("text_key"), bits)
    least = lambda low, high: (F.min(low).alias("low"), F.max(high).alias("high"))
    of_text = _chunks(texts).groupBy("text_key", "nth").agg(*least("chunk", "chunk"))
    seen = of_text.join(keys, "text_key").groupBy(*FINGERPRINT, "nth").agg(*least("low", "high"))
    return seen.filter("low <> high").select(*FINGERPRINT).distinct()


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of docs (doc_id, text)."""
    marks = written(fingerprints(docs), "fingerprints")
    groups = written(marks.groupBy(*FINGERPRINT).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "fingerprint-groups")
    split = written(unequal(docs, marks, groups), "fingerprint-collisions")
    if split.isEmpty():
        out = marks.join(groups, FINGERPRINT)
    else:
        sound = groups.join(split, FINGERPRINT, "left_anti")
        # The texts themselves part the groups that fingerprints don't; sha256 stands for them only as the shuffle key of their bytes.
        by_text = marks.join(split, FINGERPRINT, "left_semi").groupBy(*FINGERPRINT, "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = marks.join(sound, FINGERPRINT).unionByName(marks.join(by_text, [*FINGERPRINT, "text_sha256"]))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups keeps. Only rows whose id may be that of a dropped copy are joined; the others stay where they are."""
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LETTERS).cast("binary"), 256)
    dropped = written(exact_groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct(), "dropped-copies")
    ids = written(hash_filter(dropped.select(F.xxhash64("_id").alias("hash")), "hash"), "dropped-ids")
    of = F.xxhash64(docs["doc_id"].cast("long"))
    asked = passing(docs, of, ids)
    asked = asked.join(dropped, docs["doc_id"].eqNullSafe(dropped["_id"]) & (sha == dropped["_sha"]), "left_anti")
    return passing(docs, of, ids, "left_anti").unionByName(asked)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_groups(table(spark, sf_dir, "documents"))


LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LETTERS}')"

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
}
