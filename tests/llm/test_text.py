"""Word scans, the tokenizer codec, packing and exact dedup."""

import gc
import hashlib
import random
import sys
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, UPPER, docs, shingle_set, words, write
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timelode.llm import _common, _words, bpe, dedup_exact, packing
from timelode.llm._common import SLICE_BYTES, text_slices

ODD = ["", None, " ", "\n\t ", "a", "A b", "é È", "x" * 5000, "One two three four five six", "one TWO three four five six", "a\x0bb\x0cc\rd", " nb sp", "漢字 かな", "🙂🙂", "<|endoftext|>", "a <|endoftext|>b", "!!!", "it's we'll", "  two  spaces ", "1234 56", "aaaa" * 300]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def reference():
    return library()


def encode_all(texts):
    return [ids[a:b].tolist() for _, _, ids, at in bpe.encoded_slices(pa.array(texts, pa.string())) for a, b in zip(at, at[1:], strict=False)]


def test_shingles_are_those_of_a_plain_scan():
    for i, j, data, offsets in text_slices(pa.array(ODD, pa.string()), 64):
        h, first = _words.shingles(_words.scan(data, offsets))
        for k in range(j - i):
            assert len(set(h[first[k] : first[k + 1]].tolist())) == len(shingle_set(ODD[i + k]))
    (_, _, data, offsets), = text_slices(pa.array(["a b c d e f", "x a B c\td\ne f"]))
    h, first = _words.shingles(_words.scan(data, offsets))
    assert set(h[: first[1]].tolist()) < set(h[first[1] :].tolist())


def test_codec_on_odd_texts(reference):
    texts = [t or "" for t in ODD]
    assert encode_all(ODD) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    own = bpe.codec(bpe.TOKENIZER)
    for e in reference.encode_batch(texts, add_special_tokens=False):
        assert own.decode(np.array(e.ids, np.int64), np.array([0, len(e.ids)])) == [reference.decode(e.ids, skip_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\tab'stherling.,!1é", max_size=60)), min_size=1, max_size=5))
def test_codec_equals_the_library(texts):
    assert encode_all(texts) == [e.ids for e in _LIBRARY.encode_batch(texts, add_special_tokens=False)]


_LIBRARY = library()


def test_lossy_decode(reference):
    ids = [128, 129, 464, 50256, 200]
    assert bpe.codec(bpe.TOKENIZER).decode(np.array(ids), np.array([0, len(ids)])) == [reference.decode(ids, skip_special_tokens=False)]


def test_codec_forgets_without_harm(monkeypatch, reference):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 3)
    texts = [" ".join(words(50, s)) for s in range(4)]
    for t in texts:
        assert encode_all([t]) == [reference.encode(t, add_special_tokens=False).ids]


def test_pieces_of_letters_and_marks_of_every_kind(reference):
    texts = [" ".join(f"a{chr(c)}. {chr(c)}b {chr(c)} {chr(c)}, x.{chr(c)}" for c in range(a, a + 48)) for a in range(32, 0x560, 48)]
    assert encode_all(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_kept_pieces_are_no_python_objects():
    own = bpe.Codec()
    text = lambda first: pa.array([" ".join(f"{_spelled(i)} {_spelled(i)}," for i in range(first, first + 10_000))])
    own.encode(text(0))
    gc.collect()
    before = sys.getallocatedblocks()
    ids, _ = own.encode(text(10_000))
    gc.collect()
    assert len(own.piece) >= 39_000 and len(ids) and sys.getallocatedblocks() - before < 2_000


def _spelled(i: int) -> str:
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


@pytest.mark.parametrize("size", [8, 40, 300])
def test_long_texts_in_parts(monkeypatch, reference, size):
    monkeypatch.setattr(bpe, "ENCODE_BYTES", size)
    texts = [t or "" for t in ODD] + [" ".join(words(400, 2)), "  a\xa0 b  é c\u3000 d " * 30, "x<|endoftext|> y z " * 40]
    got = encode_all(texts)
    assert got == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    flat = np.concatenate([np.array(g, np.int64) for g in got])
    assert bpe.codec(bpe.TOKENIZER).decode(flat, np.concatenate([[0], np.cumsum([len(g) for g in got])])) == texts


def test_op8_rows(spark, tmp_path, reference):
    got = {r.doc_id: r for r in bpe.op8_bpe(spark, write(tmp_path, documents=docs(spark, ODD))).collect()}
    for i, t in enumerate(ODD):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def plain_best_fit(lengths, capacity):
    open_bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(open_bins) if r >= n]
        if fits:
            open_bins[min(fits, key=lambda k: open_bins[k])] -= n
        else:
            open_bins.append(capacity - n)
    return len(open_bins), sorted(open_bins)


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), 64, rng.randint(1, 9)]) for _ in range(rng.choice([0, 1, 40, 300]))]
    hist = {n: lengths.count(n) for n in set(lengths)}
    room, place = {}, {}
    for n, a, b, first, offset in packing.best_fit_runs(hist, 64):
        for k in range(b - a):
            place[n, a + k] = (first + k, offset)
            room.setdefault(first + k, []).append((offset, n))
    assert len(place) == len(lengths)
    for parts in room.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 64
    bins, left = plain_best_fit(lengths, 64)
    assert (len(room), sorted(64 - sum(n for _, n in p) for p in room.values())) == (bins, left)


@pytest.mark.parametrize(("hist", "capacity", "sequences"), [({11: 2, 4: 2, 3: 3}, 20, 2), ({424: 2000, 80: 1000, 58: 1500}, 1024, 1000), ({40: 9, 33: 20, 10: 31, 7: 17, 3: 50}, 64, None)])
def test_open_bins_are_filled_before_the_next(hist, capacity, sequences):
    room, numbers = {}, {}
    for n, a, b, first, offset in packing.best_fit_runs(hist, capacity):
        numbers.setdefault(n, []).extend(range(a, b))
        for k in range(b - a):
            room.setdefault(first + k, []).append((offset, n))
    assert {n: sorted(v) for n, v in numbers.items()} == {n: list(range(c)) for n, c in hist.items()}
    for parts in room.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    bins, left = plain_best_fit([n for n, c in hist.items() for _ in range(c)], capacity)
    assert (len(room), sorted(capacity - sum(n for _, n in p) for p in room.values())) == (bins, left)
    assert sequences in (None, bins)


def test_op7_rows(spark, tmp_path, reference):
    texts = [*ODD, " ".join(words(3000, 1)), *[" ".join(words(k, k)) for k in range(1, 200, 7)]]
    rows = packing.op7_packing(spark, write(tmp_path, documents=docs(spark, texts).repartition(5))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()] and sum(n for _, n in parts) <= 1024
    assert len(bins) == plain_best_fit([r.length for r in rows], 1024)[0]


def test_fingerprints_compose():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 40000).astype(np.uint8)
    whole = dedup_exact.combine(*dedup_exact.chunk_hashes(data, np.array([0, len(data)])))[:, 0].tolist()
    for k, (p, b) in enumerate(zip(dedup_exact.PRIMES.tolist(), dedup_exact.BASES.tolist(), strict=True)):
        h = 0
        for x in data.tolist():
            h = (h * b + x + 1) % p
        assert h == whole[k]


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    return sorted((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def test_op5_rows(spark, tmp_path):
    texts = [*ODD, "ABC", "abc", "Abc", "x" * 20000 + "y", "X" * 20000 + "Y", "x" * 20000 + "z", "İ", "i̇"] + ["copy me"] * 40
    got = dedup_exact.op5_exact_dedup(spark, write(tmp_path, documents=docs(spark, texts).repartition(7)))
    assert sorted(map(tuple, got.collect())) == expected_groups(enumerate(texts))


def test_collisions_are_told_apart(spark, monkeypatch):
    def clash(d):
        base = dedup_exact._real(d)
        return base.withColumns({"f1": F.lit(1).cast("long"), "f2": F.lit(1).cast("long")})

    monkeypatch.setattr(dedup_exact, "_real", dedup_exact.fingerprints, raising=False)
    monkeypatch.setattr(dedup_exact, "fingerprints", clash)
    texts = ["ab", "ba", "ab", "cc", "abc", "abc"]
    assert sorted(map(tuple, dedup_exact.exact_groups(docs(spark, texts)).collect())) == expected_groups(enumerate(texts))


def test_null_ids_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a", None, None, None), (3, "a", None, None, None), (3, "a", None, None, None), (None, "b", None, None, None)], DOCS)
    got = sorted(map(tuple, dedup_exact.exact_groups(rows).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (None, None, 1, True)], key=str)
    assert dedup_exact.keep_one(rows.withColumn("keep_id", F.lit(1))).columns == [*rows.columns, "keep_id"]
    assert sorted(((r.doc_id, r.text) for r in dedup_exact.keep_one(rows).collect()), key=str) == [(3, "a"), (3, "a"), (None, "b")]


def test_a_repeated_id_costs_its_rows_only(spark):
    texts = [f"text {k % 300} " + "z" * 20 for k in range(600)] + [" ", "null id", "null id"]
    rows = spark.createDataFrame([(7 if k < 600 else None, t, None, None, None) for k, t in enumerate(texts)], DOCS)
    marks = dedup_exact.fingerprints(rows)
    groups = marks.groupBy(*dedup_exact.FINGERPRINT).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    assert dedup_exact.unequal(rows, marks, groups).count() == 0
    keys = marks.select("text_key", *dedup_exact.FINGERPRINT).distinct()
    assert dedup_exact._chunks(rows.select("text", dedup_exact._text_key().alias("text_key")).join(keys, "text_key")).count() == len(texts)
    got = dedup_exact.exact_groups(rows).collect()
    assert len(got) == len(texts) and {r.group_size for r in got if r.doc_id == 7} == {2} and sorted(r.group_size for r in got if r.doc_id is None) == [1, 2, 2]


def test_the_filter_loses_no_hash(spark, monkeypatch):
    rows = spark.range(400).select(F.xxhash64("id").alias("h"), "id").withColumns({"word": F.lit(1), "bits": F.lit("x")})
    for words_ in (_common.FILTER_WORDS, 2):  # roomy, and nearly full
        monkeypatch.setattr(_common, "FILTER_WORDS", words_)
        bits = _common.hash_filter(rows.filter("id % 4 = 0"), "h")
        assert bits.count() <= words_
        some = {r.id for r in _common.passing(rows, F.col("h"), bits).collect()}
        rest = {r.id for r in _common.passing(rows, F.col("h"), bits, "left_anti").collect()}
        assert set(range(0, 400, 4)) <= some and not some & rest and some | rest == set(range(400))


def test_long_texts_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, n)) for n in (3, 4000, 1, 0, 900)] + ["x" * 3000 + " y"]
    want = []
    for _, _, data, offsets in text_slices(pa.array(texts)):
        want.append((_words.scan(data, offsets), dedup_exact.chunk_hashes(data, offsets)))
    for k in ("BLOCK", "_UP", "_DOWN"):
        monkeypatch.setattr(_words, k, 64 if k == "BLOCK" else getattr(_words, k)[:64])
    monkeypatch.setattr(dedup_exact, "BLOCK", 8192)
    for (_, _, data, offsets), (words_, chunks) in zip(text_slices(pa.array(texts)), want, strict=True):
        got = _words.scan(data, offsets)
        assert all(np.array_equal(getattr(got, k), getattr(words_, k)) for k in ("starts", "ends", "doc", "first"))
        small = got.hashes()
        for k, part in enumerate(dedup_exact.chunk_hashes(data, offsets)):
            assert np.array_equal(part, chunks[k])
    monkeypatch.undo()
    assert np.array_equal(small, words_.hashes())
    assert len(set(small.tolist())) == len({w for t in texts for w in t.lower().split()})


def test_a_text_beyond_a_slice():
    text = " ".join(words(400_000, 3, 10**6))
    assert len(text) > 2 * SLICE_BYTES
    (_, _, data, offsets), = text_slices(pa.array([text]))
    h, _ = _words.shingles(_words.scan(data, offsets))
    assert len(set(h.tolist())) == len(shingle_set(text))


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh", "the", "é", "\u4e00\u4e8c\u4e09\u56db\u4e94"])
def test_long_words_in_segments(reference, letters):
    rng = np.random.default_rng(len(letters))
    own = bpe.codec(bpe.TOKENIZER)
    for n in (191, 193, 500, 3001):
        for text in ("".join(rng.choice(list(letters), n)), (letters * n)[:n]):
            data = np.frombuffer(text.encode(), np.uint8)
            assert own._encode_run(data).tolist() == own._merge_long(text.encode()) == reference.encode(text, add_special_tokens=False).ids


def test_a_long_run_of_letters_takes_seconds():
    rng = np.random.default_rng(0)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 340_000)))
    began = time.time()
    (_, _, ids, _), = bpe.encoded_slices(pa.array([text]))
    assert time.time() - began < 60 and bpe.codec(bpe.TOKENIZER).decode(ids, np.array([0, len(ids)])) == [text]


def test_encoding_a_batch_takes_bounded_memory():
    """What a worker holds for a batch of 8 MB beyond its model, in a process of its own: 26 to 28 MB with slices of 2 MB, 55 with slices of 4 MB."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import random, resource
import pyarrow as pa
from timelode.llm import bpe
rng = random.Random(3)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(20_000)]
batch = pa.array([" ".join(rng.choices(words, k=150)) for _ in range(8_500)])
list(bpe.encoded_slices(batch.slice(0, 50), bpe.TOKENIZER))
most = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
before = most()
n = sum(len(ids) for _, _, ids, _ in bpe.encoded_slices(batch, bpe.TOKENIZER))
print(batch.nbytes >> 20, n, most() - before)
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=120)
    size, n, grown = map(int, run.stdout.split())
    assert size >= 7 and n > 1_000_000 and grown < 42, (size, n, grown)
