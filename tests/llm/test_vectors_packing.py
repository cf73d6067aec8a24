"""Whitening, clustering by differences and packing by least squares, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, words, write
from pyspark.sql import functions as F

from timelode.llm import bpe, centroids, packing_nnls, whitening
from timelode.llm._vectors import column_sums, longs, square_sums


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, cluster int, x int")


def some(n, d, seed=0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    return rng.normal(size=(n, d)) @ mix / d


ODD = [None, [], [1.0, None], [float("nan")] * 2, [float("inf"), 0.0]]


def plain_whitening(rows):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))) for r in x]
    centred = np.array((n * x - sums) / n, float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, values[::-1], basis[:, ::-1]


def test_whitening_equals_a_plain_version(spark, tmp_path):
    x = some(300, 12)
    rows = [(i, v.tolist(), "c", 1, 2) for i, v in enumerate(x)] + [(1000 + i, v, "c", 1, 2) for i, v in enumerate(ODD)]
    rows += [(None, x[5].tolist(), None, None, None), (3, x[3].tolist(), None, None, None), (2000, [1.0] * 7, None, None, None)]
    got = whitening.op11_whitening(spark, write(tmp_path, embeddings=vectors(spark, rows).repartition(5))).collect()
    used = [*x, x[5], x[3]]
    deviation, centred, values, basis = plain_whitening(used)
    assert len(got) == 8 * len(used) and {r.component for r in got} == set(range(1, 9)) and {r.n for r in got} == {302}
    for r in got:
        k = 300 if r.vec_id is None else r.vec_id
        assert r.deviation == deviation[k]
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
    by = {(r.vec_id, r.component): r.whitened for r in got}
    for c in range(1, 9):
        want = centred @ basis[:, c - 1] / np.sqrt(values[c - 1])
        sign = 1 if by[0, c] * want[0] > 0 else -1
        assert [by[i, c] * sign for i in range(300)] == pytest.approx(want[:300].tolist(), rel=1e-8, abs=1e-9)


def test_whitening_of_few_and_flat_vectors(spark):
    assert whitening.whiten(vectors(spark, [(1, None, None, None, None)])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25], None, None, None)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 5.0], None, None, None) for k in range(10)]).repartition(3)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and {round(r.explained, 9) for r in flat if r.component == 1} == {1.0}
    assert max(r.identity_error for r in flat) < 1e-9
    far = whitening.whiten(vectors(spark, [(k, [1e12 * k, float(k * k)], None, None, None) for k in range(5)])).collect()
    assert {r.deviation for r in far} == {None} or all(r.deviation is None for r in far if r.vec_id in (0, 4))
    assert all(math.isfinite(r.whitened) for r in far if r.component == 1)


def test_whitening_does_not_depend_on_partitions(spark):
    rows = vectors(spark, [(i, v.tolist(), None, None, None) for i, v in enumerate(some(200, 6, 4))])
    a, b = (whitening.fit(whitening.usable(rows.repartition(n)), 6) for n in (1, 9))
    assert a.sums.tolist() == b.sums.tolist() and np.allclose(a.values, b.values, rtol=1e-12)


def test_exact_sums():
    big = np.array([[1 << 61, -5], [1 << 61, 7], [1 << 61, 0]])
    assert column_sums(big).tolist() == [3 << 61, 2] and square_sums(big).tolist() == [(1 << 122) + 25, (1 << 122) + 49, 1 << 122]
    assert longs(square_sums(big)).to_pylist() == [None] * 3 and longs(np.array([1, 2])).to_pylist() == [1, 2]
    assert square_sums(np.array([[3, 4], [0, -2]])).tolist() == [25, 4]


def plain_lloyd(rows, k, rounds):
    """Assign and move, over all vectors in each round."""
    x = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    own = [v for _, v in sorted(x, key=key)[:k]]
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    assign = lambda: [min((apart(v, c), j) for j, c in enumerate(own)) for _, v in x]
    for _ in range(rounds):
        near = assign()
        for j in range(len(own)):
            mine = [v for (_, v), (_, c) in zip(x, near, strict=True) if c == j]
            if mine:
                own[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    near = assign()
    inertia = Counter()
    for d, j in near:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in own]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(x, near, strict=True)), key=str)


def test_clusters_equal_plain_rounds(spark, tmp_path):
    x = some(260, 64, 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500 + i, x[7].tolist()) for i in range(60)] + [(7, x[7].tolist()), (None, x[9].tolist())]
    odd = [(900 + i, v) for i, v in enumerate([*ODD, [1.0] * 63, [1.0] * 65, [*([0.0] * 63), None], [*([0.0] * 63), float("nan")]])]
    frame = vectors(spark, [(*r, "c", 9, 9) for r in rows + odd]).repartition(6)
    got = centroids.op13_centroids(spark, write(tmp_path, embeddings=frame))
    assert sorted(map(tuple, got.collect()), key=str) == plain_lloyd(rows, 8, 10)


def test_clusters_of_few_equal_and_huge_vectors(spark):
    assert centroids.clustered(vectors(spark, [(1, [0.0], None, None, None)])).count() == 0
    few = [(i, [float(i)] * 64) for i in range(3)]
    same = [(i, [0.25] * 64) for i in range(20)]
    for rows in (few, same):
        got = centroids.clustered(vectors(spark, [(*r, None, None, None) for r in rows])).collect()
        assert sorted(map(tuple, got), key=str) == plain_lloyd(rows, 8, 10)
    huge = [(i, [float(i) * 1e12] * 64, None, None, None) for i in range(20)]
    state, _ = centroids.cluster(vectors(spark, huge))
    want = plain_lloyd([r[:2] for r in huge], 8, 10)
    assert sorted(((r.vec_id, r.cluster, int(r.distance)) for r in state.collect()), key=str) == sorted((w[:3] for w in want), key=str)
    assert any(r.distance is None for r in centroids.clustered(vectors(spark, huge)).collect())


def test_only_moved_vectors_are_compared_with_all(monkeypatch):
    rng = np.random.default_rng(5)
    x, old = rng.integers(-9, 9, (80, 3)), rng.integers(-9, 9, (4, 3))
    full = lambda c: tuple(np.array(v) for v in zip(*(min((int(((r - k) ** 2).sum()), j) for j, k in enumerate(c)) for r in x), strict=True))
    d, near = full(old)
    fresh = old.copy()
    fresh[2] += 3
    compared = []
    monkeypatch.setattr(centroids, "apart", lambda rows, c: compared.append(len(rows)) or ((rows - c) ** 2).sum(axis=1))
    cluster, distance = centroids.nearest(x, fresh, near, d, np.array([False, False, True, False]))
    want_d, want = full(fresh)
    assert cluster.tolist() == want.tolist() and distance.tolist() == want_d.tolist()
    assert sum(compared) == 4 * int((near == 2).sum()) + int((near != 2).sum())


@pytest.mark.parametrize("seed", range(6))
def test_least_squares_plans_fill_every_sequence(seed):
    rng, window = random.Random(seed), 64
    histogram = np.zeros(window + 1, np.int64)
    for _ in range(rng.randint(1, 400)):
        histogram[rng.choice([rng.randint(1, window), rng.randint(1, 9), 37, window])] += rng.choice([1, 1, 50])
    plan = packing_nnls.planned(histogram, window)
    keys = list(map(tuple, plan.runs[:, :2].tolist()))
    filled, cut = {}, 0
    for length in range(1, window + 1):
        for number in range(int(histogram[length])):
            if number < plan.cut_from[length]:
                k = max(i for i, key in enumerate(keys) if key <= (length, number))
                assert keys[k][0] == length
                spots = [(plan.runs[k, 2], plan.runs[k, 3] + number - plan.runs[k, 1], plan.runs[k, 4], length)]
            else:
                cut += length
                parts = packing_nnls.binary_parts(length)
                spots = [(p.bit_length() - 1, plan.cut_base[length, p.bit_length() - 1] + number - plan.cut_from[length], 0, p) for p in parts]
            for size, block, offset, n in spots:
                seq, at = plan.sequences(np.array([size]), np.array([block]))
                filled.setdefault(int(seq[0]), []).append((int(at[0] + offset), n))
    short = []
    for parts in filled.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()
        total = sum(n for _, n in parts)
        if total < window:
            short.append(total)
        assert total & (total - 1) == 0 and total <= window
    assert len(short) == len(set(short)) and sum(n for p in filled.values() for _, n in p) == int((histogram * np.arange(window + 1)).sum())
    assert sorted(filled) == list(range(len(filled)))


def test_least_squares_solution_is_optimal():
    rng = np.random.default_rng(1)
    histogram = np.append(0, rng.integers(0, 30, 32))
    combos = packing_nnls.combinations(histogram, 32)
    assert (combos[:, 1:].sum(axis=1) == combos[:, 0]).all() and len(np.unique(combos, axis=0)) == len(combos)
    want = {(s, *t) for s in (1, 2, 4, 8, 16, 32) for a in range(1, s + 1) for b in range(a + 1) for t in [(a, b, s - a - b)] if 0 <= t[2] <= b and all(histogram[v] or not v for v in t)}
    assert want == set(map(tuple, combos.tolist()))
    x = packing_nnls.repeats(histogram, combos)
    a = np.zeros((33, len(combos)))
    for k in (1, 2, 3):
        np.add.at(a, (combos[:, k], np.arange(len(combos))), 1)
    slope = a[1:].T @ (a[1:] @ x - histogram[1:])
    assert (x >= 0).all() and slope.min() > -0.05 * histogram.max() and abs(slope * x).max() < 0.05 * histogram.max() * max(1, x.max())
    counts, left = packing_nnls.rounded(x, combos, histogram)
    assert (a[1:] @ counts + left[1:] == histogram[1:]).all() and (left >= 0).all()


def test_most_of_a_corpus_is_packed_uncut():
    rng = np.random.default_rng(0)
    lengths = rng.lognormal(6, 0.8, 20_000).astype(int) % 2048
    histogram = np.bincount(lengths[lengths > 0], minlength=2049)
    plan = packing_nnls.planned(histogram)
    assert (histogram - plan.cut_from)[1:].sum() < 0.02 * histogram.sum()


def test_op12_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(words(rng.choice([3, 40, 300, 700, 3000]), i, 5000)) for i in range(70)] + ["", None, "a", "same text"] + ["copy me " * 60] * 50
    frame = docs(spark, texts).union(docs(spark, ["other text under an id"], 3)).union(docs(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    frame = frame.withColumns({"length": F.lit("clash"), "part": F.lit(1)}).repartition(5)
    rows = packing_nnls.op12_packing(spark, write(tmp_path, documents=frame)).collect()
    codec, texts_of = bpe.codec(), {}
    for r in frame.collect():
        texts_of.setdefault(r.doc_id, []).append(np.append(codec.encode(pa.array([r.text or ""]))[0], 1).astype("<u4"))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts_of.keys()
    for i, own in by.items():
        want = Counter()
        for ids in texts_of[i]:
            mine = [r for r in own if r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
            assert sum(r.length for r in mine) == len(ids) and sorted(r.start for r in mine) == np.cumsum([0, *(r.length for r in sorted(mine, key=lambda r: r.start))])[:-1].tolist()
            want[len(ids)] += len(ids)
        assert sum(r.length for r in own) == sum(want.values())
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist() and total <= 2048 and total & (total - 1) == 0
    assert sum(sum(n for _, n in p) < 2048 for p in bins.values()) <= 11


def test_op12_without_rows(spark, tmp_path):
    assert packing_nnls.op12_packing(spark, write(tmp_path, documents=docs(spark, []))).count() == 0
