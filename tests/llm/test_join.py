"""The shingle join and components against all pairs."""

import random

import pytest
from helpers import DOCS, brute_components, docs, shingle_set, words, write
from pyspark.sql import functions as F

from timelode.llm import components as cc
from timelode.llm import ngram_join as nj


def corpus(seed):
    """Near copies by edits, short texts around the light boundary, a passage in many texts, copies, odd rows."""
    rng = random.Random(seed)
    out = [None, "", " \n", "one", "one two", "One TWO", "a b c d", "A  b\tc d"]
    shared = words(30, 99)
    for _ in range(12):
        base = words(rng.choice([8, 12, 30, 60, 120]), rng.random())
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(w if rng.random() < 0.7 else w + words(rng.randint(0, 3), rng.random())))
    for _ in range(10):
        out.append(" ".join(words(rng.randint(10, 60), rng.random()) + shared))
    for _ in range(20):
        w = words(11, 5)
        w[rng.choice([0, 10, 5])] = f"m{rng.randrange(4)}"
        out.append(" ".join(w[: rng.randint(5, 11)]))
    base = words(80, 77)
    for k in range(40):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(80)] = f"g{k}"
        out.append(" ".join(w))
    return out + ["same text of six words here"] * 15


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, tmp_path, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(nj, "boundary", lambda share: nj.LIGHT_MOST)
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.op1_ngram_join(spark, write(tmp_path, documents=docs(spark, texts).repartition(4))).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_odd_ids(spark):
    text = "a b c d e f g"
    rows = spark.createDataFrame([(None, text, None, None, None), (7, text, None, None, None), (7, text, None, None, None), (9, text.upper(), None, None, None), (None, None, None, None, None)], DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 3, None), (7, 3, 7), (7, 3, 7), (9, 3, 7), (None, 0, None)], key=str)
    assert nj.near_duplicates(rows.limit(0)).count() == 0


def test_needs_and_boundary():
    for n in range(1, 60):
        for m in range(n, 60):
            o = nj.need(n, m)
            assert 100 * o >= 80 * (n + m - o) and 100 * (o - 1) < 80 * (n + m - o + 1)
    assert nj.boundary(0.0) < nj.boundary(1.0) <= nj.LIGHT_MOST


def test_sketches_never_refuse_a_link(spark):
    import numpy as np

    rng, rows = np.random.default_rng(2), []
    for n in (10, 200, 511, 2300):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for cut in (0, 1, len(a) // 11, len(a) // 9, len(a) // 2):
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, cut).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            rows.append((len(a), nj.sketch(a).astype(np.int64).tolist(), len(b), nj.sketch(b).astype(np.int64).tolist(), 100 * common >= 80 * (len(a) + len(b) - common)))
    frame = spark.createDataFrame(rows, "n long, s array<long>, m long, t array<long>, link boolean").withColumn("x", F.struct("n", F.col("s").alias("sketch"))).withColumn("y", F.struct(F.col("m").alias("n"), F.col("t").alias("sketch")))
    got = frame.select("link", nj._near("x", "y", positions=False).alias("near"), "n", nj._apart("x", "y").alias("apart"), nj._most_apart(F.col("n"), F.col("m")).alias("most")).collect()
    assert all(r.near for r in got if r.link) and any(not r.near for r in got)


@pytest.mark.parametrize("blocks", [2048, 3])
def test_rounds_and_blocks_change_no_result(spark, tmp_path, blocks, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(nj, "LONG", 3)
    monkeypatch.setattr(nj, "ROUNDS", 1 if blocks == 3 else 4)
    texts = corpus(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_duplicates(docs(spark, texts).repartition(3)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_one_id_with_many_texts(spark):
    rng = random.Random(5)
    texts = [" ".join(words(rng.randint(20, 40), k)) for k in range(200)]
    rows = spark.createDataFrame([(5, t, None, None, None) for t in texts * 2] + [(9, max(texts, key=lambda t: len(t.split())), None, None, None)], DOCS)
    got = nj.near_duplicates(rows).collect()
    assert len(got) == 401 and {r.component_id for r in got if r.doc_id == 5} == {5}
    assert sorted(r.n_shingles for r in got if r.doc_id == 5) == sorted(len(shingle_set(t)) for t in texts * 2)


def test_merging_rounds(spark):
    one = spark.createDataFrame([(1, 2), (3, 4), (8, 9)], "a long, b long")
    two = spark.createDataFrame([(4, 2), (2, 4), (1, 2), (9, 10)], "a long, b long")
    got = {r.node: r.label for r in cc.merged(cc.merged(None, one), two).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.node: r.label for r in cc.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
