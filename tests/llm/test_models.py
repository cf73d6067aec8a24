"""Toxicity, quality and language models, nearest neighbours, preferences and URL rules."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, docs, words, write
from pyspark.sql import functions as F

from timelode.llm import ann, langid, preferences, quality, toxicity, url_rules
from timelode.llm import _words
from timelode.llm._common import text_slices


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def toxic_corpus(n=500):
    rng, texts, flags = random.Random(4), [], []
    for i in range(n):
        w, bad = words(rng.randint(5, 80), i), rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "AWFUL", "nasty!"]))
        texts.append(" ".join(w))
        flags.append(int(bad))
    return texts, flags


def test_toxicity_on_held_out(spark, tmp_path):
    texts, flags = toxic_corpus()
    texts += ["", None, "vile awful nasty " * 10000]
    labels = spark.createDataFrame([(i, 1, f) for i, f in enumerate(flags)] + [(1, 1, None), (None, 1, 1), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.op4_toxicity(spark, write(tmp_path, documents=docs(spark, texts).withColumn("y", F.lit(1)), labels=labels)).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (fold(i, 5) == 0) for i, r in rows.items())
    held = [i for i in range(len(flags)) if rows[i].held_out]
    assert np.mean([rows[i].predicted == flags[i] for i in held]) > 0.95
    assert rows[len(texts) - 1].predicted == 1 and rows[len(texts) - 3].score == rows[len(texts) - 2].score < 0.5


def test_toxicity_weights_are_sparse_and_ignore_held_out_labels(spark):
    texts, flags = toxic_corpus()
    frame = lambda fs: spark.createDataFrame([(i, 1, f) for i, f in enumerate(fs)], "doc_id long, quality int, toxic int")
    a = toxicity.fit(docs(spark, texts), frame(flags))
    b = toxicity.fit(docs(spark, texts).repartition(5), frame([1 - f if fold(i, 5) == 0 else f for i, f in enumerate(flags)]))
    assert 0 < len(a.index) < 2000 and a.index.tolist() == b.index.tolist() and np.allclose(a.weight, b.weight)


@pytest.mark.parametrize("op", [toxicity.op4_toxicity, quality.op9_quality, langid.op2_langid])
def test_models_without_anything_to_learn(spark, tmp_path, op):
    assert op(spark, write(tmp_path / "none", documents=docs(spark, []))).count() == 0
    rows = op(spark, write(tmp_path / "some", documents=spark.createDataFrame([(1, "a b", None, None, None), (None, None, None, None, None)], DOCS))).collect()
    assert len(rows) == 2
    if "lang_pred" in rows[0].asDict():
        assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    else:
        assert {r.score for r in rows} == {0.5}


def test_quality_on_held_out(spark, tmp_path):
    rng, texts, flags = random.Random(9), [], []
    for i in range(600):
        w, good = words(rng.randint(5, 120), i), rng.random() < 0.7
        junk = rng.choice([lambda x: x.upper() + "!!", lambda x: x + "***", lambda x: "| " + x])
        texts.append(" ".join(w) if good else " ".join(map(junk, w)))
        flags.append(int(good))
    labels = spark.createDataFrame([(i, f, 0) for i, f in enumerate(flags)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.op9_quality(spark, write(tmp_path, documents=docs(spark, [*texts, "", None, "word " * 50000]), labels=labels)).collect()}
    held = [i for i in range(600) if rows[i].held_out]
    assert len(rows) == 603 and {fold(i, 4) for i in held} == {2}
    assert np.mean([rows[i].predicted == flags[i] for i in held]) > 0.97


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((800, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    f = quality.grow(x, y)
    assert ((f.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = f.base
        for t in range(len(f.feature)):
            k = 0
            while f.left[t, k] != k:
                k = f.right[t, k] if row[f.feature[t, k]] > f.threshold[t, k] else f.left[t, k]
            total += f.value[t, k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], f.score(x[:50]))


LANGS = {"aa": "bado keru mino salo tane".split(), "bb": "schtor pflin chwerk unsch grach".split(), "cc": "ção lhine ñora éxan qüil".split()}


def tongue(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(LANGS[lang]) + rng.choice(LANGS[lang])[:3] for _ in range(n))


def test_language_of_documents_and_words(spark, tmp_path):
    names = [list(LANGS)[i % 3] for i in range(300)]
    texts = [tongue(k, 5 + i % 90, i) for i, k in enumerate(names)]
    extra = ["", None, "123 !!", tongue("bb", 20000, 1)]
    rows = {r.doc_id: r for r in langid.op2_langid(spark, write(tmp_path, documents=docs(spark, texts + extra, langs=names + ["aa", None, "bb", None]))).collect()}
    assert np.mean([rows[i].lang_pred == names[i] for i in range(300) if rows[i].held_out]) > 0.97
    assert [rows[300 + k].lang_pred for k in range(4)] == ["und", "und", "und", "bb"]
    field = langid.learn(texts[:240], names[:240])
    mixed = langid.label_words([tongue("aa", 8, 5) + " " + tongue("bb", 8, 6)], field)[0]
    assert np.mean([k == ("aa" if i < 8 else "bb") for i, (_, k) in enumerate(mixed)]) > 0.9


def test_blocked_forward_backward_equals_recursion():
    rng = np.random.default_rng(1)
    field = langid.Field(["a", "b", "c"], np.zeros((4, 3)), rng.normal(size=(3, 3)))
    lengths = [1, 31, 32, 33, 100, 7]
    first = np.concatenate([[0], np.cumsum(lengths)])
    pot = rng.normal(size=(first[-1], 3)) * 2
    got, move = field.marginals(pot, first), np.exp(field.transition)
    for a, b in zip(first, first[1:], strict=False):
        e = np.exp(pot[a:b])
        ahead, back = np.zeros_like(e), np.ones_like(e)
        prev = np.ones(3) / 3
        for t in range(len(e)):
            ahead[t] = prev = (prev @ move) * e[t] / ((prev @ move) * e[t]).sum()
        for t in range(len(e) - 2, -1, -1):
            back[t] = move @ (e[t + 1] * back[t + 1])
            back[t] /= back[t].sum()
        want = ahead * back
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[500]
    odd = [(3001, None, 0), (3002, [0.0] * 16, 0), (3003, [float("nan")] + [1.0] * 15, 0), (3004, [float("inf")] + [1.0] * 15, 0), (3005, [1.0, None] + [1.0] * 14, 0), (3006, [9.0] * 3, 0), (None, [1.0] * 16, 0), (3020, [], 0)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = ann.op6_ann(spark, write(tmp_path, embeddings=vectors(spark, rows + odd))).collect()
    by, xd, hits = {}, x.astype(float), []
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 3000, 20))
    for q, found in by.items():
        score = (xd * xd[q]).sum(axis=1)
        order = [i for i in np.lexsort([np.arange(len(x)), -score]) if i != q][:20]
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and q not in {r.vec_id for r in found}
        assert all(abs(r.score - score[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits.append(len({r.vec_id for r in found} & set(order)) / 20)
    assert np.mean(hits) >= 0.9
    assert {r.vec_id for r in by[500]} == set(range(501, 521)) or np.linalg.norm(xd[500]) ** 2 < np.sort((xd * xd[500]).sum(1))[-20]


def test_neighbours_of_few(spark, tmp_path):
    few = vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (20, [0.0, 1.0], 0)])
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.op6_ann(spark, write(tmp_path, embeddings=few)).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 2, 0.5), (20, 3, 0, 0.0)]
    assert ann.op6_ann(spark, write(tmp_path / "e", documents=docs(spark, []))).count() == 0
    assert ann.op6_ann(spark, write(tmp_path / "one", embeddings=vectors(spark, [(0, [1.0], 0)]))).count() == 0


def test_preferences(spark, tmp_path):
    say = lambda c, *turns: [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows = say(0, ("user", "hi"), ("assistant", "yes"), ("user", "ok")) + say(1, ("user", "hi"), ("assistant", "no")) + say(2, ("user", "a")) + say(4, ("user", "q")) + say(5, ("user", "q")) + say(6, (None, None)) + say(7, ("assistant", "x" * 5)) + [(None, 0, "user", "z"), (1, 1, "assistant", "no")]
    got = {r.pair_id: r for r in preferences.op3_preferences(spark, write(tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert sorted(got) == [0, 2, 3]
    r = got[0]
    assert r.common_turns == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n" and r.chosen.startswith("<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user")
    assert r.rejected.count("no") == 2
    assert (got[2].common_turns, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", "")
    head, body = len("<|im_start|>assistant\n"), len("xxxxx<|im_end|>\n")
    assert got[3].rejected_mask == f"{head}:0,{body}:1" and got[3].common_turns == 0
    for text, runs in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
        assert sum(int(x.split(":")[0]) for x in runs.split(",")) == len(text)


URLS = {
    "https://a.net/x": ("a.net", "/x", "net/", "block"),
    "https://a.net": ("a.net", "", None, "allow"),
    "http://EXAMPLE.net/en/1?x=/y": ("example.net", "/en/1", "example.net/en/", "allow"),
    "http://w.example.com/de/": ("w.example.com", "/de/", "example.com/de/", "block"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
    "http://b.org/fr/2#z": ("b.org", "/fr/2", "org/fr/", "allow"),
    "x://h?p=1://q/r": ("h", "", None, "allow"),
    "no scheme/a": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
}


def test_url_rules(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)] + [(0, "https://a.net/x", None)], "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = [(r.page_id, (r.host, r.path, r.rule, r.verdict)) for r in url_rules.op10_url_rules(spark, write(tmp_path, pages=pages)).collect()]
    assert sorted(got, key=str) == sorted([*enumerate(URLS.values()), (0, URLS["https://a.net/x"])], key=str)


def test_mined_rules_block_what_they_hold(spark, tmp_path):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        host = rng.choice(["casino", "pills"]) + ".example.com" if bad else rng.choice(["news", "blog"]) + ".example.com"
        rows.append((i, f"https://{host}/en/{i}?ref=x", None))
        labels.append((i, 0 if bad and rng.random() < 0.9 else 1, 0))
    rows.append((900, "https://m.casino.example.com/es/5", None))
    folder = write(tmp_path, pages=spark.createDataFrame(rows, "page_id long, url string, html string"), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.page_id: r.verdict for r in url_rules.op10_url_rules(spark, folder).collect()}
    pages = {r[0]: r[1] for r in rows}
    assert all(v == ("block" if "casino" in pages[i] or "pills" in pages[i] else "allow") for i, v in got.items())
    keyed = url_rules.with_host_path(url_rules.labelled_pages(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("pages", "labels")))).withColumn("tokens", url_rules.tokens())
    assert blocked_by(url_rules.mined_rules(keyed), keyed) == plain_rules(keyed)


def plain_rules(keyed, least=None, confidence=None):
    """Token sets of keyed rows that hold some set of tokens of enough support and confidence, by counting all sets."""
    from itertools import combinations

    rows = [(frozenset(r.tokens), r.block) for r in keyed.collect()]
    least = max(url_rules.LEAST_PAGES, url_rules.SUPPORT * len(rows))
    all_, bad = {}, {}
    for tokens, block in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                all_[c] = all_.get(c, 0) + 1
                bad[c] = bad.get(c, 0) + block
    rules = [set(c) for c in all_ if bad[c] >= least and bad[c] >= url_rules.CONFIDENCE * all_[c]]
    return {t for t, _ in rows if any(r <= t for r in rules)}


def blocked_by(index, keyed):
    sets = keyed.withColumn("signature", F.concat_ws("\n", "tokens"))
    found = {r.signature for r in url_rules.blocked_sets(sets, index).collect()} if index is not None else set()
    return {frozenset(s.split("\n")) for s in found}


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_rules_equal_plain_counting(spark, seed):
    rng, rows = random.Random(seed), []
    for _ in range(150):
        t = {f"host:{rng.choice('ab')}", "scheme:https"} | {f"path:{rng.choice('xyz')}" for _ in range(2)}
        if "path:x" in t:
            t |= {"key:p", "key:q"}
        rows.append((sorted(t), rng.random() < (0.9 if "path:x" in t and "host:a" in t else 0.3)))
    keyed = spark.createDataFrame(rows, "tokens array<string>, block boolean")
    assert blocked_by(url_rules.mined_rules(keyed), keyed) == plain_rules(keyed)
    # A page that the labels don't know, with one of the tokens that always came together.
    more = spark.createDataFrame([(["host:a", "key:q", "path:x"], True), (["host:b", "key:q"], True)], "tokens array<string>, block boolean")
    assert frozenset(["host:a", "key:q", "path:x"]) in blocked_by(url_rules.mined_rules(keyed), more)


def test_twenty_constant_query_keys(spark):
    keys = [f"key:k{i}" for i in range(20)]
    rows = [([*keys, "host:a"], True)] * 30 + [(["host:b"], False)] * 20
    index = url_rules.mined_rules(spark.createDataFrame(rows, "tokens array<string>, block boolean"))
    assert {r.token for r in index.collect()} == {*keys, "host:a"} and index.select("rule_id").distinct().count() == 1
    assert url_rules.mined_rules(spark.createDataFrame([([], True)] * 20, "tokens array<string>, block boolean")) is None


def test_repeated_ids_of_models(spark):
    texts, flags = toxic_corpus(200)
    labels = spark.createDataFrame([(i, f, f) for i, f in enumerate(flags)], "doc_id long, quality int, toxic int")
    rows = docs(spark, texts)
    again = rows.unionByName(rows.filter("doc_id < 50")).unionByName(rows.filter("doc_id = 7").select("doc_id", F.lit("").alias("text"), "lang", "source", "n_chars"))
    assert toxicity.labelled_sample(again, labels.union(labels), "toxic", F.lit(True), 1000).count() == 200
    a, b = toxicity.fit(rows, labels), toxicity.fit(again, labels.union(labels))
    assert a.index.tolist() == b.index.tolist() and np.allclose(a.weight, b.weight)
    few = toxicity.fit(rows, labels, most=100)
    assert len(few.index) < len(a.index)
    # A huge text is passed over; the labelled rows behind it still count.
    huge = rows.unionByName(docs(spark, [" ".join(f"u{k}" for k in range(3000))] * 9, first=900))
    more = labels.union(spark.createDataFrame([(i, 1, 1) for i in range(900, 909)], "doc_id long, quality int, toxic int"))
    c = toxicity.fit(huge, more, most=8000)
    assert len(c.index) > len(few.index)
    x = np.random.default_rng(0).random((5, len(quality.NAMES)))
    assert np.array_equal(quality.fit(rows, labels).score(x), quality.fit(again, labels.union(labels)).score(x))
    names = [list(LANGS)[i % 3] for i in range(90)]
    said = docs(spark, [tongue(k, 100, i) for i, k in enumerate(names)], langs=names)
    f, g = langid.fit(said), langid.fit(said.union(said))
    assert f.languages == g.languages and np.allclose(f.weight, g.weight)
    assert langid.windows_of(said).count() == 90 * 3


def test_ftrl_equals_plain_updates():
    """Per-coordinate FTRL-proximal, written out coordinate by coordinate."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 16, 5)) for _ in range(60)]
    y = np.array([float(3 in r) for r in rows])
    got = toxicity.fit_ftrl(rows, y, bits=4, epochs=3)
    z, n, order = {}, {}, np.random.default_rng(7)
    rate = lambda k: (toxicity.BETA + n.get(k, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2

    def weight(k):
        s, l1 = z.get(k, 0.0), 0.0 if k == "bias" else toxicity.L1
        return 0.0 if abs(s) <= l1 and k != "bias" else -(s - (l1 if s > 0 else -l1)) / rate(k)

    for _ in range(3):
        for r in order.permutation(len(rows)).tolist():
            keys = [*rows[r].tolist(), "bias"]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[r]
            for k in keys:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * w[k]
                n[k] = old + g * g
    want = {k: weight(k) for k in range(16) if weight(k)}
    assert dict(zip(got.index.tolist(), got.weight.tolist(), strict=True)) == pytest.approx(want, rel=1e-4)
    assert got.bias == pytest.approx(weight("bias"))


def test_segments_of_long_texts(monkeypatch):
    text = " ".join(words(700, 1, 50)).replace("w", "x y").encode()
    data, offsets = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    whole = toxicity.distinct_features(data, offsets)
    field = langid.Field(["a", "b"], np.random.default_rng(0).normal(size=(1 << langid.BITS, 2)), np.array([[0.5, -1.0], [0.2, 0.1]]))
    one = _words.scan(data[: len(text)], offsets[:2], parts=_words.NOT_LETTER)
    sums = field.marginals(field.potentials(one), one.first).sum(axis=0)
    for size in (1, 7, 64, 333):
        monkeypatch.setattr(toxicity, "SEGMENT", size)
        monkeypatch.setattr(langid, "SEGMENT", size)
        assert np.array_equal(toxicity.distinct_features(data, offsets), whole)
        if size > 1:
            assert np.allclose(field.long_sum(one), sums)


def test_repeated_vectors(spark, tmp_path):
    rows = [(k, [float(k % 7), 1.0], 0) for k in range(60)]
    rows += [(20, [9.0, 1.0], 0), (20, [9.0, 1.0], 0), (3, [0.0, 0.5], 0)]
    got = ann.op6_ann(spark, write(tmp_path, embeddings=vectors(spark, rows))).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(by) == [0, 20, 40] and all(len(set(v)) == len(v) == 20 for v in by.values())
    assert max(r.score for r in got if r.query_id == 20) == 9.0 * 6 + 1


def test_slices_cover_all_rows():
    column = pa.array(["a" * n for n in (0, 5, 100, 3, 0, 0, 7)] + [None])
    assert [i for a, b, *_ in text_slices(column, 10) for i in range(a, b)] == list(range(8))


@pytest.mark.parametrize("languages", [3, 40])
def test_many_languages_are_walked_to_the_same_outcome(monkeypatch, languages):
    rng = np.random.default_rng(languages)
    field = langid.Field([f"l{k:02d}" for k in range(languages)], rng.normal(size=(1 << 10, languages)).astype(np.float32), rng.normal(size=(languages, languages)))
    first = np.array([0, 7, 7, 8, 75])
    potentials = rng.normal(size=(75, languages))
    monkeypatch.setattr(langid, "MANY", 1000)
    want = field.marginals(potentials, first)
    ends = rng.random(languages), rng.random(languages)
    one = field.marginals(potentials[:7], first[:2], *ends)
    text = " ".join(words(600, 4, 90)).replace("w", "x ").encode()
    scanned = _words.scan(np.frombuffer(text, np.uint8), np.array([0, len(text)]), parts=_words.NOT_LETTER)
    whole = field.marginals(field.potentials(scanned), scanned.first).sum(axis=0)
    monkeypatch.setattr(langid, "MANY", 2)
    assert np.allclose(field.marginals(potentials, first), want) and np.allclose(field.marginals(potentials[:7], first[:2], *ends), one)
    monkeypatch.setattr(langid, "SEGMENT", 100)
    assert np.allclose(field.long_sum(scanned), whole)


def test_no_language_is_left_out():
    names = [f"l{k:03d}" for k in range(140)]
    texts, langs = [], []
    for k, name in enumerate(names):
        for i in range(3):
            texts.append(" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in words(30, i, 20)).replace("w", "q"))
            langs.append(name)
    field = langid.learn(texts, langs)
    found, _ = langid._predict(field, pa.array(texts))
    assert len(set(found)) > 130 and sum(a == b for a, b in zip(found, langs, strict=True)) > 0.95 * len(texts)
    assert langid.bits_for(4) == 16 and langid.bits_for(256) == 16 and langid.bits_for(4096) == 12


def test_transition_counts_of_windows():
    """Expected transitions against the sum over all ways to label two short sequences."""
    from itertools import pairwise, product

    rng = np.random.default_rng(1)
    field = langid.Field(["a", "b", "c"], np.zeros((4, 3)), rng.normal(size=(3, 3)))
    potential, first, move = rng.normal(size=(9, 3)), np.array([0, 5, 9]), np.exp(field.transition)
    unary, pair = langid._expected(field, potential, first)
    want, each = np.zeros((3, 3)), np.zeros((9, 3))
    for a, b in ((0, 5), (5, 9)):
        # The walk begins with an even message, which passes one transition.
        weight = lambda p, a=a: move[:, p[0]].sum() * np.prod([np.exp(potential[a + i, k]) for i, k in enumerate(p)]) * np.prod([move[x, y] for x, y in pairwise(p)])
        ways = {p: weight(p) for p in product(range(3), repeat=b - a)}
        for p, v in ways.items():
            for x, y in pairwise(p):
                want[x, y] += v / sum(ways.values())
            for i, k in enumerate(p):
                each[a + i, k] += v / sum(ways.values())
    assert pair == pytest.approx(want) and unary == pytest.approx(each)
