"""Label sets, hashing, samples, metrics, reports and files."""

import hashlib
import random
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelode.functions import rollout_tokens as rt
from timelode.functions.hashing import random_num
from timelode.operators import heads, labels, metrics, ontology, reports, shots
from timelode.sources import readers, sinks


def test_random_num(spark):
    cases = [(97, 5, 0), (1, -7, 3), (0, 2**62, 9), (-3, -1, -2)]
    want = [int.from_bytes(hashlib.sha256(struct.pack(">qqq", *c)).digest(), "big") % 100 for c in cases]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s long, a long, b long")
    assert [r.h for r in df.select("i", random_num(F.col("s"), F.col("a"), F.col("b")).alias("h")).orderBy("i").collect()] == want


def test_closure_on_cycles_and_diamonds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "z"), ("a", "c"), ("c", "z")], "parent string, child string")
    assert sorted(r.code for r in ontology.closure(edges, ["a"]).collect()) == ["a", "b", "c", "z"]
    assert [r.code for r in ontology.closure(edges, ["q"]).collect()] == ["q"]
    assert ontology.code_set(edges, ["a"], expand=False).count() == 1


def test_seeded_choice(spark):
    rows = [(p, datetime(2024, 1, d), True) for p in range(5) for d in range(1, 6)]
    df = spark.createDataFrame(rows, "patient_id long, prediction_time timestamp_ntz, value boolean")
    got = {r.patient_id: r.prediction_time.day for r in labels.one_per_patient_seeded(df).collect()}
    assert got == {p: 1 + random.Random(p).randrange(5) for p in range(5)}


def test_adults_only_cuts_the_leading_run(spark):
    df = spark.createDataFrame([(1, datetime(y, 5, 1), True) for y in (2015, 2017, 2018, 2020)], "patient_id long, prediction_time timestamp_ntz, value boolean")
    births = spark.createDataFrame([(1, datetime(2000, 1, 1))], "patient_id long, birth_time timestamp_ntz")
    assert sorted(r.prediction_time.year for r in labels.adults_only(df, births).collect()) == [2018, 2020]


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    y, p, w = rng.integers(0, 2, 200), np.round(rng.random(200), 1), rng.integers(1, 4, 200).astype(float)
    df = spark.createDataFrame([("a", int(a), float(b), float(c)) for a, b, c in zip(y, p, w, strict=True)], "k string, y int, pred double, w double")
    got = metrics.all_scores(df, ["k"], "w").first()
    pos, neg = y == 1, y == 0
    cmp = np.where(p[pos][:, None] > p[neg], 1, np.where(p[pos][:, None] == p[neg], 0.5, 0))
    ww = w[pos][:, None] * w[neg]
    assert abs(got.auroc - (cmp * ww).sum() / ww.sum()) < 1e-12
    ap = sum(w[i] * (w[(p >= p[i]) & pos].sum() / w[p >= p[i]].sum()) for i in np.flatnonzero(pos)) / w[pos].sum()
    assert abs(got.auprc - ap) < 1e-12 and abs(got.brier - (w * (p - y) ** 2).sum() / w.sum()) < 1e-12
    one = metrics.auroc(df.filter("y = 1"), ["k"]).first()
    assert one.auroc is None


def test_seeded_draws_are_numpys(spark):
    people = spark.createDataFrame([(p,) for p in (7, 3, 11, 20)], "patient_id long")
    got = {(r.replicate, r.patient_id): r.times for r in metrics.seeded_draws(people, 3).collect()}
    ids, want = [3, 7, 11, 20], {}
    for r in range(3):
        for i in np.random.RandomState(r).randint(0, 4, 4):
            want[r, ids[i]] = want.get((r, ids[i]), 0) + 1
    assert got == want


def test_quartiles_of_six(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 7)], "i int, v double")
    assert [r.bucket for r in reports.buckets(df, "v", 4, "i").orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]


def test_shots_nest_and_oversample(spark):
    rows = spark.createDataFrame([("t", "train", i, datetime(2024, 1, 1), int(i < 3)) for i in range(20)], "sub_task string, split string, patient_id long, prediction_time timestamp_ntz, value int")
    drawn = shots.k_shots(rows, [1, 4, 8, -1], 2).collect()
    ids = lambda k, r, v: [x.patient_id for x in drawn if (x.k, x.replicate, x.value) == (k, r, v)]
    for r in (0, 1):
        assert len(ids(8, r, 1)) == 8 and set(ids(8, r, 1)) == {0, 1, 2} and len(ids(4, r, 0)) == 4
        assert set(ids(1, r, 0)) <= set(ids(4, r, 0)) <= set(ids(8, r, 0))
    assert len(ids(-1, 0, 0)) == 17 and not ids(-1, 1, 0)
    back = readers.shots_json(shots.as_json(shots.k_shots(rows, [4], 1)))
    assert back.count() == 8 and {r.k for r in back.collect()} == {4}


def test_rollout_cases(spark):
    cases = [(["[DAY 3]", "[WEEK 2]", "[VISIT START]"], True), (["[LONG TERM]", "[VISIT START]"], False), (["[EOS]", "[VISIT START]"], False), ([], False), (["[MONTH 1]", "[VISIT START]"], True), (["[DAY x]", "[VISIT START]"], True)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, tokens array<string>")
    got = df.select("i", rt.within_horizon(F.col("tokens"), ["[VISIT START]"], 30).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == [w for _, w in cases]
    first = df.select("i", rt.first_before(F.col("tokens"), ["[VISIT START]"], ["[VISIT END]"]).alias("h")).orderBy("i").collect()
    assert [r.h for r in first] == [True, True, False, False, True, True]


def test_prototypes(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (0, [0.0, 2.0]), (1, [4.0, 1.0])], "y int, features array<double>")
    got = heads.nearest_prototype(spark.createDataFrame([(9, [1.0, 1.0])], "i int, features array<double>"), heads.prototypes(df), ["i"]).first()
    d = np.exp(-np.array([1.0, 3.0]))
    assert got.predicted == 0 and abs(got.probability - d[0] / d.sum()) < 1e-12


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(2, datetime(2024, 1, 1, 5, 6, 7), True, "boolean"), (1, datetime(2024, 1, 2), False, "boolean")], "patient_id long, prediction_time timestamp_ntz, value boolean, label_type string")
    sinks.labels_csv(rows, str(tmp_path / "l"))
    with pytest.raises(Exception, match="exists"):
        sinks.labels_csv(rows, str(tmp_path / "l"))
    back = {(r.patient_id, r.prediction_time, r.bool_value) for r in readers.labels_csv(spark, str(tmp_path / "l")).collect()}
    assert back == {(2, datetime(2024, 1, 1, 5, 6), True), (1, datetime(2024, 1, 2), False)}
    (tmp_path / "v.json").write_text('{"regular": [{"type": "code", "code_string": "SNOMED/1"}, {"type": "unused", "code_string": null}]}')
    assert [(r.token, r.type) for r in readers.vocabulary_json(spark, str(tmp_path / "v.json")).collect()] == [(0, "code"), (1, "unused")]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.json").write_text('{"lr": 0.1, "k": 4, "model": "m", "head": "h", "sub_task": "s", "losses": [1.0], "metrics": [{"auroc": {"val": 0.5, "test": 0.6}}]}')
    assert readers.finetune_logs(spark, str(tmp_path / "log")).count() == 2
    assert readers.results_csvs(spark, [str(tmp_path / "none.csv")]).count() == 0
    tsv = tmp_path / "c.tsv"
    from timelode.schema import CHEST_FINDINGS

    tsv.write_text("\t".join(["patient_id", "start", *CHEST_FINDINGS]) + "\n" + "\t".join(["1", "2024-01-01 10:00:00", "1", *["-1"] * 6, *[""] * 7]) + "\n")
    assert sum(readers.chest_tsv(spark, str(tsv)).first()[2:]) == 1


def test_upsert_replaces(spark):
    a = spark.createDataFrame([("t", 1, 0.1), ("t", 2, 0.2)], "task string, k int, value double")
    b = spark.createDataFrame([("t", 2, 0.9), ("t", 3, 0.3)], "task string, k int, value double")
    got = sinks.upsert_results(a, b, ("task", "k"))
    assert sorted(map(tuple, got.collect())) == [("t", 1, 0.1), ("t", 2, 0.9), ("t", 3, 0.3)]
    assert [r.k for r in sinks.unfinished(b, a, ["task", "k"]).collect()] == [3]


def test_report_text(spark):
    df = spark.createDataFrame([("a_b", 1)], "name string, n int")
    assert reports.markdown(df).splitlines()[-1] == "| a_b | 1 |"
    assert r"a\_b & 1 \\" in reports.latex(df) and "<td>a_b</td>" in reports.html(df)


def test_curves_over_ranges_equal_a_plain_walk(spark):
    rng = random.Random(3)
    values = [-2.5, 0.0, 0.001, 0.5, 0.50001, 0.999, 1.0, 7.0, float("inf"), float("nan")]
    rows = [(k, rng.choice([*values, rng.random()]), rng.randint(0, 1), float(rng.randint(1, 3))) for k in ("a", "b", None) for _ in range(80)]
    rows += [("a", None, 1, 1.0), ("a", None, 0, 2.0), ("lone", 0.3, 1, 1.0)]
    preds = spark.createDataFrame(rows, "model string, pred double, y int, w double")
    place = lambda p: (-1, 0.0) if p is None else (1, 0.0) if p != p else (0, p)
    got = {r.model: r.auroc for r in metrics.auroc(preds, ["model"], "w").collect()}
    precision = {r.model: r.auprc for r in metrics.average_precision(preds, ["model"], "w").collect()}
    assert set(got) == set(precision) == {"a", "b", None, "lone"} and got["lone"] is None and precision["lone"] == 1.0
    for key in ("a", "b", None):
        own = [(place(p), y, w) for k, p, y, w in rows if k == key]
        pos, neg = [(p, w) for p, y, w in own if y], [(p, w) for p, y, w in own if not y]
        area = sum(v * w * ((p > q) + (p == q) / 2) for p, v in pos for q, w in neg)
        assert abs(got[key] - area / (sum(v for _, v in pos) * sum(w for _, w in neg))) < 1e-9
        at = [(v, sum(w for q, w in pos if q >= p) / sum(w for q, _, w in own if q >= p)) for p, v in pos]
        assert abs(precision[key] - sum(v * x for v, x in at) / sum(v for _, v in pos)) < 1e-9


@pytest.mark.parametrize("keep_prevalence", [False, True])
def test_samples_nest_and_repeat_small_classes(spark, keep_prevalence):
    rows = [(t, "train", i, 0, v) for t, n in (("x", 40), (None, 7)) for i, v in enumerate([0] * n + [1] * 3)]
    frame = spark.createDataFrame(rows, "sub_task string, split string, patient_id long, prediction_time int, value int")
    got = shots.k_shots(frame, [2, 5, -1], 2, keep_prevalence=keep_prevalence).collect()
    for task, n in (("x", 40), (None, 7)):
        mine = lambda k, r, v: [x for x in got if (x.sub_task, x.k, x.replicate, x.value) == (task, k, r, v)]
        for r in range(2):
            for v, size in ((0, n), (1, 3)):
                want = {k: max(1, 2 * k * size // (n + 3)) if keep_prevalence else k for k in (2, 5)}
                assert all(len(mine(k, r, v)) == want[k] for k in (2, 5))
                assert {x.patient_id for x in mine(2, r, v)} <= {x.patient_id for x in mine(5, r, v)}
        assert len([x for x in got if x.sub_task == task and x.k == -1]) == n + 3
