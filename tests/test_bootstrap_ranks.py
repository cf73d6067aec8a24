"""The vector bootstrap against a plain loop, and ranks over all rows against a sort."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelode.operators import bootstrap, ranks, reports

PREDS = "model string, patient_id long, pred double, y int"


def plain(rows, replicates):
    """{(model, metric): (score, std, lower, mean, upper)} by weights row by row."""
    out = {}
    for model in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == model and r[1] is not None and r[2] is not None and r[3] is not None]
        patient, pred, y = (np.array(c) for c in zip(*(r[1:] for r in own), strict=True))
        w = bootstrap.multiplicities(patient, replicates).astype(float)
        scores = {m: [] for m in bootstrap.METRICS}
        for k in range(replicates + 1):
            pos, neg = w[:, k] * y, w[:, k] * (1 - y)
            area = sum(p * (neg[pred < s].sum() + neg[pred == s].sum() / 2) for p, s in zip(pos, pred, strict=True))
            both = pos.sum() * neg.sum()
            scores["auroc"].append(area / both if both else np.nan)
            steps = sum(p * pos[pred >= s].sum() / (pos + neg)[pred >= s].sum() for p, s in zip(pos, pred, strict=True) if p)
            scores["auprc"].append(steps / pos.sum() if pos.sum() else np.nan)
            scores["brier"].append((w[:, k] * (pred - y) ** 2).sum() / w[:, k].sum())
        for m, v in scores.items():
            drawn = np.array(v[1:])
            drawn = drawn[np.isfinite(drawn)]
            out[model, m] = (v[0], drawn.std(ddof=1), *np.percentile(drawn, [2.5, 97.5])[[0]], drawn.mean(), np.percentile(drawn, 97.5))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_intervals_against_a_loop(spark, monkeypatch, hot):
    rng = random.Random(5)
    # Scores of a rare outcome that lie close together, ties, repeated rows, nulls, and one score that most rows have.
    score = lambda: 0.01 if hot and rng.random() < 0.6 else 0.01 + rng.randrange(40) / 9000
    rows = [("ab"[i % 2], rng.randrange(60), score(), int(rng.random() < 0.3)) for i in range(300)]
    rows += rows[:20] + [("a", None, 0.5, 1), ("a", 3, None, 1), ("b", 4, 0.2, None)]
    monkeypatch.setattr(bootstrap, "BLOCK", 7)
    monkeypatch.setattr(bootstrap, "FEWEST", 5)
    monkeypatch.setattr(bootstrap, "RANGE_ROWS", 20)
    got = bootstrap.intervals(spark.createDataFrame(rows, PREDS).repartition(2), ["model"], 25).collect()
    want = plain(rows, 25)
    assert {(r.model, r.metric) for r in got} == want.keys()
    for r in got:
        assert (r.score, r.std, r.lower, r.mean, r.upper) == pytest.approx(want[r.model, r.metric])


def test_few_classes_and_no_rows(spark):
    assert bootstrap.intervals(spark.createDataFrame([], PREDS), ["model"], 5).count() == 0
    one = {r.metric: r for r in bootstrap.intervals(spark.createDataFrame([(None, 1, 0.5, 1), (None, 2, 0.25, 1)], PREDS), ["model"], 50).collect()}
    assert one["auroc"].score is None and one["auroc"].mean is None and one["auprc"].score == 1.0 and one["brier"].score == pytest.approx((0.25 + 0.5625) / 2)
    named = spark.createDataFrame([(f"p{i}", i / 9, i % 2) for i in range(9)], "patient_id string, pred double, y int")
    assert bootstrap.intervals(named, [], 10).count() == 3


def test_draws_are_poisson():
    drawn = bootstrap.multiplicities(np.arange(-200, 2000), 400)
    assert (drawn[:, 0] == 1).all()
    n = np.bincount(drawn[:, 1:].ravel()) / drawn[:, 1:].size
    assert n[:5] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613, 0.0153], abs=0.004)
    means = drawn[:, 1:].mean(axis=1)
    assert abs(np.corrcoef(drawn[:, 1:].T)[np.triu_indices(400, 1)]).mean() < 0.03 and abs(means - 1).max() < 0.35


def test_shuffled_rows_do_not_grow_with_the_replicates(spark):
    rows = spark.createDataFrame([("a", i % 40, (i % 97) / 97, i % 2) for i in range(500)], PREDS)
    out = bootstrap.intervals(rows, ["model"], 1000)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in text and "replicate" not in text


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_ranks_over_all_rows(spark, keys):
    rng = random.Random(2)
    rows = [(None if i % 50 == 7 else i % 3, None if i % 31 == 0 else rng.randrange(30), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(7)
    got = ranks.ranked(df, ["v", "i"], keys, "r", "n").collect()
    want = {}
    for g in {r[0] for r in rows} if keys else {None}:
        own = sorted((r for r in rows if not keys or r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (k, len(own)) for k, r in enumerate(own)}
    assert {r.i: (r.r, r.n) for r in got} == want
    assert ranks.ranked(df.filter("i < 0"), ["v"], keys).count() == 0


def test_no_task_ranks_all_rows(spark):
    df = spark.range(200_000).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v")).repartition(4)
    out = reports.buckets(df, "v", 4, "id")
    text = out._jdf.queryExecution().executedPlan().toString()
    # The only window over all is that of the ranges' sizes.
    assert text.count("Window [") == 1 and "[_part#" in text.split("Window [")[1].split("\n")[0]
    assert sorted(r["count"] for r in out.groupBy("bucket").count().collect()) == [50_000] * 4
