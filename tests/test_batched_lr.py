"""Many regressions in one series of jobs, against Newton's method model by model and against pyspark.ml."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors

from timelode.operators import batched_lr

PENALTIES = [1e-4, 1e-2, 1e-1, 1.0, 1e2]


def newton(x, y, weight, penalty):
    """Weights, the intercept last, of one model on scaled features."""
    n, scale = weight.sum(), np.abs(x).max(axis=0)
    scale[scale == 0] = 1
    z = np.column_stack([x / scale, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], 1 / (penalty * n)), 0)
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        slope = z.T @ (weight * (p - y)) / n + ridge * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z / n + np.diag(ridge)
        w = w - np.linalg.solve(curve, slope)
        if np.abs(slope).max() < 1e-13:
            break
    return np.append(w[:-1] / scale, w[-1])


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 5)) * (rng.random((240, 5)) < 0.6)
    x[:, 4] = 0
    truth = rng.normal(size=(8, 5))
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(x)]
    samples, sets = [], {}
    for s in range(40):
        own = rng.permutation(240)[: 60 + 4 * s]
        y = (x[own] @ truth[s % 8] + rng.normal(size=len(own)) > 0).astype(float)
        weight = rng.integers(1, 3, len(own)).astype(float)
        sets[s] = (own, y, weight)
        samples += [(int(i), s, float(w), float(v)) for i, v, w in zip(own, y, weight, strict=True)]
    features = spark.createDataFrame(rows, "row int, idx array<int>, val array<double>").repartition(3)
    data = batched_lr.grouped(features, spark.createDataFrame(samples, "row int, sample int, weight double, y double"), ("row",)).persist()
    return x, sets, features, data


def test_two_hundred_models(spark, study):
    x, sets, features, data = study
    models = batched_lr.fit(data, 5, PENALTIES)
    assert len(models.weight) == 200 and models.converged.all()
    for s, c, w in zip(models.sample.tolist(), models.penalty.tolist(), models.weight, strict=True):
        own, y, weight = sets[s]
        assert w == pytest.approx(newton(x[own], y, weight, c), rel=1e-6, abs=1e-6)
    # Far fewer jobs than models: all take their steps together.
    assert models.jobs < 100
    got = {(r.row, r.model): r.pred for r in models.scores(features, ["row"]).filter("row < 20").collect()}
    assert len(got) == 20 * 200
    for (row, m), p in got.items():
        assert p == pytest.approx(1 / (1 + np.exp(-(x[row] @ models.weight[m, :-1] + models.weight[m, -1]))))


def test_equals_spark_ml(spark, study):
    x, sets, _, data = study
    models = batched_lr.fit(data.filter("exists(parts, p -> p.sample = 7)").selectExpr("idx", "val", "filter(parts, p -> p.sample = 7) AS parts"), 5, [0.1, 1.0])
    assert models.sample.tolist() == [7, 7]
    own, y, weight = sets[7]
    scale = np.where(np.abs(x[own]).max(axis=0) > 0, np.abs(x[own]).max(axis=0), 1)
    rows = spark.createDataFrame([(Vectors.dense(r), float(v), float(w)) for r, v, w in zip(x[own] / scale, y, weight, strict=True)], ["features", "label", "weight"])
    for c, w in zip((0.1, 1.0), models.weight, strict=True):
        one = LogisticRegression(weightCol="weight", regParam=1 / (c * weight.sum()), standardization=False, tol=1e-12, maxIter=500).fit(rows)
        assert w == pytest.approx([*(one.coefficients.toArray() / scale), one.intercept], rel=1e-6, abs=1e-6)


def test_odd_samples(spark):
    schema = "idx array<int>, val array<double>, parts array<struct<sample int, weight double, y double>>"
    assert len(batched_lr.fit(spark.createDataFrame([], schema), 3, [1.0]).weight) == 0
    rows = [([0], [1.0], [(0, 1.0, 1.0)]), ([], [], [(0, 1.0, 0.0), (2, 1.0, 1.0)]), ([0, 2], [2.0, -1.0], [(0, 2.0, 1.0)])]
    models = batched_lr.fit(spark.createDataFrame(rows, schema), 3, [1.0], most=60)
    assert models.sample.tolist() == [0, 2] and models.converged[0] and np.isfinite(models.weight).all()
