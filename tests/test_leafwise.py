"""Leaf-wise boosting over partitions against a plain version that holds all rows."""

import numpy as np
import pytest

from timelode.operators import heads, leafwise


def plain(x, y, edges, leaves, depth, rate, trees, least):
    """Scores after each tree, growing leaf by leaf over lists of rows."""
    bins = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    sizes = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def best(rows, level):
            top = (0.0, -1, 0)
            if depth >= 0 and level >= depth:
                return top
            score = lambda r: g[r].sum() ** 2 / h[r].sum() if len(r) else 0.0
            for f in range(x.shape[1]):
                for c in range(len(edges[f]) + 1):
                    a, b = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
                    if len(a) >= least and len(b) >= least:
                        gain = score(a) + score(b) - score(rows)
                        if gain > 1e-12 and gain > top[0] * (1 + 1e-9):
                            top = (gain, f, c)
            return top

        parts = [(np.arange(len(y)), 0)]
        cuts = [best(*parts[0])]
        while len(parts) < leaves:
            k = int(np.argmax([c[0] for c in cuts]))
            _, f, c = cuts[k]
            if f < 0:
                break
            rows, level = parts.pop(k)
            cuts.pop(k)
            for side in (rows[bins[rows, f] <= c], rows[bins[rows, f] > c]):
                parts.append((side, level + 1))
                cuts.append(best(side, level + 1))
        if len(parts) == 1:
            break
        sizes.append(sorted(len(r) for r, _ in parts))
        for rows, _ in parts:
            raw[rows] += -rate * g[rows].sum() / h[rows].sum()
    return raw, sizes


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = ((x[:, 0] * x[:, 1] + (x[:, 2] > 0.5) + rng.normal(size=300) * 0.3) > 0.3).astype(float)
    return x, y, spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "i int, features array<double>, y double").repartition(3)


@pytest.mark.parametrize(("leaves", "depth"), [(6, -1), (25, 3), (4, 6)])
def test_equals_a_plain_version(spark, monkeypatch, rows, leaves, depth):
    x, y, df = rows
    monkeypatch.setattr(leafwise, "KEPT_FOR", 2)
    model = leafwise.fit(df, leaves, depth, 0.3, 4, 8, 16)
    want, sizes = plain(x, y, model.edges, leaves, depth, 0.3, 4, 8)
    bins = model.bins(x)
    assert [sorted(np.bincount(t.leaves(bins))[np.unique(t.leaves(bins))].tolist()) for t in model.trees] == sizes
    assert model.raw(bins) == pytest.approx(want)
    got = {r.i: r.pred for r in model.transform(df).collect()}
    assert [got[i] for i in range(300)] == pytest.approx((1 / (1 + np.exp(-want))).tolist())


def test_leaves_bound_trees_without_a_depth(spark):
    x = np.arange(64.0)
    df = spark.createDataFrame([([float(v), 1.0], float(int(v) % 2)) for v in x], "features array<double>, y double")
    model = leafwise.fit(df, 20, -1, 0.5, 1, 1)
    assert len(model.trees[0].feature) == 39  # 20 leaves, 19 splits
    deep = max(np.binary_repr(0).count("1"), *(len(_path(model.trees[0], k)) for k in range(39)))
    assert deep > 5 and leafwise.fit(df, 20, 2, 0.5, 1, 1).trees[0].feature.count(-1) <= 4


def _path(tree, node):
    up = {c: p for p in range(len(tree.feature)) if tree.feature[p] >= 0 for c in (tree.left[p], tree.right[p])}
    out = []
    while node in up:
        node = up[node]
        out.append(node)
    return out


def test_flat_and_empty_rows(spark):
    schema = "features array<double>, y double"
    assert leafwise.fit(spark.createDataFrame([], schema)).trees == []
    one = leafwise.fit(spark.createDataFrame([([1.0], 1.0)] * 30, schema), trees=3)
    assert one.trees == [] and one.raw(one.bins(np.array([[1.0]])))[0] > 20


def test_the_head_searches_leaves(spark, rows):
    from pyspark.ml.functions import array_to_vector

    df = rows[2].withColumn("features", array_to_vector("features"))
    assert heads.GRIDS["gbm"] == {"max_depth": [3, 6, -1], "learning_rate": [0.02, 0.1, 0.5], "num_leaves": [10, 25, 100]}
    model, params, area = heads.fit_best(df.filter("i < 200"), df.filter("i BETWEEN 200 AND 249"), "gbm", {"max_depth": [-1], "learning_rate": [0.5], "num_leaves": [4, 10]}, trees=3)
    assert set(params) == {"max_depth", "learning_rate", "num_leaves"} and area > 0.7
    preds = heads.probability(model, df.filter("i >= 250")).select("pred").collect()
    assert len(preds) == 50 and all(0 < r.pred < 1 for r in preds)
