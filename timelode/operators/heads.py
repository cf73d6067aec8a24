"""Model heads on feature vectors: grid search on a fixed split, and nearest class means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelode.operators import leafwise

#: Grids of the heads. Random forests of pyspark.ml end at a depth of 30, so a depth of 50 is fitted as 30.
GRIDS = {
    "lr": {"C": [1e-8, 1e-6, 1e-4, 1e-2, 1e-1, 1, 1e2, 1e4]},
    "rf": {"n_estimators": [10, 20, 50, 100, 300], "max_depth": [3, 5, 10, 20, 50]},
    "gbm": {"max_depth": [3, 6, -1], "learning_rate": [0.02, 0.1, 0.5], "num_leaves": [10, 25, 100]},
}
DEEPEST = 30


class Leafwise:
    """A leaf-wise boosted model with the interface of pyspark.ml's."""

    def __init__(self, model: leafwise.Boosted) -> None:
        self.model = model

    def transform(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return self.model.transform(rows.withColumn("_array", vector_to_array("features")), "_array", "rawPrediction").drop("_array")


def _fitted(head: str, params: dict, train: DataFrame, n: int, seed: int, trees: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import MaxAbsScaler
    from pyspark.ml.functions import vector_to_array

    if head == "lr":
        scaler = MaxAbsScaler(inputCol="features", outputCol="scaled")
        return Pipeline(stages=[scaler, LogisticRegression(featuresCol="scaled", labelCol="y", regParam=1 / (params["C"] * n), elasticNetParam=0.0, standardization=False, maxIter=200)]).fit(train)
    if head == "rf":
        return RandomForestClassifier(featuresCol="features", labelCol="y", seed=seed, numTrees=params["n_estimators"], maxDepth=min(DEEPEST, params["max_depth"])).fit(train)
    return Leafwise(leafwise.fit(train.select(vector_to_array("features").alias("features"), "y"), params["num_leaves"], params["max_depth"], params["learning_rate"], trees))


def fit_best(train: DataFrame, val: DataFrame, head: str = "lr", grid: dict | None = None, seed: int = 0, trees: int = 100):
    """(model, params, AUROC on val) of the grid point that ranks val best; fitted on train (features, y) only. trees is the length of a boosted model."""
    from itertools import product

    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    judge = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    train, best, grid = train.persist(), None, grid or GRIDS[head]
    try:
        n = train.count()
        for values in product(*grid.values()):
            params = dict(zip(grid, values, strict=True))
            model = _fitted(head, params, train, n, seed, trees)
            area = judge.evaluate(model.transform(val))
            if best is None or area > best[2]:
                best = (model, params, area)
    finally:
        train.unpersist()
    return best


def probability(model, rows: DataFrame) -> DataFrame:
    """rows with pred, the probability of class 1."""
    from pyspark.ml.functions import vector_to_array

    if isinstance(model, Leafwise):
        return model.transform(rows).withColumnRenamed("rawPrediction", "pred")
    return model.transform(rows).withColumn("pred", vector_to_array("probability")[1])


def prototypes(train: DataFrame) -> DataFrame:
    """(y, mean): the mean of the array<double> features of each class."""
    each = train.select("y", F.posexplode("features").alias("i", "v")).groupBy("y", "i").agg(F.avg("v").alias("v"))
    return each.groupBy("y").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s.v).alias("mean"))


def nearest_prototype(rows: DataFrame, means: DataFrame, ident: list[str]) -> DataFrame:
    """ident, predicted class and its probability: softmax of negative Euclidean distances to the class means, which are few and broadcast."""
    d = F.sqrt(F.aggregate(F.zip_with("features", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    all_means = means.agg(F.sort_array(F.collect_list(F.struct("y", "mean"))).alias("m"))
    dist = rows.select(*ident, "features").crossJoin(F.broadcast(all_means)).select(*ident, "features", F.explode("m").alias("c")).select(*ident, F.col("c.y").alias("class"), "features", F.col("c.mean").alias("mean"))
    dist = dist.select(*ident, "class", d.alias("d"))
    out = dist.groupBy(*ident).agg(F.min_by("class", F.struct("d", "class")).alias("predicted"), F.min("d").alias("_least"), F.collect_list("d").alias("_all"))
    total = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.exp(F.col("_least") - x))
    return out.select(*ident, "predicted", (1 / total).alias("probability"))
