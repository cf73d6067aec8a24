"""Scores of predictions, weighted and grouped, and their bootstrap intervals, as aggregates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelode.operators.bootstrap import cutoffs
from timelode.operators.ranks import ranked


def _by_score(preds: DataFrame, keys: list[str], weight: str | None) -> DataFrame:
    """Weights of positives and negatives at each distinct score; all curve metrics start from these rows."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return preds.groupBy(*keys, "pred").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0.0).otherwise(w)).alias("neg"))


#: Ranges of scores that a key's curve is split into, so that no key is walked in one task.
RANGES = 256


def _in_ranges(rows: DataFrame) -> DataFrame:
    """rows with the range of their score: ranges are equal parts of [0, 1], and what lies outside belongs to the outermost ones."""
    place = F.greatest(F.lit(0.0), F.least(F.lit(RANGES - 1.0), F.col("pred") * RANGES))
    return rows.withColumn("_range", F.when(F.col("pred").isNull(), 0).otherwise(F.floor(place).cast("int")))


def auroc(preds: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Area under the ROC curve of (y, pred) for each key; ties count half. Null where a class is missing.

    A positive's area is what lies below it in its range of scores, and all negatives of the ranges below.
    """
    rows = _in_ranges(_by_score(preds, keys, weight))
    below = lambda *k: Window.partitionBy(*k).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_below", F.coalesce(F.sum("neg").over(below(*keys, "_range").orderBy("pred")), F.lit(0.0)))
    parts = rows.groupBy(*keys, "_range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("_area"))
    parts = parts.withColumn("_below", F.coalesce(F.sum("neg").over(below(*keys).orderBy("_range")), F.lit(0.0)))
    area = F.sum(F.col("_area") + F.col("pos") * F.col("_below")) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))
    return parts.groupBy(*keys).agg(area.alias("auroc"))


def average_precision(preds: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Sum of precision times step of recall, from the highest score down; each range of scores starts from the sums of those above."""
    rows = _in_ranges(_by_score(preds, keys, weight))
    above = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_range").agg(F.sum("pos").alias("pos"), F.sum(F.col("pos") + F.col("neg")).alias("_n"))
    start = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0.0))
    starts = sums.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_range").alias("_of_range"), start("pos").alias("_tp0"), start("_n").alias("_n0"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys), F.col("_range") == F.col("_of_range"))
    upto = Window.partitionBy(*keys, "_range").orderBy(F.desc("pred")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(starts, same).withColumns({"_tp": F.col("_tp0") + F.sum("pos").over(upto), "_all": F.col("_n0") + F.sum(F.col("pos") + F.col("neg")).over(upto)})
    return rows.groupBy(*keys).agg((F.sum(F.col("pos") * F.col("_tp") / F.nullif(F.col("_all"), F.lit(0.0))) / F.nullif(F.sum("pos"), F.lit(0.0))).alias("auprc"))


def brier(preds: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return preds.groupBy(*keys).agg((F.sum(w * F.pow(F.col("pred") - F.col("y"), 2)) / F.sum(w)).alias("brier"))


def all_scores(preds: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    out = auroc(preds, keys, weight).join(average_precision(preds, keys, weight), keys)
    return out.join(brier(preds, keys, weight), keys)


def at_half(preds: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Precision, recall and accuracy of predictions from the threshold on."""
    p, y = F.col("pred") >= threshold, F.col("y") == 1
    hit, said, true = F.count_if(p & y), F.count_if(p), F.count_if(y)
    return preds.groupBy(*keys).agg((hit / F.nullif(said, F.lit(0))).alias("precision"), (hit / F.nullif(true, F.lit(0))).alias("recall"), (F.count_if(p == y) / F.count(F.lit(1))).alias("accuracy"))


def seeded_draws(patients: DataFrame, replicates: int = 1000) -> DataFrame:
    """(replicate, patient_id, times): patients drawn with replacement by legacy numpy generators seeded with the replicate's number.

    Each replicate draws in a task of its own; what it needs is the number of patients, and patients are
    numbered in the order of their ids.
    """
    import numpy as np

    numbered = ranked(patients.select("patient_id").distinct(), ["patient_id"], rank="_i")
    n = numbered.count()

    def draw(batches):
        for pdf in batches:
            for r in pdf["id"]:
                at, times = np.unique(np.random.RandomState(int(r)).randint(0, n, n), return_counts=True)
                import pandas as pd

                yield pd.DataFrame({"replicate": np.int32(r), "_i": at.astype("int64"), "times": times.astype("int64")})

    spark = patients.sparkSession
    drawn = spark.range(replicates).repartition(max(1, min(replicates, 200))).mapInPandas(draw, "replicate int, _i long, times long")
    return drawn.join(numbered, "_i").select("replicate", "patient_id", "times")


def hashed_draws(patients: DataFrame, replicates: int) -> DataFrame:
    """(replicate, patient_id, times): Poisson(1) multiplicities from a hash, for draws that are joined to rows; bootstrap.intervals makes them where they are used."""
    u = F.pmod(F.xxhash64("replicate", "patient_id"), F.lit(1 << 30)) / float(1 << 30)
    times = F.lit(len(cutoffs()))
    for k, bound in reversed(list(enumerate(cutoffs()))):
        times = F.when(u < bound, k).otherwise(times)
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    return patients.select("patient_id").distinct().select("patient_id", reps).withColumn("times", times.cast("long")).filter("times > 0").select("replicate", "patient_id", "times")


def bootstrap(preds: DataFrame, draws: DataFrame, keys: list[str]) -> DataFrame:
    """For each key and metric: the score, and std, 2.5 and 97.5 percentiles and mean over the replicates of draws.

    Rows of equal patient, score and truth are counted together before they meet the replicates.
    """
    few = preds.groupBy(*keys, "patient_id", "pred", "y").agg(F.count(F.lit(1)).alias("_n"))
    weighted = few.join(draws, "patient_id").withColumn("_w", F.col("_n") * F.col("times"))
    each = all_scores(weighted, [*keys, "replicate"], "_w").unpivot([*keys, "replicate"], ["auroc", "auprc", "brier"], "metric", "v")
    whole = all_scores(preds, keys).unpivot(keys, ["auroc", "auprc", "brier"], "metric", "score")
    out = each.groupBy(*keys, "metric").agg(F.stddev_samp("v").alias("std"), F.percentile("v", F.lit(0.025)).alias("lower"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.975)).alias("upper"))
    return whole.join(out, [*keys, "metric"])
