"""Features as of a label's time: code counts, with ancestors if asked for, and age."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelode.operators.asof import united
from timelode.operators.ranks import ranked
from timelode.operators.timeline import frequent_codes
from timelode.sources import store
from timelode.sources.shared import written


def count_features(asked: DataFrame, events: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """(patient_id, prediction_time, code, n): events of each code up to each asked time.

    Events are first counted by patient, code and time. The counts then become running totals along the
    timeline of (patient, code), and each asked time takes over the last total before it; that costs the
    asked times once per code of the patient, not once per event.
    """
    daily = events.groupBy("patient_id", "code", "start_time").agg(F.count(F.lit(1)).alias("n"))
    codes = events.select("patient_id", "code").distinct()
    if ancestors is not None:
        raised = _raiser(events, ancestors)
        daily = raised(daily).groupBy("patient_id", "code", "start_time").agg(F.sum("n").alias("n"))
        codes = raised(codes).distinct()
    times = asked.select("patient_id", "prediction_time").distinct()
    grid = times.join(codes, "patient_id").select("patient_id", "code", F.col("prediction_time").alias("at"), F.lit(None).cast("long").alias("n"))
    both, keys = united(["patient_id", "code"], daily.select("patient_id", "code", F.col("start_time").alias("at"), "n"), grid)
    # At equal times the event counts.
    upto = Window.partitionBy(*keys).orderBy("at", F.desc_nulls_last("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("total", F.sum("n").over(upto)).filter("n IS NULL AND total > 0")
    return out.select(F.col(keys[0]).alias("patient_id"), F.col("at").alias("prediction_time"), F.col(keys[1]).alias("code"), F.col("total").cast("long").alias("n"))


def _raiser(events: DataFrame, ancestors: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that puts rows of events' codes under each ancestor of their code; a code that the hierarchy doesn't know stands for itself.

    Frequent codes find their ancestors in a broadcast list, so their rows stay where they are and none of them fills a
    task. Other rows go to their code and then back to their patient, into as many partitions as a store has buckets.
    """
    above = F.coalesce(F.col("ancestor"), F.col("code"))
    frequent = frequent_codes(events)
    known = F.broadcast(written(frequent.join(ancestors, "code", "left").select("code", above.alias("_above")), "above"))
    n = store.buckets_for(events.count(), store.TASK_ROWS)

    def raised(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("patient_id", "code")]
        often = rows.join(known, "code").select("patient_id", F.col("_above").alias("code"), *rest)
        others = rows.join(F.broadcast(frequent), "code", "left_anti").join(ancestors, "code", "left").select("patient_id", above.alias("code"), *rest)
        both, keys = united(["patient_id"], often, others.repartition(n, "patient_id"))
        return both.select(F.col(keys[0]).alias("patient_id"), "code", *rest)

    return raised


def age_feature(asked: DataFrame, births: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """asked with age in years of 365.25 days, and its z-score by the mean and deviation over train (or asked)."""
    rows = asked.join(births.select("patient_id", "birth_time"), "patient_id").withColumn("age", F.timestamp_diff("MICROSECOND", F.col("birth_time"), F.col("prediction_time")) / (86400e6 * 365.25))
    base = rows if train is None else rows.join(train.select("patient_id").distinct(), "patient_id", "left_semi")
    moments = base.agg(F.avg("age").alias("_mean"), F.stddev_samp("age").alias("_dev"))
    return rows.crossJoin(F.broadcast(moments)).withColumn("age_z", (F.col("age") - F.col("_mean")) / F.nullif(F.col("_dev"), F.lit(0.0))).drop("_mean", "_dev", "birth_time")


def as_arrays(counts: DataFrame, codes: DataFrame) -> DataFrame:
    """(patient_id, prediction_time, idx, val): long counts over the numbered codes (code, idx), as sorted arrays."""
    pairs = counts.join(codes, "code").groupBy("patient_id", "prediction_time").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("n").cast("double").alias("n")))).alias("m"))
    return pairs.select("patient_id", "prediction_time", F.col("m.idx").alias("idx"), F.col("m.n").alias("val"))


def as_vectors(counts: DataFrame, codes: DataFrame) -> DataFrame:
    """Sparse vectors over the numbered codes of long counts: what a row costs is its own codes, not the vocabulary. pyspark.ml's heads need them; batched_lr takes as_arrays()."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    size = int(codes.agg(F.max("idx")).first()[0] or 0) + 1
    vector = F.udf(lambda idx, n: SparseVector(size, idx, n), VectorUDT())
    return as_arrays(counts, codes).select("patient_id", "prediction_time", vector("idx", "val").alias("features"))


def numbered_codes(counts: DataFrame) -> DataFrame:
    """(code, idx) with idx from 0 in the order of the codes."""
    return ranked(counts.select("code").distinct(), ["code"], rank="idx").withColumn("idx", F.col("idx").cast("int"))
