"""Operations on label sets: sampling, merging, splitting, comparing, packing."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.functions.hashing import random_num, split_of
from timelode.functions.times import to_minute


def at_minutes(labels: DataFrame) -> DataFrame:
    """Prediction times without seconds."""
    return labels.withColumn("prediction_time", to_minute(F.col("prediction_time")))


def one_per_patient(labels: DataFrame, seed: int = 97) -> DataFrame:
    """One label of each patient, that of the least MD5 of seed, patient, time and value."""
    place = F.md5(F.concat_ws("|", F.lit(seed), "patient_id", F.date_format("prediction_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("value").cast("string")).cast("binary"))
    order = Window.partitionBy("patient_id").orderBy(place, "prediction_time", "value")
    return labels.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def one_per_patient_seeded(labels: DataFrame) -> DataFrame:
    """One label of each patient as Python's random.seed(patient_id); choice(labels) picks it. A UDF per patient, for parity of draws."""
    pick = F.udf(lambda pid, n: random.Random(pid).randrange(n), "int")
    order = Window.partitionBy("patient_id").orderBy("prediction_time", "value")
    rows = labels.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("patient_id"))})
    chosen = rows.select("patient_id", "_n").distinct().select("patient_id", pick("patient_id", "_n").alias("_i"))
    return rows.join(chosen, ["patient_id", "_i"]).drop("_i", "_n")


def is_positive(value: Column, label_type: str) -> Column:
    """Positive labels: true, not 0, or more than 'No Finding' alone."""
    if label_type == "boolean":
        return F.coalesce(value.cast("boolean"), F.lit(False))
    return value != 8192 if label_type == "chexpert" else value > 0


def stats(labels: DataFrame, patients: DataFrame, positive: Column) -> DataFrame:
    """One row: patients with and without labels counted, patients with some, labels, positive ones."""
    one = labels.agg(F.countDistinct("patient_id").alias("n_patients_labeled"), F.count(F.lit(1)).alias("n_labels"), F.coalesce(F.sum(positive.cast("long")), F.lit(0)).alias("n_positive"))
    return one.crossJoin(patients.agg(F.countDistinct("patient_id").alias("n_patients")))


def consolidated(sets: list[DataFrame]) -> DataFrame:
    """The distinct (patient_id, prediction_time) of several label sets, as boolean labels of value False."""
    out = sets[0].select("patient_id", "prediction_time")
    for s in sets[1:]:
        out = out.unionByName(s.select("patient_id", "prediction_time"))
    return out.distinct().withColumns({"value": F.lit(False), "label_type": F.lit("boolean")})


def adults_only(labels: DataFrame, births: DataFrame, years: int = 18) -> DataFrame:
    """Without each patient's leading run of labels before the year in which they turn `years`."""
    so_far = Window.partitionBy("patient_id").orderBy("prediction_time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    old = (F.year("prediction_time") - F.year("birth_time") >= years).cast("int")
    rows = labels.join(births.select("patient_id", "birth_time"), "patient_id").withColumn("_ok", F.max(old).over(so_far))
    return rows.filter("_ok = 1").drop("_ok", "birth_time")


def with_split(labels: DataFrame, splits: DataFrame, missing: str | None = None) -> DataFrame:
    """labels with the split of their patient; patients without one go to `missing`, or are left out if it is None."""
    own = splits.select(F.col("omop_person_id").alias("patient_id"), "split")
    if missing is None:
        return labels.join(own, "patient_id")
    return labels.join(own, "patient_id", "left").withColumn("split", F.coalesce("split", F.lit(missing)))


def hash_split(patients: DataFrame, seed: int = 97) -> DataFrame:
    """(split, omop_person_id): 70 % train, 15 % val, 15 % test by a seeded hash."""
    h = random_num(seed, F.col("patient_id"), 0)
    return patients.select(split_of(h).alias("split"), F.col("patient_id").alias("omop_person_id"))


def splits_overlap(splits: DataFrame) -> DataFrame:
    """Patients in more than one split; a sound split has none."""
    return splits.groupBy("omop_person_id").agg(F.countDistinct("split").alias("n_splits")).filter("n_splits > 1")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one set but not, or less often, in the other, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def with_value(labels: DataFrame, value, label_type: str) -> DataFrame:
    """Labels of exactly this value in the typed column of label_type."""
    column = {"boolean": "bool_value", "categorical": "int_value", "numerical": "float_value"}[label_type]
    return labels.filter((F.col("label_type") == label_type) & (F.col(column) == F.lit(value)))


def unpacked(value: Column, bits: int = 14) -> list[Column]:
    """The bits of a packed multi-label, most significant first."""
    return [F.shiftright(value, bits - 1 - i).bitwiseAND(F.lit(1)).cast("int") for i in range(bits)]


def to_binary(value: Column, threshold: int = 1) -> Column:
    """1 for values from the threshold on; others stay."""
    return F.when(value >= threshold, 1).otherwise(value)


def typed(raw: DataFrame) -> DataFrame:
    """A label file's text values, by its label_type: booleans, integers, numbers, or minutes to an event; times to the minute of the clock, microseconds kept."""
    kind, v = F.col("label_type"), F.col("value")
    second = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.second("prediction_time").cast("decimal(18,6)"))
    survival = F.when(kind == "survival", F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (v.try_cast("double") * 60).cast("decimal(18,6)")))
    return raw.select(
        "patient_id",
        (F.col("prediction_time") - second).alias("prediction_time"),
        "label_type",
        F.when(kind == "boolean", F.lower(v) == "true").alias("bool_value"),
        F.when(kind == "categorical", v.try_cast("int")).alias("int_value"),
        F.when(kind == "numerical", v.try_cast("double")).alias("float_value"),
        survival.alias("tte"),
        F.when(kind == "survival", F.col("is_censored") if "is_censored" in raw.columns else F.lit(None)).cast("boolean").alias("is_censored"),
    )
