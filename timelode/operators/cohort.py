"""Cohort and data-set statistics."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each demographic code says.
SEX_MALE, SEX_FEMALE = "Gender/M", "Gender/F"
HISPANIC, NOT_HISPANIC = "Ethnicity/Hispanic", "Ethnicity/Not Hispanic"
RACES = {"Race/5": "white", "Race/4": "pacific_islander", "Race/3": "black", "Race/2": "asian", "Race/1": "american_indian"}


def _first(codes: list[str], order: str) -> Column:
    """The first of codes on a timeline."""
    own = F.col("code").isin(codes)
    return F.min_by(F.when(own, F.col("code")), F.when(own, F.col(order)))


def demographics(events: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """One row per patient: sex, age, ethnicity, race, events, visits, split and age flags, in one aggregation.

    Ages of exactly 60 or 80 times 365 days are in no bucket.
    """
    race = F.lit(None).cast("string")
    for code, name in RACES.items():
        race = F.when(F.col("_race") == code, name).otherwise(race)
    rows = events.groupBy("patient_id").agg(
        (F.max("start_time") - F.min("start_time")).alias("_age"),
        _first([SEX_MALE, SEX_FEMALE], "event_idx").alias("_sex"),
        _first([HISPANIC, NOT_HISPANIC], "event_idx").alias("_ethnicity"),
        _first(list(RACES), "event_idx").alias("_race"),
        F.count(F.lit(1)).alias("num_events"),
        F.countDistinct("visit_id").alias("num_visits"),
    )
    years = lambda n: F.lit(timedelta(days=365 * n))
    age = F.col("_age")
    out = rows.select(
        "patient_id",
        (F.floor(F.col("_age").cast("interval day").cast("int")) / 365.25).alias("age"),
        (age <= years(20)).alias("age_20"),
        ((age > years(20)) & (age <= years(40))).alias("age_40"),
        ((age > years(40)) & (age < years(60))).alias("age_60"),
        ((age > years(60)) & (age < years(80))).alias("age_80"),
        (age > years(80)).alias("age_plus"),
        F.coalesce(F.col("_sex") == SEX_MALE, F.lit(False)).alias("is_male"),
        F.coalesce(F.col("_ethnicity") == HISPANIC, F.lit(False)).alias("is_hispanic"),
        F.coalesce(race, F.lit("unknown")).alias("race"),
        "num_events",
        "num_visits",
    )
    if splits is None:
        return out
    own = splits.select(F.col("omop_person_id").alias("patient_id"), "split")
    return out.join(own, "patient_id", "left").withColumn("split", F.coalesce("split", F.lit("test")))


def split_summary(people: DataFrame) -> DataFrame:
    """Least, mean and greatest events, visits and age, a row for each statistic, a column for each split; whole numbers."""
    columns = ["num_events", "num_visits", "age"]
    wide = people.groupBy("split").agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))))
    long = wide.unpivot("split", [c for c in wide.columns if c != "split"], "statistic", "v")
    return long.groupBy("statistic").pivot("split", ["train", "val", "test"]).agg(F.first(F.col("v").cast("long")))


def demographic_counts(people: DataFrame) -> DataFrame:
    """Patients with each trait, a row for each trait, a column for each split, and their total."""
    traits = {c: F.col(c) for c in ("age_20", "age_40", "age_60", "age_80", "age_plus")}
    traits |= {"male": F.col("is_male"), "female": ~F.col("is_male"), "hispanic": F.col("is_hispanic"), "non_hispanic": ~F.col("is_hispanic")}
    traits |= {f"race_{r}": F.col("race") == r for r in [*RACES.values(), "unknown"]}
    traits["all"] = F.lit(True)
    wide = people.groupBy("split").agg(*(F.count_if(t).alias(n) for n, t in traits.items()))
    long = wide.unpivot("split", list(traits), "trait", "n")
    out = long.groupBy("trait").pivot("split", ["train", "val", "test"]).agg(F.sum("n"))
    zero = {s: F.coalesce(s, F.lit(0)) for s in ("train", "val", "test")}
    return out.withColumns(zero).withColumn("total", F.col("train") + F.col("val") + F.col("test"))


def task_table(labels: DataFrame, people: DataFrame, positive: Column) -> DataFrame:
    """By task and split: patients and labels, positive and negative, men, and median age. A patient may count on both sides."""
    rows = labels.join(people.select("patient_id", "split", "is_male", "age"), "patient_id").withColumn("_pos", positive)
    who = lambda test: F.countDistinct(F.when(test, F.col("patient_id")))
    per = rows.groupBy("task", "split").agg(
        who(F.col("_pos")).alias("n_pos_patients"), who(~F.col("_pos")).alias("n_neg_patients"), F.countDistinct("patient_id").alias("n_total_patients"),
        F.count_if("_pos").alias("n_pos_labels"), F.count_if(~F.col("_pos")).alias("n_neg_labels"), F.count(F.lit(1)).alias("n_total_labels"), who(F.col("is_male")).alias("n_male"),
    )
    ages = rows.select("task", "split", "patient_id", "age").distinct().groupBy("task", "split").agg(F.percentile("age", F.lit(0.5)).alias("median_age_yrs"))
    return per.join(ages, ["task", "split"])


def prevalence(labels: DataFrame, positive: Column) -> DataFrame:
    """By task and split, and by task over all splits: patients, positive patients, labels, positives, negatives, prevalence."""
    per = labels.withColumn("_pos", positive.cast("int")).groupBy("task", "split", "patient_id").agg(F.max("_pos").alias("any"), F.count(F.lit(1)).alias("n"), F.sum("_pos").alias("pos"))
    both = per.unionByName(per.withColumn("split", F.lit("all")).groupBy("task", "split", "patient_id").agg(F.max("any").alias("any"), F.sum("n").alias("n"), F.sum("pos").alias("pos")))
    out = both.groupBy("task", "split").agg(F.count(F.lit(1)).alias("n_patients"), F.sum("any").cast("long").alias("n_positive_patients"), F.sum("n").cast("long").alias("n_labels"), F.sum("pos").cast("long").alias("n_positives"))
    return out.withColumns({"n_negatives": F.col("n_labels") - F.col("n_positives"), "prevalence": F.col("n_positives") / F.col("n_labels")})


def size_counts(events: DataFrame) -> DataFrame:
    """One row: patients, events, distinct codes, distinct visits."""
    return events.agg(F.countDistinct("patient_id").alias("n_patients"), F.count(F.lit(1)).alias("n_events"), F.countDistinct("code").alias("n_codes"), F.countDistinct("visit_id").alias("n_visits"))


def per_patient(events: DataFrame, what: Column) -> DataFrame:
    """One row: median and mean over patients of a per-patient count."""
    each = events.groupBy("patient_id").agg(what.alias("n"))
    return each.agg(F.percentile("n", F.lit(0.5)).alias("median_n"), F.avg("n").alias("mean_n"))


def timeline_years(events: DataFrame) -> DataFrame:
    """One row: median and mean years between each patient's first and last event that belongs to a visit."""
    each = events.filter("visit_id IS NOT NULL").groupBy("patient_id").agg((F.timestamp_diff("MICROSECOND", F.min("start_time"), F.max("start_time")) / (86400e6 * 365.25)).alias("years"))
    return each.agg(F.percentile("years", F.lit(0.5)).alias("median_years"), F.avg("years").alias("mean_years"))


def visit_span(events: DataFrame) -> DataFrame:
    """Each patient's first and last event that belongs to a visit."""
    some = F.col("visit_id").isNotNull()
    code = lambda f: f(F.when(some, F.col("code")), F.when(some, F.col("event_idx")))
    return events.groupBy("patient_id").agg(code(F.min_by).alias("first_code"), code(F.max_by).alias("last_code"))


def ngram_stats(counts: DataFrame) -> DataFrame:
    """By n and patient: mean, median, least and greatest count of (n, pid, count)."""
    return counts.groupBy("n", "pid").agg(F.avg("count").alias("mean_count"), F.percentile("count", F.lit(0.5)).alias("median_count"), F.min("count").alias("min_count"), F.max("count").alias("max_count"))


def vocabulary_counts(vocab: DataFrame) -> DataFrame:
    """Entries in use of (type, code_string) by vocabulary, the part of the code before the slash."""
    return vocab.filter("type <> 'unused'").groupBy(F.element_at(F.split("code_string", "/"), 1).alias("vocabulary"), "type").agg(F.count(F.lit(1)).alias("n"))
