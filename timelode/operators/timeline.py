"""Predicates on timelines: bounds, visits, stays, deaths, and whether something happens in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.sources.shared import written

#: Codes of visits, deaths and intensive-care sites.
INPATIENT, OUTPATIENT, EMERGENCY_INPATIENT = "Visit/IP", "Visit/OP", "Visit/ERIP"
DEATH = "Condition Type/OMOP4822053"
DEATH_MIMIC = "SNOMED/419620001"
ICU_SITES = [
    "CARE_SITE/7928450",
    "CARE_SITE/7930385",
    "CARE_SITE/7930600",
    "CARE_SITE/7928852",
    "CARE_SITE/7928619",
    "CARE_SITE/7929727",
    "CARE_SITE/7928675",
    "CARE_SITE/7930225",
    "CARE_SITE/7928759",
    "CARE_SITE/7928227",
    "CARE_SITE/7928810",
    "CARE_SITE/7929179",
    "CARE_SITE/7928650",
    "CARE_SITE/7929351",
    "CARE_SITE/7928457",
    "CARE_SITE/7928195",
    "CARE_SITE/7930681",
    "CARE_SITE/7930670",
    "CARE_SITE/7930176",
    "CARE_SITE/7931420",
    "CARE_SITE/7929149",
    "CARE_SITE/7930857",
    "CARE_SITE/7931186",
    "CARE_SITE/7930934",
    "CARE_SITE/7930924",
]


def indexed(events: DataFrame, *tie: str) -> DataFrame:
    """events with event_idx, their place in the patient's timeline from 0."""
    order = Window.partitionBy("patient_id").orderBy("start_time", *tie)
    return events.withColumn("event_idx", (F.row_number().over(order) - 1).cast("int"))


def bounds(events: DataFrame) -> DataFrame:
    """(patient_id, first_time, last_time): starts of the first and last event."""
    return events.groupBy("patient_id").agg(F.min("start_time").alias("first_time"), F.max("start_time").alias("last_time"))


#: Events from which on a code is frequent; there are few such codes, so they are broadcast.
FREQUENT_ROWS = 100_000
#: Codes up to which a set is joined as it is.
SET_ROWS = 100_000


def frequent_codes(events: DataFrame) -> DataFrame:
    """(code): the codes of FREQUENT_ROWS events or more, written."""
    counts = events.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return written(counts.filter(F.col("code").isNotNull() & (F.col("n") >= FREQUENT_ROWS)).select("code"), "frequent")


def with_codes(events: DataFrame, codes: DataFrame | list[str]) -> DataFrame:
    """Events whose code is one of codes.

    A set too large to broadcast has events dealt out by code. Frequent codes, which would each fill one task, are
    looked up in a broadcast list before, whether they are in the set or not.
    """
    if isinstance(codes, list):
        return events.filter(F.col("code").isin(codes))
    codes = codes.select("code").distinct()
    if codes.count() <= SET_ROWS:
        return events.join(codes, "code", "left_semi")
    from timelode.operators.asof import united

    frequent = frequent_codes(events)
    often = events.join(F.broadcast(frequent.join(codes, "code", "left_semi")), "code", "left_semi")
    rest = events.join(F.broadcast(frequent), "code", "left_anti").join(codes, "code", "left_semi")
    both, keys = united(["patient_id"], often, rest)
    return both.select(F.col(keys[0]).alias("patient_id"), *(c for c in both.columns if c not in keys)).select(events.columns)


def stays(events: DataFrame, codes: DataFrame | list[str], omop_table: str) -> DataFrame:
    """Visits with one of codes in omop_table. A missing or reversed bound fails the query; visits without duration are dropped."""
    found = with_codes(events.filter(F.col("omop_table") == omop_table), codes)
    wrong = F.col("start_time").isNull() | F.col("end_time").isNull() | (F.col("start_time") > F.col("end_time"))
    checked = found.filter(F.when(wrong, F.raise_error(F.lit("a visit has no or reversed bounds")).cast("boolean")).otherwise(F.col("start_time") != F.col("end_time")))
    return checked.select("patient_id", "event_idx", "start_time", "end_time", "visit_id")


def admissions(events: DataFrame, codes: DataFrame | list[str] | None = None) -> DataFrame:
    return stays(events, [INPATIENT] if codes is None else codes, "visit_occurrence")


def outpatient_visits(events: DataFrame) -> DataFrame:
    return stays(events, [OUTPATIENT], "visit_occurrence")


def icu_stays(events: DataFrame, codes: DataFrame | list[str] | None = None) -> DataFrame:
    return stays(events, ICU_SITES if codes is None else codes, "visit_detail")


def deaths(events: DataFrame, codes: DataFrame | list[str] | None = None) -> DataFrame:
    return with_codes(events, [DEATH] if codes is None else codes).select("patient_id", "start_time")


def first_death(events: DataFrame, codes: DataFrame | list[str] | None = None) -> DataFrame:
    return deaths(events, codes).groupBy("patient_id").agg(F.min("start_time").alias("death_time"))


def is_stay(codes: list[str], omop_table: str) -> Column:
    """Whether an event is one that stays() returns for listed codes; never null."""
    return F.coalesce((F.col("omop_table") == omop_table) & F.col("code").isin(codes) & (F.col("start_time") != F.col("end_time")), F.lit(False))


def exists_between(rows: DataFrame, events: DataFrame, start: str, end: str, excluded: DataFrame | Column | None = None) -> DataFrame:
    """rows during which, bounds included, the patient has an event that is not excluded, by a condition (which moves no rows) or by event_idx."""
    from timelode.operators.asof import next_at_or_after

    if isinstance(excluded, Column):
        events = events.filter(~excluded)
    elif excluded is not None:
        events = events.join(excluded.select("patient_id", "event_idx"), ["patient_id", "event_idx"], "left_anti")
    found = next_at_or_after(rows, F.col(start), events.select("patient_id", F.col("start_time").alias("time")), out="_next")
    return found.filter(F.col("_next") <= F.col(end)).drop("_next")


def prediction_times(events: DataFrame, codes: DataFrame | list[str] | None = None) -> DataFrame:
    """Starts of the events with one of codes, in timeline order, without consecutive repeats."""
    found = events if codes is None else with_codes(events, codes)
    before = F.lag("start_time").over(Window.partitionBy("patient_id").orderBy("event_idx"))
    return found.withColumn("_before", before).filter(~F.col("start_time").eqNullSafe(F.col("_before"))).select("patient_id", F.col("start_time").alias("prediction_time"))


def first_patients(events: DataFrame, n: int) -> DataFrame:
    """The events of the n patients of the least ids: a limit on the distinct ids, then a semi join."""
    ids = events.select("patient_id").distinct().orderBy("patient_id").limit(n)
    return events.join(F.broadcast(ids), "patient_id", "left_semi") if n <= 100_000 else events.join(ids, "patient_id", "left_semi")
