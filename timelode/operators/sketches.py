"""Sizes and medians over all events by sketches that merge, so that new data is added without reading the old again.

Distinct counts are HyperLogLog sketches, one row for each day of events; their relative standard error is
about 1.04 / sqrt(2^LG), 0.8 % at 14. Medians over patients come from one row for each patient, which is
summed exactly, and a KLL sketch of those rows: a quantile's rank is off by at most about RANK_ERROR of all patients.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the distinct-count sketches (log2 of their cells) and of the quantile sketches, with what they promise.
LG, K = 14, 400
RELATIVE_ERROR, RANK_ERROR = 1.04 / 2 ** (LG / 2), 0.01
DISTINCT = {"patients": "patient_id", "codes": "code", "visits": "visit_id"}


def days(events: DataFrame) -> DataFrame:
    """(day, n_events, patients, codes, visits): counts and sketches of each day's events, of a batch or of all."""
    return events.groupBy(F.col("start_time").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n_events"), *(F.hll_sketch_agg(c, LG).alias(name) for name, c in DISTINCT.items()))


def merged_days(*parts: DataFrame) -> DataFrame:
    """The days of several batches as those of one."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("day").agg(F.sum("n_events").alias("n_events"), *(F.hll_union_agg(name).alias(name) for name in DISTINCT))


def sizes(of_days: DataFrame) -> DataFrame:
    """One row: events, exactly, and about how many patients, codes and visits, over the days given (all, or a range of them)."""
    return of_days.agg(F.sum("n_events").alias("n_events"), *(F.hll_sketch_estimate(F.hll_union_agg(name)).alias(f"n_{name}") for name in DISTINCT))


def patients(events: DataFrame) -> DataFrame:
    """(patient_id, n_events, visits, first_time, last_time): each patient's events and, by a sketch, visits; bounds of the events that belong to a visit."""
    own = F.when(F.col("visit_id").isNotNull(), F.col("start_time"))
    return events.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_events"), F.hll_sketch_agg("visit_id", 8).alias("visits"), F.min(own).alias("first_time"), F.max(own).alias("last_time"))


def merged_patients(*parts: DataFrame) -> DataFrame:
    """The patients of several batches as those of one."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("patient_id").agg(F.sum("n_events").alias("n_events"), F.hll_union_agg("visits").alias("visits"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))


def medians(of_patients: DataFrame) -> DataFrame:
    """One row: medians over patients of events, visits and years between the first and last event of a visit."""
    years = F.timestamp_diff("MICROSECOND", F.col("first_time"), F.col("last_time")) / (86400e6 * 365.25)
    columns = {"n_events": F.col("n_events").cast("double"), "n_visits": F.hll_sketch_estimate("visits").cast("double"), "years": years}
    half = lambda c: F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(c, F.lit(K)), F.lit(0.5))
    return of_patients.agg(*(half(c).alias(f"median_{name}") for name, c in columns.items()))
