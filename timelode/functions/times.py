"""Column functions on timestamps without time zone."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_interval(d: timedelta) -> Column:
    """A day-time interval literal."""
    return F.lit(d)


def midnight(t: Column) -> Column:
    return t.cast("date").cast("timestamp_ntz")


def end_of_day(t: Column) -> Column:
    """23:59:59 of the day of t; what t has beyond the second stays."""
    micros = F.date_format(t, "SSSSSS").cast("int") / 1e6
    return midnight(t) + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), (F.lit(59) + micros).cast("decimal(18,6)"))


def to_minute(t: Column) -> Column:
    return F.date_trunc("minute", t).cast("timestamp_ntz")


def hours_between(a: Column, b: Column) -> Column:
    """Hours from a to b."""
    return F.timestamp_diff("MICROSECOND", a, b) / 3.6e9


def shifted(t: Column, d: timedelta | None) -> Column:
    return t if not d else t + as_interval(d)
