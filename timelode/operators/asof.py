"""Order kernels: the next event at or after a time, and the last one at or before it.

Both sort the union of the two sides once per key and carry the latest value along, so they cost n log n
whatever the horizon and pair nothing. They need one shuffle on the key, and none where both sides come from
a store bucketed by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def united(keys: list[str], *parts: DataFrame) -> tuple[DataFrame, list[str]]:
    """(the parts one below the other, the keys' names there).

    A union tells the planner how it is partitioned only if its parts name their keys alike by themselves; a
    key that is read under a new name does, and so parts of one bucketed table stay where they are.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    renamed = [p.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), *(c for c in p.columns if c not in keys)) for p in parts]
    out = renamed[0]
    for r in renamed[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out, names


def _merged(rows: DataFrame, at: Column, others: DataFrame, time: str, keys: list[str], ahead: bool, carry: Column, out: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    # A struct without fields can't be written, so the time stands for it.
    packed = rows.select(*keys, at.alias("_at"), F.lit(0).alias("_kind"), F.struct(*rest, at.alias("_own")).alias("_row"))
    side = others.select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_kind"), carry.alias("_carry"))
    both, names = united(keys, packed, side)
    # At equal times the other side comes first, and so counts.
    order = [F.desc("_at") if ahead else F.asc("_at"), F.desc("_kind")]
    seen = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(out, F.last("_carry", ignorenulls=True).over(seen)).filter("_kind = 0")
    own = {k: F.col(n).alias(k) for k, n in zip(keys, names, strict=True)} | {c: F.col("_row")[c].alias(c) for c in rest}
    return found.select(*(own[c] for c in rows.columns), out)


def next_at_or_after(rows: DataFrame, at: Column, events: DataFrame, time: str = "time", keys: tuple[str, ...] = ("patient_id",), out: str = "next_time") -> DataFrame:
    """rows with the first time of events at or after `at`, or null."""
    return _merged(rows, at, events.filter(F.col(time).isNotNull()), time, list(keys), True, F.col(time), out)


def last_at_or_before(rows: DataFrame, at: Column, events: DataFrame, carry: Column, time: str = "time", keys: tuple[str, ...] = ("patient_id",), out: str = "last") -> DataFrame:
    """As-of join: rows with `carry` of the last of events at or before `at`, or null."""
    return _merged(rows, at, events.filter(F.col(time).isNotNull()), time, list(keys), False, carry, out)


def exact_align(labels: DataFrame, features: DataFrame, keys: tuple[str, ...] = ("patient_id", "prediction_time")) -> DataFrame:
    """labels with the features of the very same keys; a label without any fails the query."""
    joined = labels.join(features.withColumn("_there", F.lit(True)), list(keys), "left")
    guard = F.when(F.col("_there").isNull(), F.raise_error(F.lit("a label has no feature row"))).otherwise(True)
    return joined.withColumn("_there", guard).filter("_there").drop("_there")
