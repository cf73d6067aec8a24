"""Ranks over all rows, without one task that sees them all.

Rows are dealt to ranges of the order, whose bounds Spark samples, and numbered within their range; a running total of
the ranges' sizes, one row for each range, turns that into ranks. A key's rows may lie in many ranges, so a key that
holds most rows is split like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelode.sources.shared import written


def ranked(rows: DataFrame, order: list[str], keys: tuple[str, ...] = (), rank: str = "rank", count: str | None = None) -> DataFrame:
    """rows with their rank from 0 in the order of columns within keys, and on demand the count of each key's rows. Of rows that are equal in the order any may come first."""
    at = F.monotonically_increasing_id()
    # Such an id has the number of the partition above 33 bits and that of the row in it below.
    placed = written(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", at), "ranges")
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_before") + nth)
    if keys:
        names = [f"_of_{k}" for k in keys]
        of_key = out.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_count"))
        same = F.lit(True)
        for k, n in zip(keys, names, strict=True):
            same = same & F.col(k).eqNullSafe(F.col(n))
        out = out.join(of_key, same)
    else:
        out = out.crossJoin(F.broadcast(sizes.agg(F.lit(0).alias("_first"), F.sum("_n").alias("_count"))))
    return out.select(*rows.columns, (F.col("_rank") - F.col("_first")).alias(rank), *([F.col("_count").alias(count)] if count else []))
