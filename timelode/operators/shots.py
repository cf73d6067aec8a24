"""Nested few-shot samples of labelled rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sizes of each sampling strategy; -1 takes all.
STRATEGIES = {
    "few": [1, 2, 4, 8, 12, 16, 24, 32, 48, 64, 128],
    "long": [-1],
    "all": [1, 2, 4, 8, 12, 16, 24, 32, 48, 64, 128, -1],
    "debug": [10],
    "mimic": [-1],
}


def k_shots(rows: DataFrame, ks: list[int], replicates: int = 5, keys: tuple[str, ...] = ("sub_task", "split"), ident: tuple[str, ...] = ("patient_id", "prediction_time"), keep_prevalence: bool = False, rank=None) -> DataFrame:
    """rows (keys, ident, value) drawn k per class, for each k and replicate.

    Rows of a class are ranked once per replicate by a seeded hash, and a sample takes the first k, so that
    samples nest. Where a class is smaller than k its rows come again. k = -1 takes all rows, replicate 0 only.
    """
    spark = rows.sparkSession
    draws = spark.createDataFrame([(r,) for r in range(replicates)], "replicate int")
    some = [k for k in ks if k != -1]
    ranking = rank if rank is not None else [F.xxhash64("replicate", *ident), *ident]
    of_class = Window.partitionBy(*keys, "value", "replicate").orderBy(*ranking)
    ranked = rows.crossJoin(F.broadcast(draws)).withColumn("_rank", F.row_number().over(of_class))
    if not keep_prevalence:
        # A literal limit, so that tasks drop what no sample takes before rows are shuffled.
        ranked = ranked.filter(F.col("_rank") <= max(some, default=0))
    sizes = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_size"))
    of_keys = Window.partitionBy(*keys)
    sizes = sizes.withColumns({"_all": F.sum("_size").over(of_keys), "_classes": F.count("value").over(of_keys)})
    sizes = sizes.select(*(F.col(c).alias(f"_of_{c}") for c in (*keys, "value")), "_size", "_all", "_classes")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, "value")))
    want = F.greatest(F.lit(1), F.floor(F.col("_classes") * F.col("k") * F.col("_size") / F.col("_all"))) if keep_prevalence else F.col("k")
    wanted = spark.createDataFrame([(k,) for k in some], "k int")
    drawn = ranked.join(sizes, same).crossJoin(F.broadcast(wanted)).withColumn("_want", want.cast("long")).filter(F.col("_rank") <= F.col("_want"))
    again = F.sequence(F.lit(0), F.floor((F.col("_want") - F.col("_rank")) / F.col("_size")).cast("int"))
    out = drawn.withColumn("copy", F.explode(again)).select(*keys, "k", "replicate", *ident, "value", "copy")
    if -1 in ks:
        out = out.unionByName(rows.withColumns({"k": F.lit(-1), "replicate": F.lit(0), "copy": F.lit(0)}).select(out.columns))
    return out.select(*keys, "k", "replicate", *ident, "value", "copy")


def as_json(shots: DataFrame) -> DataFrame:
    """One JSON document for each sub_task: sizes, replicates and splits with ids, times and values."""
    per = shots.groupBy("sub_task", "k", "replicate", "split").agg(F.sort_array(F.collect_list(F.struct("patient_id", "prediction_time", "value"))).alias("rows"))
    cell = F.struct(F.col("rows.patient_id").alias("patient_ids"), F.transform("rows.prediction_time", lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).alias("label_times"), F.col("rows.value").alias("label_values"))
    nest = lambda df, keys, name, value: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(name).cast("string"), F.col(value)))).alias("m"))
    out = nest(per.withColumn("cell", cell), ["sub_task", "k", "replicate"], "split", "cell")
    out = nest(out, ["sub_task", "k"], "replicate", "m")
    return nest(out, ["sub_task"], "k", "m").select("sub_task", F.to_json("m").alias("shots"))
