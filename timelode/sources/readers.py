"""Readers of the engine's file formats, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timelode import schema
from timelode.operators.labels import typed
from timelode.sources import store

RAW_EVENTS = "patient_id long, start_time timestamp_ntz, end_time timestamp_ntz, code string, value string, unit string, visit_id long, omop_table string"


def event_csvs(spark: SparkSession, folder: str) -> DataFrame:
    """All *.csv files of a folder as raw events; other files are passed over, not deleted."""
    return spark.read.schema(RAW_EVENTS).option("header", True).option("pathGlobFilter", "*.csv").csv(folder)


def ingest(spark: SparkSession, folder: str, name: str, buckets: int | None = None) -> DataFrame:
    """Events of a CSV folder as a patient store of that name: bucketed by patient, in the order of each timeline."""
    return store.create(event_csvs(spark, folder), name, "code", "value", buckets=buckets)


def events(spark: SparkSession, name: str) -> DataFrame:
    """The timelines of a patient store."""
    return store.opened(spark, name)


def labels_csv(spark: SparkSession, path: str, survival: bool = False) -> DataFrame:
    """A label file with values parsed by their label_type."""
    return typed(spark.read.schema(schema.SURVIVAL_FILE if survival else schema.LABEL_FILE).option("header", True).csv(path))


def label_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """All tasks of a folder laid out as <name>/labeled_patients.csv, or task=<name>/..., with their name."""
    raw = spark.read.schema(schema.LABEL_FILE).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder)
    return typed(raw).withColumn("task", F.regexp_extract(F.input_file_name(), r"(?:task=)?([^/=]+)/[^/]+$", 1))


def cohort_csvs(spark: SparkSession, paths: list[str], columns: str) -> DataFrame:
    """Cohort files of the same columns, one below the other, with the file that each row is from."""
    return spark.read.schema(columns).option("header", True).csv(paths).withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def splits_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.SPLITS).option("header", True).csv(path)


def chest_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Chest-film reports: findings as 1 where they are 1, else 0."""
    raw = spark.read.schema(schema.CHEST_TSV).option("header", True).option("sep", "\t").csv(path)
    flag = {c: F.coalesce((F.col(f"`{c}`") == 1).cast("int"), F.lit(0)) for c in schema.CHEST_FINDINGS}
    return raw.select("patient_id", F.expr("try_to_timestamp(start, 'yyyy-MM-dd HH:mm:ss')").cast("timestamp_ntz").alias("start_time"), *(e.alias(c) for c, e in flag.items()))


def results_csvs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result files that exist, together; missing ones are passed over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if not there:
        return spark.createDataFrame([], schema.RESULTS)
    return spark.read.schema(schema.RESULTS).option("header", True).csv(there)


def features(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows (patient_id, prediction_time, features or code and n), kept as Parquet."""
    return spark.read.parquet(path)


def parquet_tables(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """N-gram counts of several n as one table."""
    out = None
    for n, p in paths.items():
        one = spark.read.parquet(p).withColumn("n", F.lit(n))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def finetune_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Nested run logs as long rows (lr, k, model, head, sub_task, epoch, metric, split, value)."""
    raw = spark.read.schema("lr double, k int, model string, head string, sub_task string, losses array<double>, metrics array<map<string, map<string, double>>>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    keys = ["lr", "k", "model", "head", "sub_task"]
    rows = raw.select(*keys, F.posexplode("metrics").alias("epoch", "m")).select(*keys, "epoch", F.explode("m").alias("metric", "by_split"))
    return rows.select(*keys, "epoch", "metric", F.explode("by_split").alias("split", "value"))


SHOTS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField("patient_ids", T.ArrayType(T.LongType())), T.StructField("label_times", T.ArrayType(T.StringType())), T.StructField("label_values", T.ArrayType(T.IntegerType()))]))))


def shots_json(rows: DataFrame) -> DataFrame:
    """Rows (sub_task, shots JSON) as flat samples."""
    out = rows.select("sub_task", F.explode(F.from_json("shots", SHOTS)).alias("k", "a")).select("sub_task", "k", F.explode("a").alias("replicate", "b"))
    out = out.select("sub_task", F.col("k").cast("int").alias("k"), F.col("replicate").cast("int").alias("replicate"), F.explode("b").alias("split", "c"))
    one = F.arrays_zip("c.patient_ids", "c.label_times", "c.label_values")
    out = out.select("sub_task", "k", "replicate", "split", F.posexplode(one).alias("idx", "r"))
    return out.select("sub_task", "k", "replicate", "split", "idx", F.col("r.patient_ids").alias("patient_id"), F.col("r.label_times").cast("timestamp_ntz").alias("prediction_time"), F.col("r.label_values").alias("value"))


def vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    """(token, type, code_string) of a code dictionary; tokens are positions in its list."""
    raw = spark.read.schema("regular array<struct<type: string, code_string: string>>").option("multiLine", True).json(path)
    return raw.select(F.posexplode("regular").alias("token", "r")).select("token", "r.type", "r.code_string")
