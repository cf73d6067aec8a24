"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; for a local session that names none, one that is made and set as its checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='timelode-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/timelode-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and the folder's owner clears it
        pass


_registered: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under root(), which is removed when the process ends."""
    folder = root(spark)
    if folder not in _registered:
        _registered.add(folder)
        atexit.register(remove, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, survives lost executors, and its size is known to the planner. Columns in by become folders and come last."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from written() once nothing lazy reads it any more."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rsplit("/", 1)[0])
