"""Structured Streaming over event streams: windowed counts, running code counts, and late-resolved labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Events that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(stream: DataFrame, time: str = "ts", length: str = "1 day", slide: str | None = None, lateness: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts by window and keys; a window is given out once nothing so late can come any more."""
    # Event time needs an instant: a time without zone is read as of UTC sessions.
    rows = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", lateness)
    out = rows.groupBy(F.window("_at", length, slide or length), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def first_outcome_within(predictions: DataFrame, outcomes: DataFrame, horizon: str = "30 days", lateness: str = "1 day") -> DataFrame:
    """Stream-stream join: each prediction with the outcomes of its patient within the horizon; predictions without one come out with null once the watermark passes their horizon."""
    p = predictions.withColumn("_p", F.col("prediction_time").cast("timestamp")).withWatermark("_p", lateness)
    o = outcomes.select(F.col("patient_id").alias("_id"), F.col("time").cast("timestamp").alias("_o")).withWatermark("_o", lateness)
    near = (F.col("patient_id") == F.col("_id")) & (F.col("_o") >= F.col("_p")) & (F.col("_o") <= F.col("_p") + F.expr(f"INTERVAL {horizon}"))
    return p.join(o, near, "left_outer").select("patient_id", "prediction_time", F.col("_o").alias("outcome_time"))


def write_table(stream: DataFrame, path: str, checkpoint: str):
    """Append what is final to a Parquet folder, exactly once, and stop when all that is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
