"""The patient store: timelines in a table bucketed by patient, each patient's events together and in order.

Everything that asks along a timeline (windows, as-of joins, horizons, bounds) is keyed by patient_id. The
store is hashed by it once, when it is written; from then on the planner knows where a patient's events are,
so those plans have no shuffle, and a filter on codes reaches the Parquet scan. A union of two parts of the
store keeps this only under a new name of the key, see asof.united().
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY, PLACE = "patient_id", "event_idx"
#: Events that a bucket may hold, and the fewest and most buckets.
BUCKET_ROWS, FEWEST, MOST = 8_000_000, 8, 100_000
#: Events of a bucket of create(). A bucket is one task's in every plan along timelines, so this bounds what a task sorts, whatever the table.
TASK_ROWS = 250_000


def buckets_for(rows: int, each: int = BUCKET_ROWS) -> int:
    return min(MOST, max(FEWEST, -(-rows // each)))


def create(events: DataFrame, name: str, *tie: str, buckets: int | None = None) -> DataFrame:
    """events as a new store, ordered by start_time and tie, with event_idx from 0 in each timeline. One shuffle, on patient_id."""
    n = buckets_for(events.count(), TASK_ROWS) if buckets is None else buckets
    order = Window.partitionBy(KEY).orderBy("start_time", *tie)
    rows = events.repartition(n, KEY).withColumn(PLACE, (F.row_number().over(order) - 1).cast("int"))
    rows.sortWithinPartitions(KEY, PLACE).write.format("parquet").bucketBy(n, KEY).sortBy(KEY, PLACE).saveAsTable(name)
    return opened(events.sparkSession, name)


def opened(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def of_patients(store: DataFrame, patients: DataFrame) -> DataFrame:
    """The timelines of some patients; neither side is shuffled where patients come from the store, or are few."""
    return store.join(patients.select(KEY).distinct(), KEY, "left_semi")


_kept: dict[tuple, str] = {}


def kept(spark: SparkSession, paths: list[str], make: Callable[[], DataFrame], *tie: str) -> DataFrame:
    """The store of make(), written once in a session for the files under paths as they are now."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    status = lambda p: (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).getFileStatus(h)
    key = (spark.sparkContext.applicationId, *((p, s.getModificationTime(), s.getLen()) for p in paths for s in [status(p)]))
    if key not in _kept or not spark.catalog.tableExists(_kept[key]):
        name = f"timelode_store_{uuid.uuid4().hex[:12]}"
        create(make(), name, *tie)
        _kept[key] = name
        atexit.register(_drop, spark, name)
    return opened(spark, _kept[key])


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session is gone, and the warehouse's owner clears it
        pass
