"""Labelers as table functions: the same labels as the plans, called from SQL, with timelines read as streams."""

from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_store import raw

from timelode.operators import labelers, timeline
from timelode.operators.table_functions import LongestGap, Readmissions, Walk, WalkLabeler, registered

T0 = datetime(2024, 1, 1)


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def events(spark):
    rows = raw(spark, 30, 40)
    # Stays within a day, overlapping ones, and some that follow within minutes.
    more = [(p, T0 + timedelta(days=d, hours=h), T0 + timedelta(days=d, hours=h + n), "Visit/IP", None, None, "visit_occurrence", 9) for p in range(30) for d, h, n in ((p, 3, 4), (p, 9, 2), (p + 1, 0, 30), (p + 29, 1, 1), (p + 40, 5, 0))]
    return timeline.indexed(rows.unionByName(spark.createDataFrame(more, rows.schema)), "code", "visit_id", "end_time").persist()


def test_readmission_as_a_function(spark, events):
    want = labelers.ReadmissionLabeler().label(events)
    assert same(WalkLabeler(Readmissions).label(events), want) and want.count() > 50 and want.select("value").distinct().count() == 2
    registered(spark, "readmissions", Readmissions)
    events.createOrReplaceTempView("events_of_tests")
    assert same(spark.sql("SELECT * FROM readmissions(TABLE(events_of_tests) PARTITION BY patient_id ORDER BY event_idx)"), want)


def test_values_of_other_types(spark, events):
    got = {(r.patient_id, r.prediction_time): r.value for r in WalkLabeler(LongestGap).label(events).collect()}
    by = {}
    for r in events.orderBy("patient_id", "event_idx").collect():
        by.setdefault(r.patient_id, []).append(r)
    want = {}
    for p, rows in by.items():
        gap = 0.0
        for i, r in enumerate(rows):
            gap = max(gap, (r.start_time - rows[i - 1].start_time).total_seconds() / 86400 if i else 0.0)
            if r.code == "Visit/IP":
                want[p, r.start_time] = gap
    assert got == pytest.approx(want)


def test_missing_columns_are_named(spark, events):
    registered(spark, "readmissions", Readmissions)
    events.drop("omop_table").createOrReplaceTempView("events_without")
    with pytest.raises(Exception, match="needs the columns omop_table"):
        spark.sql("SELECT * FROM readmissions(TABLE(events_without) PARTITION BY patient_id ORDER BY event_idx)").collect()
    with pytest.raises(Exception, match="omop_table"):
        WalkLabeler(Readmissions).label(events.drop("omop_table"))


def test_a_long_timeline_comes_in_batches(spark):
    class Sizes(Walk):
        """The largest batch that a walk was handed, and the number of its events."""

        value, label_type = "int", "categorical"

        def __init__(self):
            self.most, self.all = 0, 0

        def batch(self, events):
            self.most, self.all = max(self.most, events.num_rows), self.all + events.num_rows
            return ()

        def end(self):
            yield T0, self.most
            yield T0 + timedelta(days=1), self.all

    rows = spark.range(300_000).select(F.lit(1).cast("long").alias("patient_id"), F.col("id").cast("int").alias("event_idx"), (F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz").alias("start_time"))
    most, n = (r.value for r in WalkLabeler(Sizes).label(rows).orderBy("prediction_time").collect())
    assert n == 300_000 and most <= 10_000


def test_what_waits_stays_small():
    walk = Readmissions()
    most = 0
    for k in range(200):
        t = [T0 + timedelta(days=5 * k, hours=i) for i in range(500)]
        own = pa.RecordBatch.from_pydict({"patient_id": [1] * 500, "event_idx": list(range(500)), "start_time": t, "end_time": [x + timedelta(days=1) for x in t], "code": ["Visit/IP" if i % 50 == 0 else "x" for i in range(500)], "omop_table": ["visit_occurrence"] * 500})
        list(walk.eval(own))
        most = max(most, len(walk.waiting))
    assert most < 10
