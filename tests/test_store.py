"""The patient store: what its plans shuffle and push down, and that its rows are the timelines."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timelode.operators import features, labelers, ontology, timeline
from timelode.sources import readers, shared, store

T0 = datetime(2024, 1, 1)


def raw(spark, patients=40, each=30):
    rows = []
    for p in range(patients):
        for i in range(each if p else 20 * each):
            kind = ("Visit/IP", timeline.ICU_SITES[0], "LOINC/777-3", timeline.DEATH)[(i * 7 + p) % 4]
            t = T0 + timedelta(hours=37 * ((i * 13) % 50) + p)
            rows.append((p, t, t + timedelta(hours=20 + i) if "LOINC" not in kind else None, kind, str(i * 5), "g/dl", {"V": "visit_occurrence", "C": "visit_detail"}.get(kind[0], "x") if kind != timeline.DEATH else "death", i))
    return spark.createDataFrame(rows, "patient_id long, start_time timestamp_ntz, end_time timestamp_ntz, code string, value string, unit string, omop_table string, visit_id long")


@pytest.fixture(scope="module")
def kept(spark):
    return store.create(raw(spark).repartition(5), "store_of_tests", "code", "visit_id", buckets=8)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_the_timelines(spark, kept):
    want = timeline.indexed(raw(spark), "code", "visit_id")
    assert kept.select(want.columns).exceptAll(want).isEmpty() and kept.count() == want.count()
    spread = kept.select(F.input_file_name().alias("f"), "patient_id").distinct()
    assert spread.count() == 40 and spread.select("f").distinct().count() == 8
    for f in kept.inputFiles():
        rows = [(r.patient_id, r.event_idx) for r in spark.read.parquet(f).collect()]
        assert rows == sorted(rows)


LABELS = {
    "readmission": lambda e: labelers.ReadmissionLabeler().label(e),
    "icu": labelers.icu_transfer,
    "decompensation": lambda e: labelers.DecompensationLabeler().label(e),
    "lab": lambda e: labelers.lab("lab_thrombocytopenia").label(e),
    "mortality": labelers.inpatient_mortality,
    "diagnosis": lambda e: labelers.FirstDiagnosisLabeler(["LOINC/777-3"]).label(e),
    "counts": lambda e: features.count_features(timeline.admissions(e).select("patient_id", F.col("end_time").alias("prediction_time")), e),
}


@pytest.mark.parametrize("name", LABELS)
def test_labels_without_a_shuffle(spark, kept, name):
    want = LABELS[name](timeline.indexed(raw(spark), "code", "visit_id"))
    # No side is broadcast, and plans are shown in full.
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "5000"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        got = LABELS[name](kept)
        text = plan(got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "Exchange" not in text and ("Window" in text or "SortMergeJoin" in text)
    pushed = " ".join(re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", text))
    assert name == "counts" or re.search(r"(EqualTo|In)\(code", pushed)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count()


@pytest.fixture
def no_broadcast(spark):
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "5000"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_counts_with_ancestors_leave_frequent_codes_in_place(spark, kept, no_broadcast, monkeypatch):
    # Of two codes that are frequent here one has ancestors; so have two that are not, and one of these is nowhere in the hierarchy.
    monkeypatch.setattr(timeline, "FREQUENT_ROWS", 400, raising=False)
    rare = F.when(F.col("event_idx") % 97 == 3, "rare").when(F.col("event_idx") % 97 == 5, "unknown").otherwise(F.col("code"))
    events = kept.withColumn("code", rare)
    up = spark.createDataFrame([(c, a) for c, above in {"Visit/IP": ["Visit/IP", "top"], timeline.DEATH: [timeline.DEATH], "rare": ["rare", "mid", "top"]}.items() for a in above], "code string, ancestor string")
    asked = timeline.admissions(kept).select("patient_id", F.col("end_time").alias("prediction_time"))
    got = features.count_features(asked, events, up)
    text = plan(got)
    assert "hashpartitioning(code" in text and "hashpartitioning(_key0" not in text and "LeftAnti" in text
    lifted = events.join(up, "code", "left").select("patient_id", F.coalesce("ancestor", "code").alias("code"), "start_time")
    want = asked.distinct().join(lifted, "patient_id").filter("start_time <= prediction_time").groupBy("patient_id", "prediction_time", "code").count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count()
    assert {r.code for r in got.select("code").distinct().collect()} >= {"top", "mid", "rare", "unknown", "LOINC/777-3"}


def test_large_sets_of_codes_leave_frequent_codes_in_place(spark, kept, no_broadcast, monkeypatch):
    monkeypatch.setattr(timeline, "FREQUENT_ROWS", 400, raising=False)
    monkeypatch.setattr(timeline, "SET_ROWS", 2, raising=False)
    events = kept.withColumn("code", F.when(F.col("event_idx") % 97 == 3, "rare").when(F.col("event_idx") % 97 == 5, "other").otherwise(F.col("code")))
    codes = spark.createDataFrame([("Visit/IP",), ("rare",), ("rare",), ("nowhere",)], "code string")
    got = timeline.with_codes(events, codes)
    text = plan(got)
    assert got.columns == events.columns and re.search(r"BroadcastHashJoin \[code#\d+\], \[code#\d+\], LeftAnti", text) and re.search(r"BroadcastHashJoin \[code#\d+\], \[code#\d+\], LeftSemi", text)
    want = events.filter("code IN ('Visit/IP', 'rare')")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and {r.code for r in got.select("code").distinct().collect()} == {"Visit/IP", "rare"}


def test_a_join_with_orders_takes_partitions_by_rows(spark, no_broadcast, monkeypatch):
    from timelode.sources import fixtures

    monkeypatch.setattr(fixtures, "JOIN_ROWS", 1000, raising=False)
    lines = spark.range(20_000).selectExpr("id % 9000 AS l_orderkey", "id AS l_partkey")
    orders = spark.range(9000).selectExpr("id AS o_orderkey", "id * 3 AS o_custkey", "'x' AS rest")
    got = fixtures._with_orders(lines, orders)
    assert got.rdd.getNumPartitions() == 20 and got.count() == 20_000 and got.filter("o_custkey <> l_orderkey * 3").count() == 0
    assert fixtures._with_orders(lines.limit(3000), orders).count() == 3000


def test_timelines_of_some_patients(spark, kept):
    dead = timeline.deaths(kept).filter("patient_id % 7 = 0")
    got = store.of_patients(kept, dead)
    assert {r.patient_id for r in got.select("patient_id").distinct().collect()} == {0, 7, 14, 21, 28, 35}
    assert got.count() == kept.filter("patient_id % 7 = 0").count()


def test_one_store_for_the_files_as_they_are(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    raw(spark, 3, 4).coalesce(1).write.parquet(path)
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(path)

    a = store.kept(spark, [path], make, "code")
    assert store.kept(spark, [path], make, "code").count() == a.count() == 88 and len(made) == 1
    raw(spark, 4, 4).coalesce(1).write.mode("append").parquet(path)
    assert store.kept(spark, [path], make, "code").count() == 88 + 92 and len(made) == 2


def test_buckets_stay_small_in_larger_stores(spark):
    events = spark.range(3_000_000).selectExpr("id % 50000 AS patient_id", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, CAST(id % 999 AS INT)) AS start_time", "'c' AS code")
    made = store.create(events, "store_of_many", "code")
    held = [r["count"] for r in made.groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == 3_000_000 and max(held) < 300_000


def test_csv_events_become_a_store(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e/a.csv").write_text("patient_id,start_time,end_time,code,value,unit,visit_id,omop_table\n1,2024-01-02T00:00:00,,b,,,,\n1,2024-01-01T00:00:00,,a,1,,5,x\n")
    (tmp_path / "e/a.txt").write_text("not events")
    got = readers.ingest(spark, str(tmp_path / "e"), "store_of_csvs")
    assert [(r.code, r.event_idx) for r in got.orderBy("event_idx").collect()] == [("a", 0), ("b", 1)]
    assert readers.events(spark, "store_of_csvs").count() == 2
    with pytest.raises(Exception, match="EXISTS"):
        readers.ingest(spark, str(tmp_path / "e"), "store_of_csvs")
    assert store.buckets_for(0) == 8 and store.buckets_for(10**9) == 125 and store.buckets_for(10**13) == 100_000


def test_a_deep_hierarchy_takes_few_rounds(spark, monkeypatch):
    rounds, cached = [], set(spark.sparkContext._jsc.getPersistentRDDs())
    monkeypatch.setattr(ontology, "written", lambda df, name: rounds.append(name) or shared.written(df, name))
    edges = spark.range(700).selectExpr("concat('c', id) AS parent", "concat('c', id + 1) AS child").repartition(2)
    got = ontology.closure(edges, ["c0", "c650"])
    assert got.groupBy("root").count().orderBy("root").collect() == [("c0", 701), ("c650", 51)]
    assert rounds.count("closure") <= 11
    ring = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [("r0", "r0"), (None, "r1")], "parent string, child string")
    assert ontology.closure(ring, ["r4"]).count() == 9
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == cached
