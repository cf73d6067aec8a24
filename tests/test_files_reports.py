"""Readers against files of every layout, the sharded export, merged tables, printed names, and sketches that merge."""

import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_store import raw

from timelode.functions import rollout_tokens
from timelode.operators import cohort, reports, shots, sketches, timeline
from timelode.sources import readers, sinks


def test_splits_and_cohort_files(spark, tmp_path):
    (tmp_path / "splits.csv").write_text("split,omop_person_id\ntrain,1\nval,2\ntest,3\n")
    assert [tuple(r) for r in readers.splits_csv(spark, str(tmp_path / "splits.csv")).orderBy("omop_person_id").collect()] == [("train", 1), ("val", 2), ("test", 3)]
    for name, row in (("a", "1,M"), ("b", "2,F\n3,")):
        (tmp_path / f"{name}.csv").write_text(f"patient_id,gender\n{row}\n")
    got = readers.cohort_csvs(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "patient_id long, gender string")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "M", "a.csv"), (2, "F", "b.csv"), (3, None, "b.csv")]


def test_tasks_of_both_layouts(spark, tmp_path):
    text = "patient_id,prediction_time,value,label_type\n1,2024-01-01T00:05:00,{},{}\n"
    for folder, value, kind in (("guo_los", "True", "boolean"), ("task=lab_anemia", "2", "categorical")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "labeled_patients.csv").write_text(text.format(value, kind))
    got = {r.task: (r.bool_value, r.int_value, r.prediction_time) for r in readers.label_tasks(spark, str(tmp_path)).collect()}
    assert got == {"guo_los": (True, None, datetime(2024, 1, 1, 0, 5)), "lab_anemia": (None, 2, datetime(2024, 1, 1, 0, 5))}


def test_counts_of_several_n(spark, tmp_path):
    for n in (1, 2):
        spark.createDataFrame([(p, p * n) for p in range(3)], "pid long, count long").write.parquet(str(tmp_path / str(n)))
    got = readers.parquet_tables(spark, {n: str(tmp_path / str(n)) for n in (1, 2)})
    assert sorted(map(tuple, got.collect())) == sorted((p, p * n, n) for n in (1, 2) for p in range(3))


def test_samples_through_a_file(spark, tmp_path):
    rows = spark.createDataFrame([("t", s, p, datetime(2024, 1, 1 + p), p % 2) for s in ("train", "val") for p in range(6)], "sub_task string, split string, patient_id long, prediction_time timestamp_ntz, value int")
    drawn = shots.k_shots(rows, [1, 2], 2)
    shots.as_json(drawn).write.json(str(tmp_path / "shots"))
    back = readers.shots_json(spark.read.schema("sub_task string, shots string").json(str(tmp_path / "shots")))
    columns = ["sub_task", "k", "replicate", "split", "patient_id", "prediction_time", "value"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, drawn.select(columns).collect()))


def test_result_files_that_exist(spark, tmp_path):
    (tmp_path / "a.csv").write_text("labeling_function,sub_task,model,head,replicate,k,score,value,std,lower,mean,upper,model_hparams\ng,g,m,h,0,8,auroc,0.5,0.1,0.4,0.5,0.6,x\n")
    got = readers.results_csvs(spark, [str(tmp_path / "none.csv"), str(tmp_path / "a.csv")]).collect()
    assert [(r.k, r.value, r.upper, r.model_hparams) for r in got] == [(8, 0.5, 0.6, "x")]


def test_areas_of_epochs_in_long_form(spark, tmp_path):
    log = {"lr": 0.1, "k": 8, "model": "m", "head": "h", "sub_task": "t", "losses": [1.0], "metrics": [{"auroc": {"val": e / 10, "test": e / 20}} for e in range(3)]}
    (tmp_path / "r").mkdir()
    (tmp_path / "r/log.json").write_text(json.dumps(log))
    got = {(r.epoch, r.split): r.value for r in readers.finetune_logs(spark, str(tmp_path)).collect()}
    assert got == {(e, s): v for e in range(3) for s, v in (("val", e / 10), ("test", e / 20))}


def test_vocabulary_is_one_document(spark, tmp_path):
    tokens = spark.createDataFrame([(2, "b"), (0, "a"), (1, None), (10, "é")], "token int, code string").repartition(3)
    sinks.vocabulary_json(tokens, "code", str(tmp_path / "v.json"))
    sinks.vocabulary_json(tokens, "code", str(tmp_path / "v.json"))
    text = (tmp_path / "v.json").read_text()
    assert list(json.loads(text).items()) == [("0", "a"), ("1", None), ("2", "b"), ("10", "é")]


def test_sharded_export(spark, tmp_path):
    events = raw(spark, 25, 12).repartition(6)
    codes = sinks.meds_codes(events, spark.createDataFrame([("LOINC/777-3", "platelets")], "code string, description string"))
    splits = sinks.meds_splits(spark.createDataFrame([("val", 1), ("train", 2)], "split string, omop_person_id long"))
    labels = sinks.meds_labels(spark.createDataFrame([(1, datetime(2024, 1, 1), True, "boolean")], "patient_id long, prediction_time timestamp_ntz, value boolean, label_type string"))
    sinks.write_meds(str(tmp_path), sinks.meds_data(events), codes, splits, {"long_los": labels}, shards=4)
    described = json.loads((tmp_path / "metadata/dataset.json").read_text())
    assert described["meds_version"] == "0.3.3" and datetime.fromisoformat(described["created_at"])
    shards = {r.file: r for r in spark.read.parquet(str(tmp_path / "metadata/shards")).collect()}
    files = sorted((tmp_path / "data").glob("*.parquet"))
    assert {f.name for f in files} == shards.keys() and len(files) == 4
    owners = {}
    for f in files:
        rows = [(r.subject_id, r.time) for r in spark.read.parquet(str(f)).collect()]
        assert rows == sorted(rows) and len(rows) == shards[f.name].n_rows
        for s in {r[0] for r in rows}:
            assert owners.setdefault(s, f) == f and shards[f.name].first_subject <= s <= shards[f.name].last_subject
    assert len(owners) == 25 and sum(r.n_rows for r in shards.values()) == events.count()


def test_tables_of_all_tasks(spark):
    rows = spark.createDataFrame([("new_celiac", "count", "0.7"), ("own_task", "count", "0.1"), ("guo_icu", "embed", "0.9 ± 0.1"), ("guo_icu", "a,b", "0.8")], "sub_task string, model string, k_8 string")
    names = {"md": r"^# (.*)$", "html": r"<h5>(.*?)</h5>", "tex": r"^% (.*)$", "csv": r"^# (.*)$"}
    for form, pattern in names.items():
        text = reports.merged_tables(rows, form)
        assert re.findall(pattern, text, re.M) == ["ICU Admission", "Celiac", "own_task"]
    assert '"a,b",0.8' in reports.merged_tables(rows, "csv") and "sub_task" not in reports.merged_tables(rows, "md")
    got = reports.in_print(rows.withColumnRenamed("sub_task", "labeling_function")).orderBy("task_order").collect()
    assert [(r.task_name, r.group_name) for r in got[-2:]] == [("Celiac", "Assignment of New Diagnoses"), ("own_task", None)]


def test_laboratory_rollouts_are_refused():
    assert rollout_tokens.supported("guo_los") == "guo_los"
    with pytest.raises(ValueError, match="zero-shot"):
        rollout_tokens.supported("lab_anemia")


def test_curves_of_few_rows_by_default(spark):
    means = spark.createDataFrame([("new_celiac", k) for k in (8, 64, 128, -1)], "labeling_function string, k int")
    assert {r.k: r.x for r in reports.curve(means).collect()} == {8: 8, 64: 64, -1: 128}
    assert {r.k: r.x for r in reports.curve(means, {}).collect()} == {8: 8, 64: 64, 128: 128, -1: 256}


def test_sketches_merge_and_keep_their_error(spark):
    n = 40_000
    events = spark.range(n).select((F.col("id") % 9000).alias("patient_id"), (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval((F.col("id") % 300).cast("int"))).cast("timestamp_ntz").alias("start_time"), F.concat(F.lit("c"), F.col("id") % 1500).alias("code"), F.when(F.col("id") % 4 == 0, F.col("id") % 7000).alias("visit_id"))
    old, new = events.filter("hash(patient_id, start_time) % 3 = 0"), events.filter("hash(patient_id, start_time) % 3 <> 0")
    merged = sketches.merged_days(sketches.days(old), sketches.days(new))
    got, want = sketches.sizes(merged).first(), cohort.size_counts(events).first()
    assert got.n_events == want.n_events == n
    for k in ("patients", "codes", "visits"):
        assert abs(got[f"n_{k}"] / want[f"n_{k}"] - 1) < 4 * sketches.RELATIVE_ERROR
    assert tuple(got) == pytest.approx(tuple(sketches.sizes(sketches.days(events)).first()), rel=2e-3)
    some = sketches.sizes(merged.filter("day < DATE '2024-02-01'")).first()
    assert some.n_events == events.filter("start_time < '2024-02-01'").count()
    people = sketches.merged_patients(sketches.patients(old), sketches.patients(new))
    found = sketches.medians(people).first()
    exact = people.select("n_events").toPandas()["n_events"].sort_values().tolist()
    rank = sum(v <= found.median_n_events for v in exact) / len(exact)
    assert abs(rank - 0.5) <= sketches.RANK_ERROR or exact[len(exact) // 2] == found.median_n_events
    years = cohort.timeline_years(events).first()
    assert found.median_years == pytest.approx(years.median_years, rel=0.05)


def test_emergency_visits_count(spark):
    from timelode.operators import labelers

    t = datetime(2024, 1, 1)
    rows = [(1, 0, t, t + timedelta(days=2), timeline.EMERGENCY_INPATIENT, None, None, "visit_occurrence", 1), (1, 1, t + timedelta(days=1), None, timeline.DEATH_MIMIC, None, None, "death", None)]
    events = spark.createDataFrame(rows, "patient_id long, event_idx int, start_time timestamp_ntz, end_time timestamp_ntz, code string, value string, unit string, omop_table string, visit_id long")
    assert [r.value for r in labelers.mimic_mortality(events, [timeline.INPATIENT, timeline.EMERGENCY_INPATIENT]).collect()] == [True]
