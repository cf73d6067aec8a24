"""Streaming on files, and the study workflow end to end."""


import pytest
from pyspark.sql import functions as F

from timelode.operators import labelers, timeline
from timelode.plans import workflow
from timelode.sources import sinks
from timelode.streaming import live

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def test_windowed_counts_over_files(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 10:02d}T0{i % 10}:00:00", i % 3, "view" if i % 2 else "click") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.windowed_counts(live.event_stream(spark, str(tmp_path / "in"), EVENTS))
    live.write_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.window_start.day, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The last day stays open: its window may still get rows.
    assert got == {(d, t): 5 for d in (1, 2, 3) for t in ("view", "click")}


def test_outcomes_join_in_time(spark, tmp_path):
    p = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01"), (9, "2024-06-01")], "patient_id long, t string").select("patient_id", F.col("t").cast("timestamp_ntz").alias("prediction_time"))
    o = spark.createDataFrame([(1, "2024-01-20"), (2, "2024-03-20"), (9, "2024-06-01")], "patient_id long, t string").select("patient_id", F.col("t").cast("timestamp_ntz").alias("time"))
    p.write.parquet(str(tmp_path / "p"))
    o.write.parquet(str(tmp_path / "o"))
    read = lambda n, c: spark.readStream.schema(f"patient_id long, {c} timestamp_ntz").parquet(str(tmp_path / n))
    live.write_table(live.first_outcome_within(read("p", "prediction_time"), read("o", "time")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.patient_id: r.outcome_time is not None for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: True, 2: False, 9: True}


def a_study(spark):
    n, base = 120, "2024-01-01"
    day = lambda k: F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(k)
    ids = spark.range(n).withColumnRenamed("id", "patient_id")
    visits = ids.select("patient_id", day(F.lit(1)).alias("start_time"), day(F.when(F.col("patient_id") % 2 == 0, 12).otherwise(3)).alias("end_time"), F.lit("Visit/IP").alias("code"), F.lit("visit_occurrence").alias("omop_table"))
    marks = ids.filter("patient_id % 2 = 0").select("patient_id", day(F.lit(0)).alias("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"), F.lit("A/1").alias("code"), F.lit("x").alias("omop_table"))
    events = timeline.indexed(visits.unionByName(marks), "code").withColumns({"value": F.lit(None).cast("string"), "unit": F.lit(None).cast("string"), "visit_id": F.lit(None).cast("long")})

    class Los(labelers.Labeler):
        def label(self, e):
            return labelers.long_stay(e)

    study = workflow.Study({"stay": Los()}, ks=[2, -1], replicates=2, sample_one=True, grid={"C": [1.0, 0.01]}, draws=20)
    splits = ids.select(F.when(F.col("patient_id") < 60, "train").when(F.col("patient_id") < 90, "val").otherwise("test").alias("split"), F.col("patient_id").alias("omop_person_id"))
    return study, events, splits


def test_study_end_to_end(spark):
    study, events, splits = a_study(spark)
    sets = workflow.label_stage(study, events)
    counts = workflow.feature_stage(sets, events)
    assert workflow.sample_stage(study, sets, splits).filter("k = 2").groupBy("split", "replicate", "value").count().collect()
    scores = workflow.score_stage(study, counts, sets, splits, 20)
    got = {r.metric: r.score for r in scores.collect()}
    assert got["auroc"] == pytest.approx(1.0)
    sampled = workflow.score_stage(study, counts, sets, splits, samples=workflow.sample_stage(study, sets, splits))
    assert {(r.k, r.replicate) for r in sampled.collect()} == {(2, 0), (2, 1), (-1, 0)}
    report = workflow.report_stage(scores, sets, splits)
    assert {r.split: r.n_patients for r in report["prevalence"].collect()} == {"train": 60, "val": 30, "test": 30, "all": 120}
    assert report["intervals"].count() == 3


def test_other_heads(spark, tmp_path):
    study, events, splits = a_study(spark)
    study.head, study.grid = "rf", {"n_estimators": [3], "max_depth": [3]}
    sets = workflow.label_stage(study, events)
    scores = workflow.score_stage(study, workflow.feature_stage(sets, events), sets, splits, models=str(tmp_path))
    assert {r.metric: r.score for r in scores.collect()}["auroc"] == pytest.approx(1.0)
    assert sinks.best_params(spark, f"{tmp_path}/stay/count/rf/k=-1")["n_estimators"] == 3


def test_a_failed_study_is_resumed(spark, tmp_path, monkeypatch):
    study, events, splits = a_study(spark)
    events.write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    folder, real = str(tmp_path / "study"), workflow.sample_stage

    def broken(*_):
        raise RuntimeError("the third stage fails")

    monkeypatch.setattr(workflow, "sample_stage", broken)
    with pytest.raises(RuntimeError, match="third"):
        workflow.run(spark, study, events, splits, folder)
    monkeypatch.setattr(workflow, "sample_stage", real)
    reports, stages = workflow.run(spark, study, events, splits, folder)
    assert stages.found == ["labels-stay", "features"] and stages.made == ["samples", "scores"]
    results = {tuple(r) for r in reports["results"].select("k", "replicate", "score", "value").collect()}
    assert len(results) == 9 and {v for k, _, s, v in results if s == "auroc" and k == -1} == {1.0}
    tracker, group = spark.sparkContext.statusTracker(), "resumed"
    spark.sparkContext.setJobGroup(group, group)
    _, stages = workflow.run(spark, study, events, splits, folder)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not stages.made and len(stages.found) == 4 and jobs <= 6
    # Another number of draws calls for scores alone; a refreshed stage for all after it.
    study.draws = 10
    _, stages = workflow.run(spark, study, events, splits, folder)
    assert stages.made == ["scores"]
    _, stages = workflow.run(spark, study, events, splits, folder, refresh=("features",))
    assert stages.made == ["features", "scores"]
    kept = f"{folder}/models/stay/count/lr/k=-1"
    best = sinks.best_params(spark, kept)
    assert best["auroc_val"] == 1.0 and spark.read.parquet(f"{kept}/predictions").count() == 30 and spark.read.parquet(f"{kept}/model").filter("code IS NULL").count() == 1
    preds = spark.read.parquet(f"{kept}/predictions")
    assert not sinks.save_if_better(spark.range(1), best | {"C": 5.0}, preds, kept) and sinks.best_params(spark, kept) == best
    assert sinks.save_if_better(spark.range(1), best | {"auroc_val": 1.5}, spark.createDataFrame(preds.limit(3).collect(), preds.schema), kept)
    assert sinks.best_params(spark, kept)["auroc_val"] == 1.5 and spark.read.parquet(f"{kept}/model").count() == 1
