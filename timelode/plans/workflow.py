"""The stages of a study, end to end: labels, one set of label times, features, samples, scores, reports."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode import schema
from timelode.operators import batched_lr, bootstrap, cohort, features, heads, labelers, labels, metrics, ontology, reports, shots
from timelode.plans.stages import Stages, files_of
from timelode.sources import sinks
from timelode.sources.committed import Committed
from timelode.sources.shared import written


@dataclass
class Study:
    """What a study is made of. sample_one keeps one label of each patient; ks and replicates size the samples; draws is the number of bootstrap replicates."""

    tasks: dict[str, labelers.Labeler]
    ks: list[int] = field(default_factory=lambda: [1, 2, 4, 8, 16, 32, 64, 128, -1])
    replicates: int = 5
    sample_one: bool = False
    seed: int = 97
    head: str = "lr"
    grid: dict | None = None
    model: str = "count"
    draws: int = 1000


def label_stage(study: Study, events: DataFrame) -> dict[str, DataFrame]:
    """Each task's labels, at minutes."""
    out = {}
    for name, labeler in study.tasks.items():
        rows = labels.at_minutes(labeler.label(events)).withColumn("label_type", F.lit(labeler.label_type))
        out[name] = labels.one_per_patient(rows, study.seed) if study.sample_one else rows
    return out


def feature_stage(sets: dict[str, DataFrame], events: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Counts for the label times of all tasks, made once."""
    asked = labels.consolidated(list(sets.values()))
    up = None if edges is None else ontology.ancestors(edges, events.select("code").distinct())
    return features.count_features(asked, events, up)


def _by_task(sets: dict[str, DataFrame], splits: DataFrame, name: str = "sub_task") -> DataFrame:
    """The labels of all tasks, with their splits, one below the other."""
    one = lambda n, s: labels.with_split(s, splits).select(F.lit(n).alias(name), "split", "patient_id", "prediction_time", F.col("value").cast("int").alias("value"))
    return reduce(DataFrame.unionByName, (one(n, s) for n, s in sets.items()))


def sample_stage(study: Study, sets: dict[str, DataFrame], splits: DataFrame) -> DataFrame:
    """Nested samples of the train and val rows of all tasks."""
    return shots.k_shots(_by_task(sets, splits).filter("split <> 'test'"), study.ks, study.replicates)


def score_stage(study: Study, counts: DataFrame, sets: dict[str, DataFrame], splits: DataFrame, draws: int | None = None, samples: DataFrame | None = None, models: str | None = None) -> DataFrame:
    """Scores, with bootstrap intervals, of heads fitted for each task: on each of its samples (of sample_stage) if given, else on all train rows, as k = -1.

    Regressions of all tasks, sizes, replicates and penalties are fitted together. Other heads loop on the
    driver over tasks, sizes and replicates. With a folder for models, the best of each task and k is kept there.
    """
    draws = study.draws if draws is None else draws
    rows = _by_task(sets, splits)
    if samples is None:
        samples = rows.filter("split <> 'test'").withColumns({"k": F.lit(-1), "replicate": F.lit(0), "copy": F.lit(0)})
    fitted = _regressions if study.head == "lr" else _heads
    preds = fitted(study, counts, rows, samples, models)
    return bootstrap.intervals(preds, ["sub_task", "k", "replicate"], draws)


def _regressions(study: Study, counts: DataFrame, rows: DataFrame, samples: DataFrame, models: str | None) -> DataFrame:
    """(sub_task, k, replicate, patient_id, pred, y) of test rows, by the penalty of each sample that ranks its val rows best."""
    spark, time = counts.sparkSession, ["patient_id", "prediction_time"]
    codes = written(features.numbered_codes(counts), "numbered-codes")
    arrays = written(features.as_arrays(counts, codes), "feature-arrays")
    key = ["sub_task", "k", "replicate"]
    # One row for each sample of the study.
    numbers = sorted(map(tuple, samples.select(*key).distinct().collect()))
    of = spark.createDataFrame([(*n, i) for i, n in enumerate(numbers)], samples.select(*key).schema.add("sample", "integer"))
    drawn = written(samples.join(F.broadcast(of), key).groupBy("split", "sample", *time, "value").agg(F.count(F.lit(1)).alias("weight")).withColumnRenamed("value", "y"), "drawn")
    width = codes.count()
    data = batched_lr.grouped(arrays, drawn.filter("split = 'train'"), tuple(time))
    made = batched_lr.fit(written(data, "study-rows"), width, (study.grid or heads.GRIDS["lr"])["C"])
    # One row for each model.
    about = spark.createDataFrame([(m, int(s), float(c), *numbers[int(s)]) for m, (s, c) in enumerate(zip(made.sample, made.penalty, strict=True))], "model int, sample int, C double, sub_task string, k int, replicate int")
    scored = written(made.scores(arrays, time), "study-scores").join(F.broadcast(about), "model")
    val = scored.join(drawn.filter("split = 'val'").select("sample", *time, "y", "weight"), ["sample", *time])
    areas = metrics.auroc(val, ["model"], "weight").select("model", F.coalesce("auroc", F.lit(-1.0)).alias("auroc"))
    ranked = about.join(areas, "model", "left").select("sample", F.struct(F.coalesce("auroc", F.lit(-1.0)).alias("auroc"), (-F.col("model")).alias("first")).alias("b"))
    best = written(ranked.groupBy("sample").agg(F.max("b").alias("b")).select("sample", (-F.col("b.first")).alias("model"), F.col("b.auroc").alias("auroc")), "best-models")
    test = rows.filter("split = 'test'").select("sub_task", *time, F.col("value").alias("y"))
    preds = written(scored.join(F.broadcast(best.select("model")), "model", "left_semi").join(test, ["sub_task", *time]).select(*key, *time, "pred", "y"), "test-scores")
    if models is not None:
        kept = best.join(about, ["sample", "model"]).collect()
        # Of a task and k, the replicate that ranks val rows best; the first of equals.
        for (task, k), own in {(r.sub_task, r.k): max((x for x in kept if (x.sub_task, x.k) == (r.sub_task, r.k)), key=lambda x: (x.auroc, -x.replicate)) for r in kept}.items():
            weights = spark.createDataFrame([(int(i), float(w)) for i, w in enumerate(made.weight[own.model]) if w or i == width], "idx int, weight double").join(codes, "idx", "left")
            about_best = {"sub_task": task, "k": k, "replicate": own.replicate, "model": study.model, "head": "lr", "C": own.C, "auroc_val": own.auroc}
            sinks.save_if_better(weights, about_best, preds.filter((F.col("sub_task") == task) & (F.col("k") == k) & (F.col("replicate") == own.replicate)), f"{models}/{task}/{study.model}/lr/k={k}")
    return preds


def _heads(study: Study, counts: DataFrame, rows: DataFrame, samples: DataFrame, models: str | None) -> DataFrame:
    """As _regressions, for the heads of pyspark.ml."""
    codes = written(features.numbered_codes(counts), "numbered-codes")
    vectors = written(features.as_vectors(counts, codes), "feature-vectors")
    out = None
    for r in samples.select("sub_task", "k", "replicate").distinct().orderBy("sub_task", "k", "replicate").collect():
        own = samples.filter((F.col("sub_task") == r.sub_task) & (F.col("k") == r.k) & (F.col("replicate") == r.replicate)).withColumn("y", F.col("value").cast("double"))
        drawn = lambda split, own=own: own.filter(F.col("split") == split).join(vectors, ["patient_id", "prediction_time"])
        model, params, area = heads.fit_best(drawn("train"), drawn("val"), study.head, study.grid)
        test = rows.filter((F.col("sub_task") == r.sub_task) & (F.col("split") == "test")).withColumn("y", F.col("value").cast("double")).join(vectors, ["patient_id", "prediction_time"])
        preds = heads.probability(model, test).select("sub_task", F.lit(r.k).alias("k"), F.lit(r.replicate).alias("replicate"), "patient_id", "prediction_time", "pred", "y")
        if models is not None:
            about = {"sub_task": r.sub_task, "k": r.k, "replicate": r.replicate, "model": study.model, "head": study.head, **params, "auroc_val": area}
            sinks.save_if_better(model, about, preds, f"{models}/{r.sub_task}/{study.model}/{study.head}/k={r.k}")
        out = preds if out is None else out.unionByName(preds)
    return out


def report_stage(scores: DataFrame, sets: dict[str, DataFrame], splits: DataFrame) -> dict[str, DataFrame]:
    """Prevalence of all tasks, and scores by task prefix."""
    named = scores.select("sub_task", F.lit("count").alias("model"), F.lit("head").alias("head"), F.col("metric").alias("score"), F.col("score").alias("value"), "std")
    return {"prevalence": cohort.prevalence(_by_task(sets, splits, "task"), F.col("value") > 0), "intervals": reports.grouped_interval(named)}


def run(spark: SparkSession, study: Study, events: DataFrame, splits: DataFrame, folder: str, edges: DataFrame | None = None, refresh: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], Stages]:
    """A whole study in a folder: its stages are kept and resumed, its results upserted by key, its best models kept. The reports, and what the stages did."""
    stages = Stages(spark, f"{folder}/stages", refresh)
    inputs = {"events": files_of(events), "splits": files_of(splits), "edges": None if edges is None else files_of(edges)}
    sets = {}
    for name, labeler in study.tasks.items():
        one = Study({name: labeler}, sample_one=study.sample_one, seed=study.seed)
        sets[name] = stages.run(f"labels-{name}", lambda one=one, name=name: label_stage(one, events)[name], sample_one=study.sample_one, seed=study.seed, events=inputs["events"])
    made = tuple(f"labels-{n}" for n in sets)
    counts = stages.run("features", lambda: feature_stage(sets, events, edges), made, events=inputs["events"], edges=inputs["edges"])
    samples = stages.run("samples", lambda: sample_stage(study, sets, splits), made, ks=study.ks, replicates=study.replicates, splits=inputs["splits"])
    scores = stages.run("scores", lambda: score_stage(study, counts, sets, splits, samples=samples, models=f"{folder}/models"), ("features", "samples"), head=study.head, grid=study.grid, draws=study.draws, splits=inputs["splits"])
    results = Committed(spark, f"{folder}/results", schema.RESULTS)
    if "scores" in stages.made:
        params = json.dumps({"grid": study.grid, "draws": study.draws})
        results.upsert(scores.select(F.col("sub_task").alias("labeling_function"), "sub_task", F.lit(study.model).alias("model"), F.lit(study.head).alias("head"), "replicate", "k", F.col("metric").alias("score"), F.col("score").alias("value"), "std", "lower", "mean", "upper", F.lit(params).alias("model_hparams")))
    return report_stage(scores, sets, splits) | {"results": results.read()}, stages
