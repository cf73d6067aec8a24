"""Queries of features, samples, metrics, reports, rollouts, heads and exports, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelode.functions import rollout_tokens
from timelode.operators import bootstrap, cohort, features, heads, labels, metrics, ontology, reports, shots, sketches, timeline
from timelode.plans.label_queries import _LOS, _W, label_long_los
from timelode.sources import fixtures as fx
from timelode.sources import sinks
from timelode.sources.fixtures import EDGES_SQL, PREDICTIONS_SQL, RESULTS_SQL, ROLLOUTS_SQL, SPLITS_SQL

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_RES = f"WITH {RESULTS_SQL}"

# Features


_ASKED = "q AS (SELECT DISTINCT patient_id, end_time AS t FROM ip)"
_UP = "own AS (SELECT DISTINCT code FROM ev), up AS (SELECT code, code AS a FROM own UNION SELECT child, parent FROM edge UNION SELECT x.child, y.parent FROM edge x JOIN edge y ON x.parent = y.child)"


def _asked(spark, sf):
    return timeline.admissions(fx.visits(spark, sf)).select("patient_id", F.col("end_time").alias("prediction_time"))


@query(f"{_W}, {_ASKED} SELECT q.patient_id, q.t AS prediction_time, code, count(*) AS n FROM q JOIN ev ON ev.patient_id = q.patient_id AND ev.start_time <= q.t GROUP BY 1, 2, 3")
def count_features(spark, sf):
    return features.count_features(_asked(spark, sf), fx.timeline(spark, sf))


@query(f"{_W.replace('WITH', 'WITH ' + EDGES_SQL + ',', 1)}, {_ASKED}, {_UP} SELECT q.patient_id, q.t AS prediction_time, a AS code, count(*) AS n FROM q JOIN ev ON ev.patient_id = q.patient_id AND ev.start_time <= q.t JOIN up ON up.code = ev.code GROUP BY 1, 2, 3")
def count_features_with_ancestors(spark, sf):
    events = fx.timeline(spark, sf)
    up = ontology.ancestors(fx.edges(spark, sf), events.select("code").distinct())
    return features.count_features(_asked(spark, sf), events, up)


@query(f"{_W}, a AS (SELECT ip.patient_id, end_time AS prediction_time, date_diff('microsecond', first_time, end_time) / (86400e6 * 365.25) AS age FROM ip JOIN bnd USING (patient_id)), m AS (SELECT avg(age) AS mu, stddev_samp(age) AS sd FROM a) SELECT patient_id, prediction_time, round(age, 6) AS age, round((age - mu) / sd, 6) AS age_z FROM a, m")
def age_feature(spark, sf):
    return _rounded(features.age_feature(_asked(spark, sf), fx.births(spark, sf)), "age", "age_z")


@query(f"{_RES} SELECT DISTINCT labeling_function, CASE labeling_function WHEN 'lab_anemia' THEN 'Anemia' WHEN 'new_celiac' THEN 'Celiac' ELSE labeling_function END AS task_name, CASE labeling_function WHEN 'lab_anemia' THEN 'Anticipating Lab Test Results' WHEN 'new_celiac' THEN 'Assignment of New Diagnoses' ELSE '-' END AS group_name, CASE labeling_function WHEN 'lab_anemia' THEN 10 WHEN 'new_celiac' THEN 14 ELSE 18 END AS task_order FROM res")
def results_in_print(spark, sf):
    out = reports.in_print(fx.results(spark, sf).select("labeling_function").distinct())
    return out.select("labeling_function", "task_name", F.coalesce("group_name", F.lit("-")).alias("group_name"), "task_order")


@query(f"{_W}, a AS (SELECT ip.patient_id, end_time AS prediction_time, date_diff('microsecond', first_time, end_time) / (86400e6 * 365.25) AS age FROM ip JOIN bnd USING (patient_id)), {SPLITS_SQL}, m AS (SELECT avg(age) AS mu, stddev_samp(age) AS sd FROM a JOIN spl ON patient_id = omop_person_id WHERE split = 'train') SELECT patient_id, prediction_time, round(age, 6) AS age, round((age - mu) / sd, 6) AS age_z FROM a, m")
def age_feature_by_train(spark, sf):
    train = fx.splits(spark, sf).filter("split = 'train'").select(F.col("omop_person_id").alias("patient_id"))
    return _rounded(features.age_feature(_asked(spark, sf), fx.births(spark, sf), train), "age", "age_z")


# Samples


_SHOT_ROWS = f"SELECT 'toxic' AS sub_task, split, row_id, y AS value FROM prd WHERE split = 'test' UNION ALL SELECT 'quality', split, row_id, quality FROM prd"


def _shot_rows(spark, sf):
    p = fx.predictions(spark, sf)
    return p.filter("split = 'test'").selectExpr("'toxic' AS sub_task", "split", "row_id", "y AS value").unionByName(p.selectExpr("'quality' AS sub_task", "split", "row_id", "quality AS value"))


def _rank():
    return [F.expr("pmod(row_id * (replicate + 7) * 31, 101)"), F.col("row_id")]
_RANKED = f"WITH {PREDICTIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sub_task, split, value, replicate ORDER BY (row_id * (replicate + 7) * 31) % 101, row_id) AS rn, count(*) OVER (PARTITION BY sub_task, split, value, replicate) AS size, count(*) OVER (PARTITION BY sub_task, split, replicate) AS total FROM ({_SHOT_ROWS}), (SELECT CAST(unnest(range(3)) AS INT) AS replicate)), c AS (SELECT sub_task, split, count(DISTINCT value) AS classes FROM ({_SHOT_ROWS}) GROUP BY 1, 2), w AS (SELECT *, CAST(unnest([2, 8, 64]) AS INT) AS k FROM r)"


@query(f"{_RANKED} SELECT sub_task, split, k, replicate, row_id, value, CAST(unnest(range((k - rn) // size + 1)) AS INT) AS copy FROM w WHERE rn <= k UNION ALL SELECT sub_task, split, CAST(-1 AS INT), replicate, row_id, value, 0 FROM r WHERE replicate = 0")
def k_shot_nested(spark, sf):
    return shots.k_shots(_shot_rows(spark, sf), [2, 8, 64, -1], 3, ident=("row_id",), rank=_rank())


@query(f"{_RANKED}, v AS (SELECT w.*, greatest(1, floor(classes * k * size / total)::BIGINT) AS want FROM w JOIN c USING (sub_task, split)) SELECT sub_task, split, k, replicate, row_id, value, CAST(unnest(range((want - rn) // size + 1)) AS INT) AS copy FROM v WHERE rn <= want")
def k_shot_prevalence(spark, sf):
    return shots.k_shots(_shot_rows(spark, sf), [2, 8, 64], 3, ident=("row_id",), keep_prevalence=True, rank=_rank())


def k_shot_json(spark, sf):
    rows = label_long_los(spark, sf).selectExpr("'long_los' AS sub_task", "'train' AS split", "patient_id", "prediction_time", "CAST(value AS INT) AS value")
    return shots.as_json(shots.k_shots(rows, [1, 4], 2))


query()(k_shot_json)


# Metrics

_PRD = f"WITH {PREDICTIONS_SQL}"
_AUC = "sum(a.w * b.w * CASE WHEN a.pred > b.pred THEN 1.0 WHEN a.pred = b.pred THEN 0.5 ELSE 0 END) / sum(a.w * b.w)"


@query(f"{_PRD}, p AS (SELECT model, y, pred, 1.0::DOUBLE AS w FROM prd) SELECT a.model, round({_AUC}, 6) AS auroc FROM p a JOIN p b ON a.model = b.model AND a.y = 1 AND b.y = 0 GROUP BY 1")
def auroc(spark, sf):
    return _rounded(metrics.auroc(fx.predictions(spark, sf), ["model"]), "auroc")


@query(f"{_PRD}, p AS (SELECT model, y, pred, w::DOUBLE AS w FROM prd) SELECT a.model, round({_AUC}, 6) AS auroc FROM p a JOIN p b ON a.model = b.model AND a.y = 1 AND b.y = 0 GROUP BY 1")
def auroc_weighted(spark, sf):
    return _rounded(metrics.auroc(fx.predictions(spark, sf), ["model"], "w"), "auroc")


_AP = "SELECT a.model, round(sum(a.w * a.y * (SELECT sum(b.w * b.y) / sum(b.w) FROM p b WHERE b.model = a.model AND b.pred >= a.pred)) / sum(a.w * a.y), 6) AS auprc FROM p a GROUP BY 1"


@query(f"{_PRD}, p AS (SELECT model, y, pred, 1.0::DOUBLE AS w FROM prd) {_AP}")
def average_precision(spark, sf):
    return _rounded(metrics.average_precision(fx.predictions(spark, sf), ["model"]), "auprc")


@query(f"{_PRD}, p AS (SELECT model, y, pred, w::DOUBLE AS w FROM prd) {_AP}")
def average_precision_weighted(spark, sf):
    return _rounded(metrics.average_precision(fx.predictions(spark, sf), ["model"], "w"), "auprc")


@query(f"{_PRD} SELECT model, round(sum(w * (pred - y) * (pred - y)) / sum(w), 6) AS brier FROM prd GROUP BY 1")
def brier(spark, sf):
    return _rounded(metrics.brier(fx.predictions(spark, sf), ["model"], "w"), "brier")


@query(f"{_PRD} SELECT split, round(count(*) FILTER (WHERE pred >= 0.5 AND y = 1) / count(*) FILTER (WHERE pred >= 0.5), 6) AS precision, round(count(*) FILTER (WHERE pred >= 0.5 AND y = 1) / count(*) FILTER (WHERE y = 1), 6) AS recall, round(count(*) FILTER (WHERE (pred >= 0.5) = (y = 1)) / count(*), 6) AS accuracy FROM prd GROUP BY 1")
def prf_at_half(spark, sf):
    return _rounded(metrics.at_half(fx.predictions(spark, sf), ["split"]), "precision", "recall", "accuracy")


_M = bootstrap.MODULUS
_TIMES = "CASE " + " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(bootstrap.cutoffs())) + f" ELSE {len(bootstrap.cutoffs())} END"
_HASHED = f"""d AS (SELECT patient_id, replicate, {_TIMES} AS times FROM (SELECT *, CAST((x * {bootstrap.MIX} + a) % {_M} AS DOUBLE) / {_M} AS u FROM (SELECT patient_id, replicate, a, (x * x + replicate) % {_M} AS x FROM (
    SELECT patient_id, replicate, patient_id % {_M} AS a, ((patient_id % {_M}) * {bootstrap.STEP} + replicate * {bootstrap.SPREAD} + 11) % {_M} AS x FROM (SELECT DISTINCT patient_id FROM prd), (SELECT unnest(range(1, 1001)) AS replicate)))))"""
_INTERVAL = "round(score, 6) AS score, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.025), 6) AS lower, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.975), 6) AS upper"
_OVER = "OVER (PARTITION BY model, replicate ORDER BY pred DESC)"


@query(f"""{_PRD}, {_HASHED}, p AS (SELECT model, 0 AS replicate, y, pred, 1.0::DOUBLE AS w FROM prd UNION ALL SELECT model, replicate, y, pred, times::DOUBLE FROM prd JOIN d USING (patient_id) WHERE times > 0),
    g AS (SELECT model, replicate, pred, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM p GROUP BY 1, 2, 3), c AS (SELECT *, sum(pos) {_OVER} AS tp, sum(pos + neg) {_OVER} AS n FROM g),
    e AS (SELECT model, replicate, unnest(['auroc', 'auprc', 'brier']) AS metric, unnest([sum(neg * (tp - pos / 2)) / nullif(sum(pos) * sum(neg), 0), sum(pos * tp / n) / nullif(sum(pos), 0), sum(pos * (1 - pred) * (1 - pred) + neg * pred * pred) / sum(pos + neg)]) AS v FROM c GROUP BY 1, 2),
    s AS (SELECT model, metric, v AS score FROM e WHERE replicate = 0) SELECT s.model, s.metric, {_INTERVAL} FROM s JOIN e USING (model, metric) WHERE replicate > 0 GROUP BY s.model, s.metric, score""")
def bootstrap_ci(spark, sf):
    return _rounded(bootstrap.intervals(fx.predictions(spark, sf), ["model"]), "score", "std", "lower", "mean", "upper")


def bootstrap_seeded(spark, sf):
    p = fx.predictions(spark, sf)
    return metrics.bootstrap(p, metrics.seeded_draws(p.select("patient_id"), 50), ["model"])


def bootstrap_poisson(spark, sf):
    p = fx.predictions(spark, sf)
    return metrics.bootstrap(p, metrics.hashed_draws(p.select("patient_id"), 50), ["model"])


query()(bootstrap_seeded)
query()(bootstrap_poisson)


@query(f"{_PRD}, r AS (SELECT *, row_number() OVER (ORDER BY n_chars, row_id) AS rn, count(*) OVER () AS n FROM prd WHERE split = 'test'), b AS (SELECT *, CAST(greatest(0, ceil((rn - 1) * 4 / (n - 1)) - 1) AS INT) AS bucket FROM r) SELECT bucket, round(avg((pred - y) * (pred - y)), 6) AS brier, count(*) AS n FROM b GROUP BY 1")
def brier_by_quartile(spark, sf):
    return _rounded(reports.brier_by_bucket(reports.buckets(fx.predictions(spark, sf).filter("split = 'test'"), "n_chars", 4, "row_id")), "brier")


# Reports

_MEANS = "SELECT labeling_function, sub_task, model, head, score, k, avg(value) AS mean_value, coalesce(stddev_samp(value), 0) AS std_value FROM res GROUP BY ALL"


@query(f"{_RES} SELECT labeling_function, sub_task, model, head, score, k, round(mean_value, 6) AS mean_value, round(std_value, 6) AS std_value FROM ({_MEANS})")
def results_mean_std(spark, sf):
    return _rounded(reports.mean_std(fx.results(spark, sf)), "mean_value", "std_value")


@query(f"{_RES} SELECT model, head, score, k, round(avg(mean_value), 6) AS mean_value FROM ({_MEANS}) GROUP BY ALL")
def results_taskgroup(spark, sf):
    return _rounded(reports.mean_over_tasks(reports.mean_std(fx.results(spark, sf))), "mean_value")


def _cell(k: int) -> str:
    return f"coalesce(max(CASE WHEN k = {k} THEN format('{{:.3f}} ± {{:.3f}}', mean_value, std_value) END), '-') AS {'k_all' if k == -1 else f'k_{k}'}"


@query(f"{_RES}, m AS ({_MEANS}) SELECT sub_task, model, head, score, {', '.join(map(_cell, (1, 8, 64, -1)))} FROM m GROUP BY ALL")
def results_pivot(spark, sf):
    out = reports.pivoted(reports.mean_std(fx.results(spark, sf)), [1, 8, 64, -1])
    return out.na.fill("-")


@query(f"{_RES} SELECT * FROM (SELECT DISTINCT labeling_function, sub_task FROM res), (SELECT DISTINCT model, head FROM res), (SELECT DISTINCT k FROM res) EXCEPT SELECT DISTINCT labeling_function, sub_task, model, head, k FROM res WHERE row_idx % 3 <> 0")
def missing_combos(spark, sf):
    r = fx.results(spark, sf)
    have = r.filter("row_idx % 3 <> 0")
    every = r.select("labeling_function", "sub_task").distinct().crossJoin(r.select("model", "head").distinct()).crossJoin(r.select("k").distinct())
    return every.join(have, every.columns, "left_anti")


@query(f"{_RES} SELECT * FROM (SELECT DISTINCT labeling_function, sub_task FROM res), (SELECT DISTINCT model, head FROM res), (SELECT DISTINCT k FROM res) EXCEPT SELECT DISTINCT labeling_function, sub_task, model, head, k FROM res")
def missing_combos_default(spark, sf):
    return reports.missing_combinations(fx.results(spark, sf))


@query(f"{_RES} SELECT coalesce(model, '-') AS model, coalesce(head, '-') AS head, coalesce(sub_task, '-') AS sub_task, count(*) AS n, CAST(3 - grouping(model) - grouping(head) - grouping(sub_task) AS INT) AS level FROM res GROUP BY GROUPING SETS ((model), (model, head), (model, head, sub_task))")
def results_prefix_counts(spark, sf):
    return reports.counts_by_prefix(fx.results(spark, sf), ["model", "head", "sub_task"]).na.fill("-")


@query(f"{_RES}, l AS (SELECT score, sub_task, model, head, arg_max(value, row_idx) AS value, arg_max(std, row_idx) AS std FROM res WHERE k = -1 GROUP BY ALL), g AS (SELECT left(sub_task, 4) AS task_prefix, model, head, score, avg(value) AS e, sqrt(sum(std * std)) / count(*) AS d FROM l GROUP BY ALL) SELECT task_prefix, model, head, score, round(e, 6) AS estimate, round(d, 6) AS deviation, round(e - 1.96 * d, 6) AS low, round(e + 1.96 * d, 6) AS high FROM g")
def grouped_ci(spark, sf):
    return _rounded(reports.grouped_interval(reports.last_by(fx.results(spark, sf), "row_idx")), "estimate", "deviation", "low", "high")


@query(f"{_RES} SELECT score, sub_task, model, head, arg_max(value, row_idx) AS value, arg_max(std, row_idx) AS std FROM res WHERE k = -1 GROUP BY ALL")
def results_last(spark, sf):
    return reports.last_by(fx.results(spark, sf), "row_idx")


@query(f"{_RES} SELECT sub_task, model, head, score, k, replicate, value FROM (SELECT *, row_number() OVER (PARTITION BY sub_task, model, head, score, k ORDER BY value DESC, replicate) AS n FROM res) WHERE n = 1")
def results_best_replicate(spark, sf):
    return reports.best_replicate(fx.results(spark, sf), ["sub_task", "model", "head", "score", "k"])


@query(f"{_RES} SELECT * FROM res WHERE score = 'auroc' AND labeling_function IN ('long_los', 'readmission') AND sub_task IN ('long_los') AND ((model = 'count' AND head = 'lr') OR (model = 'embed' AND head = 'gbm'))")
def results_filtered(spark, sf):
    return reports.matching(fx.results(spark, sf), "auroc", task_group="operational_outcomes", groups={"operational_outcomes": ["long_los", "readmission"]}, sub_tasks=["long_los"], model_heads=[("count", "lr"), ("embed", "gbm")])


@query(f"{_RES}, m AS ({_MEANS}) SELECT labeling_function, sub_task, model, head, score, k, round(mean_value, 6) AS mean_value, CAST(CASE WHEN k = -1 THEN 2 * coalesce(max(k) FILTER (WHERE k > 0) OVER (PARTITION BY labeling_function), 1) ELSE k END AS INT) AS x FROM m")
def fewshot_curve(spark, sf):
    return _rounded(reports.curve(reports.mean_std(fx.results(spark, sf))), "mean_value").drop("std_value")


@query(f"{_RES}, m AS ({_MEANS}) SELECT a.sub_task, a.model, a.head, a.score, a.k, round(a.mean_value - b.mean_value, 6) AS difference FROM m a JOIN m b ON a.sub_task = b.sub_task AND a.model = b.model AND a.head = b.head AND a.score = b.score AND b.k = -1 AND a.k <> -1")
def against_full(spark, sf):
    return _rounded(reports.against_full(reports.mean_std(fx.results(spark, sf))), "difference").select("sub_task", "model", "head", "score", "k", "difference")


@query(f"{_RES}, n AS (SELECT * REPLACE (value + 1 AS value) FROM res WHERE row_idx % 5 = 0) SELECT labeling_function, sub_task, model, head, replicate, k, score, row_idx, value FROM n UNION ALL SELECT labeling_function, sub_task, model, head, replicate, k, score, row_idx, value FROM res r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.row_idx = r.row_idx)")
def results_upsert(spark, sf):
    r = fx.results(spark, sf).drop("std")
    return sinks.upsert_results(r, r.filter("row_idx % 5 = 0").withColumn("value", F.col("value") + 1), ("labeling_function", "sub_task", "model", "head", "replicate", "k", "score", "row_idx"))


@query(f"{_RES} SELECT labeling_function, sub_task, model, head, replicate, k, score, row_idx, value FROM res WHERE row_idx % 5 <> 0")
def results_unfinished(spark, sf):
    r = fx.results(spark, sf).drop("std")
    return sinks.unfinished(r, r.filter("row_idx % 5 = 0"), ["row_idx"]).select(r.columns)


@query("WITH RECURSIVE e AS (SELECT user_id AS lr, event_id AS step, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), f AS (SELECT lr, step, n, loss AS ema FROM e WHERE n = 1 UNION ALL SELECT e.lr, e.step, e.n, f.ema * 9 / 11 + e.loss * 2 / 11 FROM f JOIN e ON e.lr = f.lr AND e.n = f.n + 1) SELECT lr, step, round(ema, 6) AS ema FROM f")
def ema_loss(spark, sf):
    rows = fx.read(spark, sf, "events").selectExpr("user_id AS lr", "event_id AS step", "value AS loss")
    return _rounded(reports.ema(rows, ["lr"], "step", "loss"), "ema")


@query("WITH r AS (SELECT user_id % 3 AS head, user_id AS uuid, CASE WHEN event_type = 'view' THEN 'val' ELSE 'test' END AS split, max(value) AS auroc FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL), b AS (SELECT head, max(auroc) AS m FROM r WHERE split = 'val' GROUP BY 1) SELECT r.* FROM r WHERE EXISTS (SELECT 1 FROM r v JOIN b ON v.head = b.head AND v.auroc = b.m WHERE v.split = 'val' AND v.head = r.head AND v.uuid = r.uuid)")
def best_run(spark, sf):
    rows = fx.read(spark, sf, "events").filter("event_type IN ('view', 'click')").groupBy((F.col("user_id") % 3).alias("head"), F.col("user_id").alias("uuid"), F.when(F.col("event_type") == "view", "val").otherwise("test").alias("split")).agg(F.max("value").alias("auroc"))
    return reports.best_step(rows, ["head"], "auroc").select("head", "uuid", "split", "auroc")


@query("SELECT CAST(least(99, floor(least(n_chars, 5000) * 100 / 5000.0)) AS INT) AS bin, count(*) AS n FROM documents GROUP BY 1")
def histogram_clamped(spark, sf):
    return reports.histogram(fx.read(spark, sf, "documents"), "n_chars", 5000.0, 100)


# Cohort

_DEMO = f"""{_W}, {SPLITS_SQL}, dm AS (
    SELECT patient_id, CAST(date_diff('microsecond', min(start_time), max(start_time)) // 86400000000 AS BIGINT) AS days, date_diff('microsecond', min(start_time), max(start_time)) / 86400e6 AS d,
           coalesce(arg_min(code, event_idx) FILTER (WHERE code LIKE 'Gender/%') = 'Gender/M', false) AS is_male, coalesce(arg_min(code, event_idx) FILTER (WHERE code LIKE 'Ethnicity/%') = 'Ethnicity/Hispanic', false) AS is_hispanic,
           CASE arg_min(code, event_idx) FILTER (WHERE code IN ('Race/1', 'Race/2', 'Race/3', 'Race/4', 'Race/5')) WHEN 'Race/5' THEN 'white' WHEN 'Race/4' THEN 'pacific_islander' WHEN 'Race/3' THEN 'black' WHEN 'Race/2' THEN 'asian' WHEN 'Race/1' THEN 'american_indian' ELSE 'unknown' END AS race,
           count(*) AS num_events, count(DISTINCT visit_id) AS num_visits FROM ev GROUP BY 1),
    dem AS (SELECT dm.patient_id, days / 365.25::DOUBLE AS age, d <= 7300 AS age_20, d > 7300 AND d <= 14600 AS age_40, d > 14600 AND d < 21900 AS age_60, d > 21900 AND d < 29200 AS age_80, d > 29200 AS age_plus, is_male, is_hispanic, race, num_events, num_visits, coalesce(split, 'test') AS split FROM dm LEFT JOIN (SELECT * FROM spl WHERE omop_person_id % 9 <> 0) ON omop_person_id = patient_id)"""


def _people(spark, sf):
    return cohort.demographics(fx.timeline(spark, sf), fx.splits(spark, sf).filter("omop_person_id % 9 <> 0"))


@query(f"{_DEMO} SELECT * REPLACE (round(age, 6) AS age) FROM dem")
def cohort_demographics(spark, sf):
    return _rounded(_people(spark, sf), "age")


_STAT = "SELECT '{f}_{c}' AS statistic, split, CAST(trunc({g}({c}::DOUBLE)) AS BIGINT) AS v FROM dem GROUP BY split"
_STATS = " UNION ALL ".join(_STAT.format(f=f, c=c, g=g) for c in ("num_events", "num_visits", "age") for f, g in (("min", "min"), ("mean", "avg"), ("max", "max")))


@query(f"{_DEMO} SELECT statistic, max(v) FILTER (WHERE split = 'train') AS train, max(v) FILTER (WHERE split = 'val') AS val, max(v) FILTER (WHERE split = 'test') AS test FROM ({_STATS}) GROUP BY 1")
def cohort_split_summary(spark, sf):
    return cohort.split_summary(_people(spark, sf))


_TRAITS = {"age_20": "age_20", "age_40": "age_40", "age_60": "age_60", "age_80": "age_80", "age_plus": "age_plus", "male": "is_male", "female": "NOT is_male", "hispanic": "is_hispanic", "non_hispanic": "NOT is_hispanic", "all": "true"} | {f"race_{r}": f"race = '{r}'" for r in [*cohort.RACES.values(), "unknown"]}


@query(f"{_DEMO} " + " UNION ALL ".join(f"SELECT '{t}' AS trait, count(*) FILTER (WHERE ({c}) AND split = 'train') AS train, count(*) FILTER (WHERE ({c}) AND split = 'val') AS val, count(*) FILTER (WHERE ({c}) AND split = 'test') AS test, count(*) FILTER (WHERE {c}) AS total FROM dem" for t, c in _TRAITS.items()))
def cohort_demo_pivot(spark, sf):
    return cohort.demographic_counts(_people(spark, sf))


@query(f"{_DEMO}, l AS (SELECT 'long_los' AS task, * FROM ({_LOS})), r AS (SELECT l.task, d.split, l.patient_id, value, is_male, age FROM l JOIN dem d USING (patient_id)) SELECT a.*, round(median_age_yrs, 6) AS median_age_yrs FROM (SELECT task, split, count(DISTINCT patient_id) FILTER (WHERE value) AS n_pos_patients, count(DISTINCT patient_id) FILTER (WHERE NOT value) AS n_neg_patients, count(DISTINCT patient_id) AS n_total_patients, count(*) FILTER (WHERE value) AS n_pos_labels, count(*) FILTER (WHERE NOT value) AS n_neg_labels, count(*) AS n_total_labels, count(DISTINCT patient_id) FILTER (WHERE is_male) AS n_male FROM r GROUP BY ALL) a JOIN (SELECT task, split, median(age) AS median_age_yrs FROM (SELECT DISTINCT task, split, patient_id, age FROM r) GROUP BY ALL) b ON a.task = b.task AND a.split = b.split")
def cohort_task_table(spark, sf):
    return _rounded(cohort.task_table(label_long_los(spark, sf).withColumn("task", F.lit("long_los")), _people(spark, sf), F.col("value")), "median_age_yrs")


@query(f"{_W}, {SPLITS_SQL}, l AS (SELECT 'long_los' AS task, split, l.patient_id, value FROM ({_LOS}) l JOIN spl ON omop_person_id = l.patient_id), u AS (SELECT * FROM l UNION ALL SELECT task, 'all', patient_id, value FROM l) SELECT task, split, count(DISTINCT patient_id) AS n_patients, count(DISTINCT patient_id) FILTER (WHERE value) AS n_positive_patients, count(*) AS n_labels, count(*) FILTER (WHERE value) AS n_positives, count(*) FILTER (WHERE NOT value) AS n_negatives, round(count(*) FILTER (WHERE value) / count(*), 6) AS prevalence FROM u GROUP BY ALL")
def task_prevalence(spark, sf):
    rows = labels.with_split(label_long_los(spark, sf), fx.splits(spark, sf)).withColumn("task", F.lit("long_los"))
    return _rounded(cohort.prevalence(rows, F.col("value")), "prevalence")


@query(f"{_W}, n AS (SELECT count(*) AS n_events, count(DISTINCT patient_id) AS p, count(DISTINCT code) AS c, count(DISTINCT visit_id) AS v FROM ev) SELECT n_events, true AS near_patients, true AS near_codes, true AS near_visits FROM n WHERE p + c + v >= 0")
def dataset_size_by_days(spark, sf):
    """By sketches of two halves of the events, merged; each count is within four standard errors of the exact one."""
    events = fx.timeline(spark, sf)
    halves = [sketches.days(events.filter(F.pmod("event_idx", F.lit(2)) == k)) for k in (0, 1)]
    exact = cohort.size_counts(events).select(*(F.col(f"n_{k}").alias(f"exact_{k}") for k in sketches.DISTINCT))
    near = lambda k: (F.abs(F.col(f"n_{k}") / F.col(f"exact_{k}") - 1) <= 4 * sketches.RELATIVE_ERROR).alias(f"near_{k}")
    return sketches.sizes(sketches.merged_days(*halves)).crossJoin(F.broadcast(exact)).select("n_events", *(near(k) for k in sketches.DISTINCT))


@query(f"{_W} SELECT count(DISTINCT patient_id) AS n_patients, count(*) AS n_events, count(DISTINCT code) AS n_codes, count(DISTINCT visit_id) AS n_visits FROM ev")
def dataset_size(spark, sf):
    return cohort.size_counts(fx.events(spark, sf))


@query(f"{_W} SELECT median(n)::DOUBLE AS median_n, round(avg(n), 6) AS mean_n FROM (SELECT patient_id, count(DISTINCT visit_id) AS n FROM ev GROUP BY 1)")
def visits_per_patient(spark, sf):
    return _rounded(cohort.per_patient(fx.events(spark, sf), F.countDistinct("visit_id")), "mean_n")


@query(f"{_W} SELECT median(n)::DOUBLE AS median_n, round(avg(n), 6) AS mean_n FROM (SELECT patient_id, count(*) AS n FROM ev GROUP BY 1)")
def events_per_patient(spark, sf):
    return _rounded(cohort.per_patient(fx.events(spark, sf), F.count(F.lit(1))), "mean_n")


@query(f"{_W} SELECT round(median(y), 6) AS median_years, round(avg(y), 6) AS mean_years FROM (SELECT date_diff('microsecond', min(start_time), max(start_time)) / (86400e6 * 365.25) AS y FROM ev WHERE visit_id IS NOT NULL GROUP BY patient_id)")
def timeline_years(spark, sf):
    return _rounded(cohort.timeline_years(fx.events(spark, sf)), "median_years", "mean_years")


@query(f"{_W} SELECT patient_id, arg_min(code, event_idx) FILTER (WHERE visit_id IS NOT NULL) AS first_code, arg_max(code, event_idx) FILTER (WHERE visit_id IS NOT NULL) AS last_code FROM ev GROUP BY 1")
def visit_span(spark, sf):
    return cohort.visit_span(fx.timeline(spark, sf))


@query("WITH g AS (SELECT CAST(1 + event_id % 4 AS INT) AS n, user_id AS pid, event_id % 17 AS count FROM events) SELECT n, pid, round(avg(count), 6) AS mean_count, median(count)::DOUBLE AS median_count, min(count) AS min_count, max(count) AS max_count FROM g GROUP BY ALL")
def ngram_stats(spark, sf):
    rows = fx.read(spark, sf, "events").selectExpr("CAST(1 + event_id % 4 AS INT) AS n", "user_id AS pid", "event_id % 17 AS count")
    return _rounded(cohort.ngram_stats(rows), "mean_count")


@query("SELECT split_part(code, '/', 1) AS vocabulary, type, count(*) AS n FROM (SELECT CASE WHEN p_size % 7 = 0 THEN 'unused' WHEN p_size % 2 = 0 THEN 'code' ELSE 'numeric' END AS type, replace(p_brand, '#', '/') || '/' || p_partkey AS code FROM part) WHERE type <> 'unused' GROUP BY ALL")
def vocab_by_prefix(spark, sf):
    rows = fx.read(spark, sf, "part").selectExpr("CASE WHEN p_size % 7 = 0 THEN 'unused' WHEN p_size % 2 = 0 THEN 'code' ELSE 'numeric' END AS type", "concat(replace(p_brand, '#', '/'), '/', p_partkey) AS code_string")
    return cohort.vocabulary_counts(rows)


# Rollouts


def _first_positive(positive: str, test: str) -> str:
    specials = ", ".join(f"'{t}'" for t in rollout_tokens.SPECIAL_TOKENS)
    return f"WITH {ROLLOUTS_SQL}, f AS (SELECT patient_id, generation, arg_min(token, place) AS token, arg_min(n_days, place) AS n FROM run WHERE token IN ({positive}, {specials}) GROUP BY 1, 2), g AS (SELECT DISTINCT patient_id, generation FROM run) SELECT g.patient_id, g.generation, coalesce(token IN ({positive}) AND {test}, false) AS hit FROM g LEFT JOIN f ON f.patient_id = g.patient_id AND f.generation = g.generation"


@query(_first_positive("'[VISIT START]'", "n <= 30"))
def zero_shot_time_horizon(spark, sf):
    return fx.rollouts(spark, sf).select("patient_id", "generation", rollout_tokens.within_horizon(F.col("tokens"), ["[VISIT START]"], 30).alias("hit"))


@query(_first_positive("'[VISIT END]'", "n >= 7"))
def zero_shot_long_stay(spark, sf):
    return fx.rollouts(spark, sf).select("patient_id", "generation", rollout_tokens.within_horizon(F.col("tokens"), ["[VISIT END]"], 7, at_most=False).alias("hit"))


@query(_first_positive("'CARE_SITE/7928450', '[VISIT END]'", "token <> '[VISIT END]'"))
def zero_shot_icu(spark, sf):
    return fx.rollouts(spark, sf).select("patient_id", "generation", rollout_tokens.first_before(F.col("tokens"), ["CARE_SITE/7928450"], ["[VISIT END]"]).alias("hit"))


@query(f"SELECT patient_id, round(avg(hit::INT), 6) AS probability FROM ({_first_positive(chr(39) + '[VISIT START]' + chr(39), 'n <= 30')}) GROUP BY 1")
def rollout_probability(spark, sf):
    return zero_shot_time_horizon(spark, sf).groupBy("patient_id").agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("probability"))


# Heads


def _vectors(spark, sf):
    return fx.read(spark, sf, "embeddings").select("vec_id", F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("features"))


@query("WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM e WHERE vec_id % 2 = 0 GROUP BY 1, 2), d AS (SELECT e.vec_id, m.label AS c, sqrt(sum((v - m.m) * (v - m.m))) AS d FROM e JOIN m USING (i) WHERE e.vec_id % 2 = 1 GROUP BY 1, 2) SELECT vec_id, arg_min(c, d) AS predicted, round(1 / sum(exp(least_d - d)), 6) AS probability FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) AS least_d FROM d) GROUP BY 1")
def protonet_predict(spark, sf):
    v = _vectors(spark, sf)
    means = heads.prototypes(v.filter("vec_id % 2 = 0"))
    return _rounded(heads.nearest_prototype(v.filter("vec_id % 2 = 1"), means, ["vec_id"]), "probability")


def _head(spark, sf, head, grid, trees=100):
    from pyspark.ml.functions import array_to_vector

    rows = _vectors(spark, sf).select("vec_id", (F.col("y") == 1).cast("double").alias("y"), array_to_vector("features").alias("features"))
    model, _, _ = heads.fit_best(rows.filter("vec_id % 5 < 3"), rows.filter("vec_id % 5 = 3"), head, grid, trees=trees)
    return heads.probability(model, rows.filter("vec_id % 5 = 4")).select("vec_id", "y", "pred")


def head_lr(spark, sf):
    return _head(spark, sf, "lr", {"C": [1e-2, 1.0]})


def head_rf(spark, sf):
    return _head(spark, sf, "rf", {"n_estimators": [10], "max_depth": [3, 5]})


def head_gbm(spark, sf):
    return _head(spark, sf, "gbm", {"max_depth": [3, -1], "learning_rate": [0.1], "num_leaves": [10]}, 10)


for _f in (head_lr, head_rf, head_gbm):
    query()(_f)


# Exports

_NUM = r"CASE WHEN regexp_full_match(value, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') THEN CAST(value AS FLOAT) END"


@query(f"{_W} SELECT patient_id AS subject_id, start_time AS time, code, coalesce({_NUM}, -1::FLOAT) AS numeric_value, coalesce(CASE WHEN ({_NUM}) IS NULL THEN value END, '-') AS text_value, coalesce(unit, '-') AS unit, omop_table FROM ev")
def meds_data(spark, sf):
    out = sinks.meds_data(fx.events(spark, sf))
    return out.withColumn("numeric_value", F.coalesce("numeric_value", F.lit(-1.0).cast("float"))).na.fill("-", ["text_value", "unit"])


@query(f"{_W} SELECT code, coalesce(max(p_name), '-') AS description FROM ev LEFT JOIN part ON code = 'P/' || p_partkey GROUP BY 1")
def meds_codes(spark, sf):
    return sinks.meds_codes(fx.events(spark, sf), fx.concepts(spark, sf)).na.fill("-", ["description"])


@query(f"WITH {SPLITS_SQL} SELECT omop_person_id AS subject_id, CASE split WHEN 'val' THEN 'tuning' WHEN 'test' THEN 'held_out' ELSE split END AS split FROM spl")
def meds_splits(spark, sf):
    return sinks.meds_splits(fx.splits(spark, sf))


@query(f"{_W} SELECT patient_id AS subject_id, prediction_time, value AS boolean_value FROM ({_LOS})")
def meds_labels(spark, sf):
    return sinks.meds_labels(label_long_los(spark, sf).withColumn("label_type", F.lit("boolean"))).select("subject_id", "prediction_time", "boolean_value")
