"""The tasks run from their own root concepts over a hierarchy, and queries of strata and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelode.operators import labelers, reports, timeline
from timelode.plans.label_queries import _LAB_SQL, _W, _first_dx
from timelode.plans.label_queries import ORACLES as LABEL_ORACLES
from timelode.plans.report_queries import _PRD, _RES, _MEANS, _rounded
from timelode.sources import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__], ORACLES[name or f.__name__] = f, sql
        return f

    return add


def _with_edges(spark, edges: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return edges.unionByName(spark.createDataFrame(pairs, "parent string, child string"))


# Each laboratory task from its roots: the measured code stands two levels below the first of them.

for _task, (_code, _, _) in _LAB_SQL.items():

    def _lab(spark, sf, task=_task, code=_code):
        root = labelers.LABS[task][0][0]
        edges = _with_edges(spark, fx.edges(spark, sf), [(root, f"between/{task}"), (f"between/{task}", code)])
        return labelers.lab(task, edges).label(fx.timeline(spark, sf))

    query(LABEL_ORACLES[_task], f"{_task}_from_roots")(_lab)

# Each first-diagnosis task from its root, under which a part of the hierarchy is put.

_UNDER = {"new_pancan": "R/0", "new_celiac": "N/7", "new_lupus": "N/24", "new_acutemi": "R/1", "new_cteph": "N/3", "new_hypertension": "R/2", "new_hyperlipidemia": "R/3"}
for _task, _root in _UNDER.items():

    def _diagnosis(spark, sf, task=_task, root=_root):
        edges = _with_edges(spark, fx.edges(spark, sf), [(labelers.DIAGNOSES[task], root)])
        return labelers.diagnosis(task, edges).label(fx.timeline(spark, sf))

    query(_first_dx(_root), f"{_task}_from_root")(_diagnosis)


@query(f"{_W}, p AS (SELECT DISTINCT patient_id FROM ev ORDER BY 1 LIMIT 40) SELECT patient_id, count(*) AS n_events FROM ev WHERE patient_id IN (SELECT patient_id FROM p) GROUP BY 1")
def events_of_first_patients(spark, sf):
    return timeline.first_patients(fx.events(spark, sf), 40).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_events"))


_STRATA = "st AS (SELECT row_id, min(n_chars) AS length FROM (SELECT doc_id AS row_id, n_chars FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id, n_chars + 5 FROM documents WHERE doc_id % 2 = 0) GROUP BY 1)"


def _strata(spark, sf):
    d = fx.read(spark, sf, "documents")
    return d.filter("doc_id % 3 <> 1").selectExpr("doc_id AS row_id", "n_chars AS length").unionByName(d.filter("doc_id % 2 = 0").selectExpr("doc_id AS row_id", "n_chars + 5 AS length"))


@query(f"{_PRD}, {_STRATA}, r AS (SELECT prd.*, length, row_number() OVER (ORDER BY length, prd.row_id) AS rn, count(*) OVER () AS n FROM prd JOIN st ON prd.row_id = st.row_id), b AS (SELECT *, CAST(greatest(0, ceil((rn - 1) * 3 / (n - 1)) - 1) AS INT) AS bucket FROM r) SELECT bucket, round(avg((pred - y) * (pred - y)), 6) AS brier, count(*) AS n FROM b GROUP BY 1")
def brier_by_tercile_of_strata(spark, sf):
    rows = reports.stratified(fx.predictions(spark, sf), _strata(spark, sf), ("row_id",))
    return _rounded(reports.brier_by_bucket(reports.buckets(rows, "length", 3, "row_id")), "brier")


@query(f"{_RES}, m AS ({_MEANS}), f AS (SELECT * FROM m WHERE labeling_function <> 'new_celiac' OR k <= 8) SELECT labeling_function, sub_task, model, head, score, k, round(mean_value, 6) AS mean_value, CAST(CASE WHEN k = -1 THEN 2 * coalesce(max(k) FILTER (WHERE k > 0) OVER (PARTITION BY labeling_function), 1) ELSE k END AS INT) AS x FROM f")
def fewshot_curve_of_few_rows(spark, sf):
    return _rounded(reports.curve(reports.mean_std(fx.results(spark, sf)), {"new_celiac": 8}), "mean_value").drop("std_value")


@query(f"{_RES} SELECT * FROM res WHERE k IN (8, -1) AND score = 'auroc'")
def results_of_ks(spark, sf):
    return reports.matching(fx.results(spark, sf), "auroc", ks=[8, -1])


@query("WITH r AS (SELECT user_id % 3 AS head, user_id AS uuid, CASE WHEN event_type = 'view' THEN 'val' ELSE 'test' END AS split, max(floor(value)) AS auroc FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL), w AS (SELECT head, uuid FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY auroc DESC, uuid) AS n FROM r WHERE split = 'val') WHERE n = 1) SELECT r.head, r.uuid, r.split, r.auroc FROM r JOIN w ON r.head = w.head AND r.uuid = w.uuid")
def best_run_of_ties(spark, sf):
    rows = fx.read(spark, sf, "events").filter("event_type IN ('view', 'click')").groupBy((F.col("user_id") % 3).alias("head"), F.col("user_id").alias("uuid"), F.when(F.col("event_type") == "view", "val").otherwise("test").alias("split")).agg(F.max(F.floor("value").cast("double")).alias("auroc"))
    return reports.best_run(rows, ["head"], "auroc").select("head", "uuid", "split", "auroc")
