"""Timelines derived from the driver's tables, by the same arithmetic in Spark and in DuckDB SQL.

Visits come from orders, laboratory values and diagnoses from line items, deaths and demographics from
orders and customers, the hierarchy from region, nation and part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.sources import store

LAB_CODES = ["LOINC/777-3", "LOINC/2823-3", "LOINC/14749-6", "LOINC/2951-2", "LOINC/718-7"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HOURS = "make_dt_interval(0, CAST({} AS INT), 0, 0)"
_ROW = ["patient_id", "start_time", "end_time", "code", "value", "unit", "omop_table", "visit_id", "seq"]


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS patient_id",
        f"o_orderdate + {_HOURS.format('o_orderkey % 24')} AS start_time",
        f"o_orderdate + {_HOURS.format('o_orderkey % 24 + (o_orderkey * 7) % 337')} AS end_time",
        "CASE o_orderstatus WHEN 'F' THEN 'Visit/IP' WHEN 'O' THEN 'CARE_SITE/7928450' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Visit/ERIP' ELSE 'Visit/OP' END END AS code",
        "CAST(NULL AS STRING) AS value", "CAST(NULL AS STRING) AS unit",
        "CASE o_orderstatus WHEN 'O' THEN 'visit_detail' ELSE 'visit_occurrence' END AS omop_table",
        "o_orderkey AS visit_id", "o_orderkey AS seq",
    )


#: Lines that a task joins with their orders, from some partitions' worth of them on.
JOIN_ROWS = 500_000


def _with_orders(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """lines with the customers of their orders; a large table is dealt out over partitions that its rows call for, so a task's share stays as it is."""
    orders, n = orders.select("o_orderkey", "o_custkey"), lines.count() // JOIN_ROWS
    if n >= 8:
        lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _with_orders(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders"))
    codes = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(LAB_CODES))
    q = "CAST(l_quantity AS INT)"
    number = f"CASE l_linenumber % 5 WHEN 0 THEN CAST({q} * 4 AS STRING) WHEN 1 THEN concat(CAST((40 + {q}) div 10 AS STRING), '.', CAST((40 + {q}) % 10 AS STRING)) WHEN 2 THEN CAST({q} * 3 AS STRING) WHEN 3 THEN CAST(110 + {q} AS STRING) ELSE CAST({q} div 3 AS STRING) END"
    return lines.selectExpr(
        "o_custkey AS patient_id",
        f"l_shipdate + {_HOURS.format('l_orderkey % 24')} AS start_time",
        "CAST(NULL AS TIMESTAMP_NTZ) AS end_time",
        f"CASE l_linenumber % 5 {codes} END AS code",
        f"CASE l_partkey % 50 WHEN 0 THEN 'Adequate' WHEN 1 THEN '>100' WHEN 2 THEN NULL WHEN 3 THEN '1_0' ELSE {number} END AS value",
        "CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'mmol/L' WHEN l_returnflag = 'N' THEN 'mg/dL' ELSE 'g/dL' END AS unit",
        "'measurement' AS omop_table",
        "CAST(NULL AS BIGINT) AS visit_id",
        "1000000000000 + l_orderkey * 100 + l_linenumber AS seq",
    )


def _diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _with_orders(read(spark, sf_dir, "lineitem").filter("l_linenumber = 1"), read(spark, sf_dir, "orders"))
    return lines.selectExpr(
        "o_custkey AS patient_id", "l_shipdate + make_dt_interval(0, 12, 0, 0) AS start_time", "CAST(NULL AS TIMESTAMP_NTZ) AS end_time",
        "concat('P/', l_partkey) AS code", "CAST(NULL AS STRING) AS value", "CAST(NULL AS STRING) AS unit", "'condition_occurrence' AS omop_table",
        "l_orderkey AS visit_id", "2000000000000 + l_orderkey AS seq",
    )


def _deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").filter("o_orderkey % 41 = 0").selectExpr(
        "o_custkey AS patient_id",
        f"o_orderdate + {_HOURS.format('o_orderkey % 24 + (o_orderkey * 5) % 337')} AS start_time",
        "CAST(NULL AS TIMESTAMP_NTZ) AS end_time", "'Condition Type/OMOP4822053' AS code", "CAST(NULL AS STRING) AS value", "CAST(NULL AS STRING) AS unit",
        "'death' AS omop_table", "CAST(NULL AS BIGINT) AS visit_id", "3000000000000 + o_orderkey AS seq",
    )


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    born = "TIMESTAMP_NTZ '1940-01-01 00:00:00' + make_dt_interval(CAST((c_custkey * 37) % 20000 AS INT), 0, 0, 0)"
    base = read(spark, sf_dir, "customer")
    row = lambda code, kind: base.selectExpr("c_custkey AS patient_id", f"{born} AS start_time", "CAST(NULL AS TIMESTAMP_NTZ) AS end_time", f"{code} AS code", "CAST(NULL AS STRING) AS value", "CAST(NULL AS STRING) AS unit", "'person' AS omop_table", "CAST(NULL AS BIGINT) AS visit_id", f"{kind}000000000000 + c_custkey AS seq")
    sex = row("CASE WHEN c_custkey % 2 = 0 THEN 'Gender/M' ELSE 'Gender/F' END", 4)
    ethnicity = row("CASE WHEN c_custkey % 5 = 0 THEN 'Ethnicity/Hispanic' ELSE 'Ethnicity/Not Hispanic' END", 5)
    race = row("concat('Race/', 1 + c_custkey % 7)", 6)
    return sex.unionByName(ethnicity).unionByName(race)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of the timelines, as a source would give them; timeline() puts them in order."""
    parts = [f(spark, sf_dir).select(*_ROW) for f in (_visits, _labs, _diagnoses, _deaths, _people)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All timelines, from a patient store that is written once in a session."""
    return store.kept(spark, [f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "customer")], lambda: events(spark, sf_dir), "seq", "code")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timelines' visits alone."""
    return timeline(spark, sf_dir).filter("omop_table IN ('visit_occurrence', 'visit_detail')")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> part as a concept hierarchy."""
    top = read(spark, sf_dir, "nation").selectExpr("concat('R/', n_regionkey) AS parent", "concat('N/', n_nationkey) AS child")
    return top.unionByName(read(spark, sf_dir, "part").selectExpr("concat('N/', p_partkey % 25) AS parent", "concat('P/', p_partkey) AS child"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("concat('P/', p_partkey) AS code", "p_name AS description")


def births(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).filter("seq < 5000000000000").selectExpr("patient_id", "start_time AS birth_time")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = "pmod(c_custkey * 97, 100)"
    return read(spark, sf_dir, "customer").selectExpr(f"CASE WHEN {h} < 70 THEN 'train' WHEN {h} < 85 THEN 'val' ELSE 'test' END AS split", "c_custkey AS omop_person_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: label against a score made from the text's length."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").selectExpr("doc_id AS row_id", "doc_id div 3 AS patient_id", "toxic AS y", "quality", "pmod(n_chars * 7 + doc_id, 97) / 97.0D AS pred", "1 + pmod(doc_id, 3) AS w", "CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS model", "CASE WHEN pmod(doc_id, 5) = 0 THEN 'val' ELSE 'test' END AS split", "n_chars")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows: scores of made-up runs by supplier."""
    return read(spark, sf_dir, "supplier").selectExpr(
        "element_at(array('long_los', 'readmission', 'lab_anemia', 'new_celiac'), CAST(1 + s_suppkey % 4 AS INT)) AS labeling_function",
        "element_at(array('long_los', 'readmission', 'lab_anemia', 'new_celiac'), CAST(1 + s_suppkey % 4 AS INT)) AS sub_task",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'count' ELSE 'embed' END AS model", "CASE WHEN s_suppkey % 5 < 3 THEN 'lr' ELSE 'gbm' END AS head",
        "CAST(s_suppkey % 5 AS INT) AS replicate", "element_at(array(1, 8, 64, -1), CAST(1 + (s_suppkey div 4) % 4 AS INT)) AS k",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'auroc' ELSE 'brier' END AS score", "pmod(s_suppkey * 31, 1000) / 1000.0D AS value", "pmod(s_suppkey * 13, 100) / 1000.0D AS std", "s_suppkey AS row_idx",
    )


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated token timelines: a user's events as tokens of elapsed time and visits, in generations of a few tokens."""
    token = "CASE event_type WHEN 'view' THEN concat('[DAY ', CAST(1 + event_id % 6 AS STRING), ']') WHEN 'click' THEN concat('[WEEK ', CAST(1 + event_id % 3 AS STRING), ']') WHEN 'purchase' THEN '[VISIT START]' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN '[VISIT END]' ELSE 'CARE_SITE/7928450' END ELSE CASE WHEN event_id % 3 = 0 THEN '[EOS]' WHEN event_id % 3 = 1 THEN '[LONG TERM]' ELSE '[MONTH 1]' END END"
    rows = read(spark, sf_dir, "events").selectExpr("user_id AS patient_id", "CAST(event_id % 4 AS INT) AS generation", "ts", "event_id", f"{token} AS token")
    return rows.groupBy("patient_id", "generation").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "token"))), lambda s: s.token).alias("tokens"))


# The same in DuckDB SQL, as common table expressions.

_LABS_SQL = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(LAB_CODES))
_NUMBER_SQL = "CASE l_linenumber % 5 WHEN 0 THEN CAST(q * 4 AS VARCHAR) WHEN 1 THEN ((40 + q) // 10)::VARCHAR || '.' || ((40 + q) % 10)::VARCHAR WHEN 2 THEN CAST(q * 3 AS VARCHAR) WHEN 3 THEN CAST(110 + q AS VARCHAR) ELSE CAST(q // 3 AS VARCHAR) END"
VISITS_SQL = """
vis AS (
  SELECT o_custkey AS patient_id, o_orderdate + to_hours(o_orderkey % 24) AS start_time, o_orderdate + to_hours(o_orderkey % 24 + (o_orderkey * 7) % 337) AS end_time,
         CASE o_orderstatus WHEN 'F' THEN 'Visit/IP' WHEN 'O' THEN 'CARE_SITE/7928450' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Visit/ERIP' ELSE 'Visit/OP' END END AS code, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS unit,
         CASE o_orderstatus WHEN 'O' THEN 'visit_detail' ELSE 'visit_occurrence' END AS omop_table, o_orderkey AS visit_id, o_orderkey AS seq
  FROM orders)"""
EVENTS_SQL = (
    VISITS_SQL
    + f""",
raw AS (
  SELECT * FROM vis
  UNION ALL
  SELECT o_custkey, l_shipdate + to_hours(l_orderkey % 24), NULL, CASE l_linenumber % 5 {_LABS_SQL} END,
         CASE l_partkey % 50 WHEN 0 THEN 'Adequate' WHEN 1 THEN '>100' WHEN 2 THEN NULL WHEN 3 THEN '1_0' ELSE {_NUMBER_SQL} END,
         CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'mmol/L' WHEN l_returnflag = 'N' THEN 'mg/dL' ELSE 'g/dL' END,
         'measurement', NULL, 1000000000000 + l_orderkey * 100 + l_linenumber
  FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem) JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT o_custkey, l_shipdate + INTERVAL 12 HOUR, NULL, 'P/' || l_partkey, NULL, NULL, 'condition_occurrence', l_orderkey, 2000000000000 + l_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1
  UNION ALL
  SELECT o_custkey, o_orderdate + to_hours(o_orderkey % 24 + (o_orderkey * 5) % 337), NULL, 'Condition Type/OMOP4822053', NULL, NULL, 'death', NULL, 3000000000000 + o_orderkey
  FROM orders WHERE o_orderkey % 41 = 0
  UNION ALL
  SELECT c_custkey, TIMESTAMP '1940-01-01' + to_days(CAST((c_custkey * 37) % 20000 AS INT)), NULL, CASE WHEN c_custkey % 2 = 0 THEN 'Gender/M' ELSE 'Gender/F' END, NULL, NULL, 'person', NULL, 4000000000000 + c_custkey FROM customer
  UNION ALL
  SELECT c_custkey, TIMESTAMP '1940-01-01' + to_days(CAST((c_custkey * 37) % 20000 AS INT)), NULL, CASE WHEN c_custkey % 5 = 0 THEN 'Ethnicity/Hispanic' ELSE 'Ethnicity/Not Hispanic' END, NULL, NULL, 'person', NULL, 5000000000000 + c_custkey FROM customer
  UNION ALL
  SELECT c_custkey, TIMESTAMP '1940-01-01' + to_days(CAST((c_custkey * 37) % 20000 AS INT)), NULL, 'Race/' || (1 + c_custkey % 7), NULL, NULL, 'person', NULL, 6000000000000 + c_custkey FROM customer),
ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY start_time, seq, code) - 1 AS INT) AS event_idx FROM raw),
bnd AS (SELECT patient_id, min(start_time) AS first_time, max(start_time) AS last_time FROM ev GROUP BY 1),
ip AS (SELECT * FROM ev WHERE code = 'Visit/IP' AND omop_table = 'visit_occurrence' AND start_time <> end_time),
icu AS (SELECT * FROM ev WHERE code = 'CARE_SITE/7928450' AND omop_table = 'visit_detail' AND start_time <> end_time),
dth AS (SELECT patient_id, start_time FROM ev WHERE code = 'Condition Type/OMOP4822053'),
fd AS (SELECT patient_id, min(start_time) AS death_time FROM dth GROUP BY 1)"""
)
EDGES_SQL = """
edge AS (
  SELECT 'R/' || n_regionkey AS parent, 'N/' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'N/' || (p_partkey % 25), 'P/' || p_partkey FROM part)"""
SPLITS_SQL = "spl AS (SELECT CASE WHEN (c_custkey * 97) % 100 < 70 THEN 'train' WHEN (c_custkey * 97) % 100 < 85 THEN 'val' ELSE 'test' END AS split, c_custkey AS omop_person_id FROM customer)"
PREDICTIONS_SQL = "prd AS (SELECT l.doc_id AS row_id, l.doc_id // 3 AS patient_id, toxic AS y, quality, ((n_chars * 7 + l.doc_id) % 97) / 97.0::DOUBLE AS pred, 1 + l.doc_id % 3 AS w, CASE WHEN l.doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS model, CASE WHEN l.doc_id % 5 = 0 THEN 'val' ELSE 'test' END AS split, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
RESULTS_SQL = """res AS (
  SELECT (['long_los', 'readmission', 'lab_anemia', 'new_celiac'])[1 + s_suppkey % 4] AS labeling_function, (['long_los', 'readmission', 'lab_anemia', 'new_celiac'])[1 + s_suppkey % 4] AS sub_task,
         CASE WHEN s_suppkey % 3 = 0 THEN 'count' ELSE 'embed' END AS model, CASE WHEN s_suppkey % 5 < 3 THEN 'lr' ELSE 'gbm' END AS head, CAST(s_suppkey % 5 AS INT) AS replicate,
         ([1, 8, 64, -1])[1 + (s_suppkey // 4) % 4] AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'auroc' ELSE 'brier' END AS score,
         ((s_suppkey * 31) % 1000) / 1000.0::DOUBLE AS value, ((s_suppkey * 13) % 100) / 1000.0::DOUBLE AS std, s_suppkey AS row_idx
  FROM supplier)"""
ROLLOUTS_SQL = """tok AS (
  SELECT user_id AS patient_id, CAST(event_id % 4 AS INT) AS generation, ts, event_id,
         CASE event_type WHEN 'view' THEN '[DAY ' || (1 + event_id % 6) || ']' WHEN 'click' THEN '[WEEK ' || (1 + event_id % 3) || ']' WHEN 'purchase' THEN '[VISIT START]'
              WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN '[VISIT END]' ELSE 'CARE_SITE/7928450' END
              ELSE CASE WHEN event_id % 3 = 0 THEN '[EOS]' WHEN event_id % 3 = 1 THEN '[LONG TERM]' ELSE '[MONTH 1]' END END AS token,
         CASE event_type WHEN 'view' THEN 1 + event_id % 6 WHEN 'click' THEN 7 * (1 + event_id % 3) WHEN 'error' THEN CASE WHEN event_id % 3 = 1 THEN 1080 WHEN event_id % 3 = 2 THEN 30 ELSE 0 END ELSE 0 END AS days
  FROM events),
run AS (SELECT *, sum(days) OVER w AS n_days, row_number() OVER w AS place FROM tok WINDOW w AS (PARTITION BY patient_id, generation ORDER BY ts, event_id))"""
