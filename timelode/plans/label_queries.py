"""Queries of labelers, timeline predicates and label sets, each with its DuckDB counterpart."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from timelode.functions.times import end_of_day
from timelode.operators import asof, labelers, labels, ontology, timeline
from timelode.operators.table_functions import Readmissions, WalkLabeler
from timelode.schema import CHEST_FINDINGS
from timelode.sources import fixtures as fx
from timelode.sources import store
from timelode.sources.fixtures import EDGES_SQL, EVENTS_SQL, SPLITS_SQL

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


EOD = "(date_trunc('day', {}) + INTERVAL '23:59:59')"
_W = "WITH " + EVENTS_SQL


def _horizon(predictions: str, outcomes: str, start: str, end: str | None, censor: bool, same: bool = True) -> str:
    """Literal reading of the horizon rule: for each prediction, over all outcomes at or after its start."""
    hit = f"coalesce(nxt <= p.t + INTERVAL {end}, false)" if end else "nxt IS NOT NULL"
    drop = "" if same else " AND NOT coalesce(nxt = p.t, false)"
    keep = f" AND ({hit} OR last_time >= p.t + INTERVAL {end})" if censor and end else ""
    return f"""{_W}, p AS (SELECT DISTINCT patient_id, t FROM ({predictions})), o AS ({outcomes}),
    n AS (SELECT p.patient_id, p.t, min(o.t) AS nxt FROM p LEFT JOIN o ON o.patient_id = p.patient_id AND o.t >= p.t + INTERVAL {start} GROUP BY 1, 2)
    SELECT p.patient_id, p.t AS prediction_time, {hit} AS value FROM n p JOIN bnd USING (patient_id) WHERE true{drop}{keep}"""


def _within(visits: str, outcomes: str) -> str:
    return f"""{_W}, v AS ({visits}), o AS ({outcomes}) SELECT v.patient_id, v.s AS prediction_time, EXISTS (SELECT 1 FROM o WHERE o.patient_id = v.patient_id AND o.t BETWEEN v.s AND v.e) AS value FROM v"""


IP_OUT, ICU_OUT, DEATH_OUT = "SELECT patient_id, start_time AS t FROM ip", "SELECT patient_id, start_time AS t FROM icu", "SELECT patient_id, start_time AS t FROM dth"


@query(f"{_W} SELECT patient_id, {EOD.format('start_time')} AS prediction_time, end_time - start_time >= INTERVAL 7 DAY AS value FROM ip WHERE start_time::DATE <> end_time::DATE")
def label_long_los(spark, sf):
    return labelers.long_stay(fx.visits(spark, sf))


_READMIT_SQL = f"SELECT patient_id, {EOD.format('end_time')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, start_time::DATE ORDER BY start_time, event_idx) AS nth FROM ip) WHERE start_time::DATE <> end_time::DATE OR nth = 1"


@query(_horizon(_READMIT_SQL, IP_OUT, "1 MINUTE", "30 DAY", True))
def label_readmission_30d(spark, sf):
    return labelers.ReadmissionLabeler().label(fx.timeline(spark, sf))


@query(_horizon(_READMIT_SQL, IP_OUT, "1 MINUTE", "30 DAY", True))
def label_readmission_as_function(spark, sf):
    return WalkLabeler(Readmissions).label(fx.timeline(spark, sf))


@query(_horizon(_READMIT_SQL.replace(EOD.format("end_time"), "end_time"), IP_OUT, "1 MINUTE", "90 DAY", True))
def label_readmission_parametrised(spark, sf):
    return labelers.ReadmissionLabeler(timedelta(days=90), lambda t: t).label(fx.timeline(spark, sf))


@query(_within(f"SELECT patient_id, {EOD.format('start_time')} AS s, end_time AS e FROM ip WHERE start_time::DATE <> end_time::DATE AND NOT EXISTS (SELECT 1 FROM icu WHERE icu.patient_id = ip.patient_id AND icu.start_time::DATE = ip.start_time::DATE)", ICU_OUT))
def label_icu_transfer(spark, sf):
    return labelers.icu_transfer(fx.timeline(spark, sf))


_SIGNUPS = "SELECT patient_id, start_time AS t FROM ev WHERE code = 'LOINC/777-3'"
_ERRORS = "SELECT patient_id, start_time AS t FROM ev WHERE code = 'LOINC/2823-3'"


def _plain(start, end, **kw):
    pick = lambda c, n: lambda e: timeline.with_codes(e, [c]).select("patient_id", F.col("start_time").alias(n))
    return labelers.HorizonLabeler(start, end, predictions=pick("LOINC/777-3", "prediction_time"), outcomes=pick("LOINC/2823-3", "time"), **kw)


@query(_horizon(_SIGNUPS, _ERRORS, "1 DAY", None, False))
def horizon_infinite(spark, sf):
    return _plain(timedelta(days=1), None).label(fx.timeline(spark, sf))


@query(_horizon(_SIGNUPS, _ERRORS, "0 DAY", "200 DAY", True))
def horizon_censored(spark, sf):
    return _plain(timedelta(0), timedelta(days=200)).label(fx.timeline(spark, sf))


@query(_horizon(_SIGNUPS, _ERRORS, "0 DAY", "200 DAY", False))
def horizon_uncensored(spark, sf):
    return _plain(timedelta(0), timedelta(days=200), apply_censoring=False).label(fx.timeline(spark, sf))


@query(_horizon(_SIGNUPS, _ERRORS, "0 DAY", "200 DAY", True, same=False))
def horizon_same_time_excluded(spark, sf):
    return _plain(timedelta(0), timedelta(days=200), allow_same_time=False).label(fx.timeline(spark, sf))


@query(_horizon(_SIGNUPS, _ERRORS, "(-2) DAY", "5 DAY", True, same=False))
def horizon_from_before(spark, sf):
    return _plain(timedelta(days=-2), timedelta(days=5), allow_same_time=False).label(fx.timeline(spark, sf))


@query(_horizon("SELECT patient_id, start_time AS t FROM ev WHERE code IN ('LOINC/777-3', 'LOINC/2951-2')", _ERRORS, "1 HOUR", "60 DAY", True, same=False))
def code_labeler(spark, sf):
    return labelers.CodeLabeler(["LOINC/2823-3"], timedelta(hours=1), timedelta(days=60), ["LOINC/777-3", "LOINC/2951-2"]).label(fx.timeline(spark, sf))


_DX = "SELECT patient_id, start_time AS t FROM ev WHERE code IN (SELECT child FROM edge WHERE parent IN (SELECT child FROM edge WHERE parent = '{r}')) OR code IN (SELECT child FROM edge WHERE parent = '{r}') OR code = '{r}'"


@query((_horizon("SELECT patient_id, start_time AS t FROM ip", _DX.format(r="R/2"), "1 HOUR", "120 DAY", True, same=False)).replace("WITH ", f"WITH {EDGES_SQL},", 1))
def concept_labeler(spark, sf):
    class AtAdmissions(labelers.ConceptLabeler):
        def predictions(self, events):
            # Visits without duration ask nothing, but the timeline still lasts until them.
            return super().predictions(events.filter("start_time <> end_time"))

    return AtAdmissions(fx.edges(spark, sf), ["R/2"], timedelta(hours=1), timedelta(days=120), ["Visit/IP"]).label(fx.timeline(spark, sf))


def _first_dx(root: str) -> str:
    p = f"SELECT i.patient_id, {EOD.format('end_time')} AS t FROM ip i LEFT JOIN (SELECT patient_id, min(t) AS f FROM ({_DX.format(r=root)}) GROUP BY 1) f ON i.patient_id = f.patient_id WHERE f IS NULL OR f.f IS NULL OR {EOD.format('end_time')} <= f.f"
    return _horizon(p, _DX.format(r=root), "1 DAY", "365 DAY", False, same=False).replace("WITH ", f"WITH {EDGES_SQL},", 1)


for _root in ("R/0", "R/1", "N/7", "N/24"):

    def _first(spark, sf, root=_root):
        return labelers.FirstDiagnosisLabeler(ontology.code_set(fx.edges(spark, sf), [root])).label(fx.timeline(spark, sf))

    query(_first_dx(_root), f"label_first_diagnosis_{_root.replace('/', '').lower()}")(_first)


_LAB_V = r"CASE WHEN regexp_full_match(value, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') THEN CAST(value AS DOUBLE) END"
_LAB_SQL = {
    "lab_thrombocytopenia": ("LOINC/777-3", "v", "CASE WHEN x < 50 THEN 3 WHEN x < 100 THEN 2 WHEN x < 150 THEN 1 ELSE 0 END"),
    "lab_hyperkalemia": ("LOINC/2823-3", "CASE WHEN lower(unit) LIKE 'mmol/l%' OR lower(unit) LIKE 'meq/l%' THEN v WHEN lower(unit) LIKE 'mg/dl%' THEN v / 18 END", "CASE WHEN x > 7 THEN 3 WHEN x > 6 THEN 2 WHEN x > 5.5 THEN 1 ELSE 0 END"),
    "lab_hypoglycemia": ("LOINC/14749-6", "CASE WHEN lower(unit) LIKE 'mg/dl%' THEN v / 18 WHEN lower(unit) LIKE 'mmol/l%' THEN v END", "CASE WHEN x < 3 THEN 3 WHEN x < 3.5 THEN 2 WHEN x <= 3.9 THEN 1 ELSE 0 END"),
    "lab_hyponatremia": ("LOINC/2951-2", "v", "CASE WHEN x < 125 THEN 3 WHEN x < 130 THEN 2 WHEN x <= 135 THEN 1 ELSE 0 END"),
    "lab_anemia": ("LOINC/718-7", "CASE WHEN lower(unit) LIKE 'g/dl%' THEN v * 10 WHEN lower(unit) LIKE 'mg/dl%' THEN v / 100 WHEN lower(unit) LIKE 'g/l%' THEN v END", "CASE WHEN x < 70 THEN 3 WHEN x < 110 THEN 2 WHEN x < 120 THEN 1 ELSE 0 END"),
}
for _task, (_code, _x, _case) in _LAB_SQL.items():

    def _lab(spark, sf, task=_task, code=_code):
        rule = labelers.LABS[task][1]
        return labelers.LabLabeler([code], **rule).label(fx.timeline(spark, sf))

    query(
        f"""{_W}, l AS (SELECT e.patient_id, start_time, value, unit, {_LAB_V} AS v FROM ev e JOIN bnd USING (patient_id) WHERE code = '{_code}' AND value IS NOT NULL AND start_time <> first_time),
        x AS (SELECT *, {_x} AS x FROM l)
        SELECT patient_id, start_time - INTERVAL 1 MINUTE AS prediction_time, CAST(CASE WHEN lower(value) IN ('normal', 'adequate') THEN 0 ELSE {_case} END AS INT) AS value
        FROM x WHERE x IS NOT NULL OR lower(value) IN ('normal', 'adequate')""",
        _task,
    )(_lab)


@query(f"{_W} SELECT count(*) AS n_rejected FROM ev JOIN bnd USING (patient_id) WHERE code = 'LOINC/2823-3' AND value IS NOT NULL AND start_time <> first_time AND lower(value) NOT IN ('normal', 'adequate') AND (({_LAB_V}) IS NULL OR unit IS NULL OR NOT (lower(unit) LIKE 'mmol/l%' OR lower(unit) LIKE 'meq/l%' OR lower(unit) LIKE 'mg/dl%'))")
def lab_rejected(spark, sf):
    own = labelers.LabLabeler(["LOINC/2823-3"], **labelers.LABS["lab_hyperkalemia"][1])
    rows = fx.timeline(spark, sf)
    rows = timeline.with_codes(rows, ["LOINC/2823-3"]).filter("value IS NOT NULL").join(timeline.bounds(rows), "patient_id").filter("start_time <> first_time")
    return rows.filter(own.severity(F.col("value"), F.col("unit")).isNull()).agg(F.count(F.lit(1)).alias("n_rejected"))


_CARE = "SELECT * FROM icu i WHERE end_time - start_time >= INTERVAL {h} HOUR AND EXISTS (SELECT 1 FROM ev e WHERE e.patient_id = i.patient_id AND NOT (e.code = 'CARE_SITE/7928450' AND e.omop_table = 'visit_detail' AND e.start_time <> e.end_time) AND e.start_time BETWEEN i.start_time AND {last})"
_GRID = f"""SELECT patient_id, unnest(generate_series(f, over - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS t, over FROM (
    SELECT c.patient_id, c.start_time + INTERVAL 4 HOUR AS f, least(c.end_time, coalesce(death_time, c.end_time)) AS over FROM ({_CARE.format(h=4, last="i.end_time")}) c LEFT JOIN fd ON c.patient_id = fd.patient_id) WHERE over > f"""


@query(_horizon(_GRID, DEATH_OUT, "0 DAY", "24 HOUR", False, same=False))
def label_decompensation_hourly(spark, sf):
    return labelers.DecompensationLabeler().label(fx.timeline(spark, sf))


@query(_within(f"SELECT patient_id, start_time + INTERVAL 48 HOUR AS s, end_time AS e FROM ({_CARE.format(h=48, last='i.start_time + INTERVAL 48 HOUR')})", DEATH_OUT))
def label_mortality_48h(spark, sf):
    return labelers.icu_mortality(fx.timeline(spark, sf))


@query(f"{_W} SELECT patient_id, t AS prediction_time, date_diff('microsecond', t, over) / 3.6e9::DOUBLE AS value FROM ({_GRID})")
def label_remaining_los(spark, sf):
    return labelers.remaining_stay(fx.timeline(spark, sf))


@query(f"{_W} SELECT ip.patient_id, start_time AS prediction_time, end_time - start_time >= INTERVAL 7 DAY AS value FROM ip LEFT JOIN fd ON ip.patient_id = fd.patient_id WHERE start_time <= end_time AND (death_time IS NULL OR start_time <= death_time)")
def label_long_admission(spark, sf):
    return labelers.long_admission(fx.timeline(spark, sf))


@query(f"{_W} SELECT ip.patient_id, {EOD.format('start_time')} AS prediction_time, coalesce(death_time BETWEEN {EOD.format('start_time')} AND end_time, false) AS value FROM ip LEFT JOIN fd ON ip.patient_id = fd.patient_id WHERE {EOD.format('start_time')} < end_time AND (death_time IS NULL OR {EOD.format('start_time')} <= death_time)")
def label_inpatient_mortality(spark, sf):
    return labelers.inpatient_mortality(fx.timeline(spark, sf))


@query(f"{_W} SELECT patient_id, {EOD.format('t')} AS prediction_time, true AS value FROM (SELECT patient_id, unnest([start_time, end_time]) AS t FROM ip)")
def label_dummy_adm_dis(spark, sf):
    return labelers.admission_and_discharge(fx.visits(spark, sf), end_of_day)


@query(f"{_W} SELECT patient_id, {EOD.format('start_time')} AS prediction_time, EXISTS (SELECT 1 FROM ip b WHERE b.patient_id = a.patient_id AND b.start_time > {EOD.format('a.start_time')} AND b.start_time <= {EOD.format('a.start_time')} + INTERVAL 30 DAY) AS value FROM ip a")
def label_mimic_readmission(spark, sf):
    return labelers.mimic_readmission(fx.visits(spark, sf))


@query(_within("SELECT patient_id, start_time AS s, end_time AS e FROM ev WHERE code IN ('Visit/IP', 'Visit/ERIP', 'Visit/OP') AND omop_table = 'visit_occurrence' AND start_time <> end_time", DEATH_OUT))
def label_mimic_mortality(spark, sf):
    return labelers.mimic_mortality(fx.timeline(spark, sf), ["Visit/IP", timeline.EMERGENCY_INPATIENT, "Visit/OP"], [timeline.DEATH])


@query(_within("SELECT patient_id, start_time AS s, end_time AS e FROM ip", "SELECT patient_id, start_time AS t FROM ev WHERE code = 'LOINC/777-3'"))
def label_within_inpatient_visit(spark, sf):
    lab = lambda e: timeline.with_codes(e, ["LOINC/777-3"]).select("patient_id", F.col("start_time").alias("time"))
    return labelers.WithinVisitLabeler(timeline.admissions, lab).label(fx.timeline(spark, sf))


_CHEX_BITS = [f"CASE WHEN (o_orderkey * {i + 3}) % 7 = 1 THEN 1 ELSE 0 END" for i in range(len(CHEST_FINDINGS))]
_CHEX = " + ".join(f"({b}) * {2 ** (13 - i)}" for i, b in enumerate(_CHEX_BITS))


def _reports(spark, sf):
    raw = fx.read(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return raw.select(F.col("o_custkey").alias("patient_id"), (F.col("o_orderdate") + F.lit(timedelta(hours=9))).alias("start_time"), *(F.expr(f"CASE WHEN (o_orderkey * {i + 3}) % 7 = 1 THEN 1.0D WHEN o_orderkey % 5 = 0 THEN NULL ELSE 0.0D END").alias(c) for i, c in enumerate(CHEST_FINDINGS)))


@query(f"{_W} SELECT o_custkey AS patient_id, o_orderdate - INTERVAL 15 HOUR AS prediction_time, CAST({_CHEX} AS INT) AS value FROM orders JOIN bnd ON o_custkey = patient_id WHERE o_orderstatus = 'P' AND o_orderdate - INTERVAL 15 HOUR > first_time")
def chexpert_pack(spark, sf):
    return labelers.chest_findings(_reports(spark, sf), fx.timeline(spark, sf), CHEST_FINDINGS)


@query(f"SELECT o_orderkey AS row_id, {', '.join(f'CAST({b} AS INT) AS b{i}' for i, b in enumerate(_CHEX_BITS))} FROM orders WHERE o_orderstatus = 'P'")
def chexpert_unpack(spark, sf):
    rows = fx.read(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("row_id"), F.expr(_CHEX).cast("int").alias("v"))
    return rows.select("row_id", *(b.alias(f"b{i}") for i, b in enumerate(labels.unpacked(F.col("v")))))


# Timeline predicates


@query(f"{_W} SELECT patient_id, event_idx, start_time, code, omop_table, coalesce(visit_id, -1) AS visit_id FROM ev")
def patient_store(spark, sf):
    return fx.timeline(spark, sf).select("patient_id", "event_idx", "start_time", "code", "omop_table", F.coalesce("visit_id", F.lit(-1).cast("long")).alias("visit_id"))


@query(f"{_W} SELECT patient_id, event_idx, code FROM ev WHERE patient_id IN (SELECT patient_id FROM dth)")
def patients_of_store(spark, sf):
    rows = fx.timeline(spark, sf)
    return store.of_patients(rows, timeline.deaths(rows)).select("patient_id", "event_idx", "code")


@query(f"{_W} SELECT * FROM bnd")
def patient_bounds(spark, sf):
    return timeline.bounds(fx.timeline(spark, sf))


for _name, _f, _code, _tab in (("inpatient_admissions", timeline.admissions, "Visit/IP", "visit_occurrence"), ("outpatient_visits", timeline.outpatient_visits, "Visit/OP", "visit_occurrence"), ("icu_stays", timeline.icu_stays, "CARE_SITE/7928450", "visit_detail")):

    def _stays(spark, sf, f=_f):
        return f(fx.visits(spark, sf)).drop("event_idx")

    query(f"WITH {fx.VISITS_SQL} SELECT patient_id, start_time, end_time, visit_id FROM vis WHERE code = '{_code}' AND omop_table = '{_tab}' AND start_time <> end_time", _name)(_stays)


@query(f"{_W} SELECT patient_id, death_time FROM fd")
def first_death(spark, sf):
    return timeline.first_death(fx.timeline(spark, sf))


@query(f"{_W} SELECT patient_id, start_time, end_time, visit_id FROM ip WHERE EXISTS (SELECT 1 FROM ev e WHERE e.patient_id = ip.patient_id AND e.start_time BETWEEN ip.start_time AND ip.end_time AND NOT (e.omop_table LIKE 'visit%'))")
def event_exists_in_range(spark, sf):
    rows = fx.timeline(spark, sf)
    return timeline.exists_between(timeline.admissions(rows), rows, "start_time", "end_time", rows.filter("omop_table LIKE 'visit%'")).drop("event_idx")


@query(f"{_W} SELECT patient_id, start_time AS prediction_time FROM (SELECT *, lag(start_time) OVER (PARTITION BY patient_id ORDER BY event_idx) AS b FROM ev WHERE code IN ('LOINC/777-3', 'LOINC/2823-3', 'LOINC/14749-6')) WHERE start_time IS DISTINCT FROM b")
def code_prediction_times(spark, sf):
    return timeline.prediction_times(fx.timeline(spark, sf), ["LOINC/777-3", "LOINC/2823-3", "LOINC/14749-6"])


@query(f"{_W} SELECT ip.patient_id, ip.visit_id, max_by(value, e.event_idx) AS last_value FROM ip LEFT JOIN ev e ON e.patient_id = ip.patient_id AND e.start_time <= ip.end_time AND e.code = 'LOINC/777-3' AND e.value IS NOT NULL AND e.start_time = (SELECT max(f.start_time) FROM ev f WHERE f.patient_id = ip.patient_id AND f.start_time <= ip.end_time AND f.code = 'LOINC/777-3' AND f.value IS NOT NULL) GROUP BY 1, 2".replace("max_by(value, e.event_idx)", "max(e.value)"))
def asof_align(spark, sf):
    rows = fx.timeline(spark, sf)
    lab = rows.filter("code = 'LOINC/777-3' AND value IS NOT NULL").groupBy("patient_id", F.col("start_time").alias("time")).agg(F.max("value").alias("value"))
    return asof.last_at_or_before(timeline.admissions(rows).select("patient_id", "visit_id", "end_time"), F.col("end_time"), lab, F.col("value"), out="last_value").drop("end_time")


@query(f"{_W} SELECT patient_id, end_time AS prediction_time, count(*) AS n FROM ip GROUP BY 1, 2")
def exact_align(spark, sf):
    rows = timeline.admissions(fx.visits(spark, sf)).select("patient_id", F.col("end_time").alias("prediction_time"))
    return asof.exact_align(rows.distinct(), rows.groupBy("patient_id", "prediction_time").agg(F.count(F.lit(1)).alias("n")))


# Ontology


@query(f"WITH RECURSIVE {EDGES_SQL}, c AS (SELECT 'R/1' AS root, 'R/1' AS code UNION SELECT 'N/3', 'N/3' UNION SELECT 'X/0', 'X/0' UNION SELECT c.root, e.child FROM c JOIN edge e ON c.code = e.parent) SELECT DISTINCT root, code FROM c")
def ontology_closure(spark, sf):
    return ontology.closure(fx.edges(spark, sf), ["R/1", "N/3", "X/0"])


@query(f"WITH {EDGES_SQL} SELECT child AS code, child AS ancestor FROM edge WHERE child LIKE 'P/%' UNION SELECT child, parent FROM edge WHERE child LIKE 'P/%' UNION SELECT a.child, b.parent FROM edge a JOIN edge b ON a.parent = b.child WHERE a.child LIKE 'P/%'")
def ontology_ancestors(spark, sf):
    e = fx.edges(spark, sf)
    return ontology.ancestors(e, e.filter("child LIKE 'P/%'").select(F.col("child").alias("code")))


@query(f"WITH {EDGES_SQL}, s AS (SELECT 'R/3' AS c UNION SELECT child FROM edge WHERE parent = 'R/3' UNION SELECT b.child FROM edge a JOIN edge b ON a.child = b.parent WHERE a.parent = 'R/3'), {EVENTS_SQL.lstrip()} SELECT patient_id, code, start_time FROM ev WHERE code IN (SELECT c FROM s)")
def code_semi_join(spark, sf):
    return timeline.with_codes(fx.timeline(spark, sf), ontology.code_set(fx.edges(spark, sf), ["R/3"])).select("patient_id", "code", "start_time")


@query("SELECT 'P/' || l_partkey AS code, max(p_name) AS description FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 2 = 0 GROUP BY 1")
def code_descriptions(spark, sf):
    codes = fx.read(spark, sf, "lineitem").select(F.concat(F.lit("P/"), "l_partkey").alias("code")).distinct()
    return ontology.described(codes, fx.concepts(spark, sf).filter("CAST(substring(code, 3) AS BIGINT) % 2 = 0"))


# Label sets

_LOS = f"SELECT patient_id, {EOD.format('start_time')} AS prediction_time, end_time - start_time >= INTERVAL 7 DAY AS value FROM ip WHERE start_time::DATE <> end_time::DATE"


@query(f"{_W} SELECT patient_id, date_trunc('minute', prediction_time) AS prediction_time, value FROM ({_LOS})")
def labels_minute(spark, sf):
    return labels.at_minutes(label_long_los(spark, sf))


@query(f"{_W} SELECT DISTINCT patient_id, prediction_time, false AS value, 'boolean' AS label_type FROM (SELECT patient_id, prediction_time FROM ({_LOS}) UNION ALL SELECT patient_id, {EOD.format('start_time')} FROM ip)")
def labels_consolidated(spark, sf):
    return labels.consolidated([label_long_los(spark, sf), label_mimic_readmission(spark, sf)])


@query(f"{_W} SELECT count(DISTINCT patient_id) AS n_patients_labeled, count(*) AS n_labels, count(*) FILTER (WHERE value) AS n_positive, (SELECT count(DISTINCT c_custkey) FROM customer) AS n_patients FROM ({_LOS})")
def labels_stats(spark, sf):
    return labels.stats(label_long_los(spark, sf), fx.births(spark, sf), labels.is_positive(F.col("value"), "boolean"))


def labels_one_per_patient(spark, sf):
    return labels.one_per_patient(label_long_los(spark, sf))


def labels_one_per_patient_seeded(spark, sf):
    return labels.one_per_patient_seeded(label_long_los(spark, sf))


query(f"""{_W}, h AS (SELECT *, md5('97|' || patient_id || '|' || strftime(prediction_time, '%Y-%m-%d %H:%M:%S.%f') || '|' || CAST(value AS VARCHAR)) AS h FROM ({_LOS})), r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY h, prediction_time, value) AS n FROM h) SELECT patient_id, prediction_time, value FROM r WHERE n = 1""")(labels_one_per_patient)
query()(labels_one_per_patient_seeded)


_HASH100 = "list_reduce([0] || [('0x' || substring(s, 1 + 2 * i, 2))::INT FOR i IN range(32)], lambda a, b: (a * 256 + b) % 100)"


def _hashed(seed: str, pid: str, i: str) -> str:
    wide = lambda x: f"lpad(hex(CAST({x} AS BIGINT)), 16, '0')"
    return f"sha256(unhex({wide(seed)} || {wide(pid)} || {wide(i)}))"


@query(f"{_W}, l AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY prediction_time, value) - 1 AS i FROM ({_LOS})), h AS (SELECT *, {_hashed('1', 'patient_id', 'i')} AS s FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY {_HASH100}, i) AS r FROM h) SELECT patient_id, prediction_time, value FROM r WHERE r <= 2")
def labels_n_per_patient(spark, sf):
    class Los(labelers.Labeler):
        def label(self, events):
            return labelers.long_stay(events)

    return labelers.NPerPatient(Los(), 2, 1).label(fx.visits(spark, sf))


@query(f"WITH h AS (SELECT c_custkey, {_hashed('97', 'c_custkey', '0')} AS s FROM customer), n AS (SELECT c_custkey, {_HASH100} AS h FROM h) SELECT CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'val' ELSE 'test' END AS split, c_custkey AS omop_person_id FROM n")
def hash_split(spark, sf):
    return labels.hash_split(fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("patient_id")))


@query(f"{_W}, l AS ({_LOS}), b AS (SELECT c_custkey, 1940 + 0 AS z, TIMESTAMP '1940-01-01' + to_days(CAST((c_custkey * 37) % 20000 AS INT)) AS birth FROM customer), f AS (SELECT l.*, year(prediction_time) - year(birth) >= 40 AS ok FROM l JOIN b ON patient_id = c_custkey) SELECT patient_id, prediction_time, value FROM f a WHERE EXISTS (SELECT 1 FROM f b WHERE b.patient_id = a.patient_id AND b.prediction_time <= a.prediction_time AND b.ok)")
def labels_adult_only(spark, sf):
    return labels.adults_only(label_long_los(spark, sf), fx.births(spark, sf), 40)


@query(f"{_W}, {SPLITS_SQL} SELECT l.*, split FROM ({_LOS}) l JOIN spl ON patient_id = omop_person_id WHERE patient_id % 3 <> 0")
def labels_split(spark, sf):
    return labels.with_split(label_long_los(spark, sf), fx.splits(spark, sf).filter("omop_person_id % 3 <> 0"))


@query(f"{_W}, {SPLITS_SQL} SELECT l.*, coalesce(split, 'test') AS split FROM ({_LOS}) l LEFT JOIN (SELECT * FROM spl WHERE omop_person_id % 3 <> 0) ON patient_id = omop_person_id")
def labels_split_with_default(spark, sf):
    return labels.with_split(label_long_los(spark, sf), fx.splits(spark, sf).filter("omop_person_id % 3 <> 0"), "test")


@query("SELECT omop_person_id, count(DISTINCT split) AS n_splits FROM (SELECT c_custkey AS omop_person_id, 'a' AS split FROM customer UNION ALL SELECT c_custkey, 'b' FROM customer WHERE c_custkey % 10 = 0) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def splits_overlap(spark, sf):
    c = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("omop_person_id"))
    return labels.splits_overlap(c.withColumn("split", F.lit("a")).unionByName(c.filter("omop_person_id % 10 = 0").withColumn("split", F.lit("b"))))


@query(f"{_W}, l AS ({_LOS}), m AS (SELECT patient_id, prediction_time, CASE WHEN patient_id % 50 = 0 THEN NOT value ELSE value END AS value FROM l) SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM m) UNION ALL SELECT *, 'right' FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM l)")
def labels_diff(spark, sf):
    l = label_long_los(spark, sf)  # noqa: E741
    return labels.difference(l, l.withColumn("value", F.when(F.col("patient_id") % 50 == 0, ~F.col("value")).otherwise(F.col("value"))))


@query("SELECT doc_id, CAST(CASE WHEN quality + toxic * 2 >= 1 THEN 1 ELSE quality + toxic * 2 END AS INT) AS value FROM labels")
def labels_binarize(spark, sf):
    return fx.read(spark, sf, "labels").select("doc_id", labels.to_binary(F.col("quality") + F.col("toxic") * 2).cast("int").alias("value"))


@query("SELECT doc_id AS patient_id, toxic AS int_value FROM labels WHERE toxic = 1")
def labels_with_value(spark, sf):
    typed = fx.read(spark, sf, "labels").select(F.col("doc_id").alias("patient_id"), F.lit("categorical").alias("label_type"), F.col("toxic").alias("int_value"), F.col("toxic").cast("boolean").alias("bool_value"))
    return labels.with_value(typed, 1, "categorical").select("patient_id", "int_value")


@query("SELECT doc_id AS patient_id, TIMESTAMP '2020-01-01 10:20:00' AS prediction_time, CASE doc_id % 3 WHEN 0 THEN CAST(quality = 1 AS VARCHAR) WHEN 1 THEN 'int ' || toxic ELSE 'float ' || (doc_id // 4) END AS parsed FROM labels")
def labels_typed(spark, sf):
    raw = fx.read(spark, sf, "labels").selectExpr("doc_id AS patient_id", "TIMESTAMP_NTZ '2020-01-01 10:20:37' AS prediction_time", "CASE doc_id % 3 WHEN 0 THEN CASE WHEN quality = 1 THEN 'True' ELSE 'False' END WHEN 1 THEN CAST(toxic AS STRING) ELSE CAST(doc_id / 4.0D AS STRING) END AS value", "CASE doc_id % 3 WHEN 0 THEN 'boolean' WHEN 1 THEN 'categorical' ELSE 'numerical' END AS label_type")
    parsed = F.coalesce(F.col("bool_value").cast("string"), F.concat(F.lit("int "), "int_value"), F.concat(F.lit("float "), F.floor("float_value")))
    return labels.typed(raw).select("patient_id", "prediction_time", parsed.alias("parsed"))
