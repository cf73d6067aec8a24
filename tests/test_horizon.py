"""Horizon, visit and order kernels against literal timelines and independent loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timelode.operators import asof, labelers, timeline

T0 = datetime(2024, 1, 1)
EVENTS = "patient_id long, event_idx int, start_time timestamp_ntz, end_time timestamp_ntz, code string, value string, unit string, omop_table string, visit_id long"


def at(h):
    return T0 + timedelta(hours=h)


def events(spark, rows):
    """rows: (patient, start hour, end hour or None, code, value, unit, omop_table)."""
    full = [(p, s, e, c, v, u, o) for p, s, e, c, v, u, o in rows]
    seen, out = {}, []
    for p, s, e, c, v, u, o in sorted(full, key=lambda r: (r[0], r[1])):
        i = seen[p] = seen.get(p, -1) + 1
        out.append((p, i, at(s), None if e is None else at(e), c, v, u, o, None))
    return spark.createDataFrame(out, EVENTS)


def horizon(spark, patients, start, end, **kw):
    """patients: {id: (prediction hours, outcome hours, last event hour)}."""
    rows = [(p, h, None, c, None, None, None) for p, (ts, os, last) in patients.items() for c, hs in (("p", ts), ("o", os), ("x", [last])) for h in hs]
    pick = lambda c, n: lambda e: e.filter(F.col("code") == c).select("patient_id", F.col("start_time").alias(n))
    lab = labelers.HorizonLabeler(timedelta(hours=start), None if end is None else timedelta(hours=end), predictions=pick("p", "prediction_time"), outcomes=pick("o", "time"), **kw)
    return {(r.patient_id, (r.prediction_time - T0).total_seconds() / 3600): r.value for r in lab.label(events(spark, rows)).collect()}


def test_truth_table(spark):
    got = horizon(spark, {1: ([0], [3], 9), 2: ([0], [3, 9], 9), 3: ([0], [1], 9), 4: ([0], [8], 9), 5: ([0], [], 4)}, 2, 5)
    assert got == {(1, 0): True, (2, 0): True, (3, 0): False, (4, 0): False}
    assert horizon(spark, {5: ([0], [], 4)}, 2, 5, apply_censoring=False) == {(5, 0): False}


def test_same_time_and_infinite(spark):
    assert horizon(spark, {6: ([0], [0], 9)}, 0, 5, allow_same_time=False) == {}
    assert horizon(spark, {6: ([0], [0], 9)}, 0, 5) == {(6, 0): True}
    assert horizon(spark, {7: ([0], [], 0)}, 1, None) == {(7, 0): False}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_horizon_against_loop(spark, seed):
    rng = random.Random(seed)
    patients = {p: (sorted(rng.sample(range(60), rng.randint(0, 6))), sorted(rng.choices(range(60), k=rng.randint(0, 5))), rng.randint(0, 70)) for p in range(60)}
    start, end = rng.randint(-3, 3), rng.choice([None, 4, 10])
    same, censor = rng.random() < 0.5, rng.random() < 0.5
    want = {}
    for p, (ts, os, last) in patients.items():
        last = max([last, *ts, *os])
        for t in ts:
            ahead = [o for o in os if o >= t + start]
            if ahead and ahead[0] == t and not same:
                continue
            hit = bool(ahead) and (end is None or ahead[0] <= t + end)
            if hit or not (end is not None and last < t + end and censor):
                want[p, t] = hit
    assert horizon(spark, patients, start, end, allow_same_time=same, apply_censoring=censor) == want


def test_long_stay_and_bad_visits(spark):
    ip = lambda p, s, e: (p, s, e, "Visit/IP", None, None, "visit_occurrence")
    got = labelers.long_stay(events(spark, [ip(1, 10, 20), ip(2, 10, 10 + 168), ip(3, 10, 9 + 168), ip(4, 10, 10)])).collect()
    assert {(r.patient_id, r.value) for r in got} == {(2, True), (3, False)}
    assert {r.prediction_time for r in got} == {datetime(2024, 1, 1, 23, 59, 59)}
    for s, e in ((5, 4), (5, None)):
        with pytest.raises(Exception, match="bounds"):
            timeline.admissions(events(spark, [ip(1, s, e)])).collect()


def test_readmission_cases(spark):
    ip = lambda p, s, e: (p, s, e, "Visit/IP", None, None, "visit_occurrence")
    late = lambda p: (p, 24 * 150, None, "x", None, None, None)
    rows = [ip(1, 0, 48), ip(1, 216, 264), late(1), ip(2, 8, 10), ip(2, 12, 14), late(2), ip(3, 0, 60), ip(3, 68, 96), late(3)]
    got = sorted((r.patient_id, r.prediction_time, r.value) for r in labelers.ReadmissionLabeler().label(events(spark, rows)).collect())
    eod = lambda d: datetime(2024, 1, d, 23, 59, 59)
    assert got == [(1, eod(3), True), (1, eod(12), False), (2, eod(1), False), (3, eod(3), False), (3, eod(5), False)]


def test_icu_transfer_day_rule(spark):
    rows = [(1, 5, 100, "Visit/IP", None, None, "visit_occurrence"), (1, 7, 20, timeline.ICU_SITES[0], None, None, "visit_detail"), (2, 5, 100, "Visit/IP", None, None, "visit_occurrence"), (2, 40, 50, timeline.ICU_SITES[3], None, None, "visit_detail")]
    got = labelers.icu_transfer(events(spark, rows)).collect()
    assert [(r.patient_id, r.value) for r in got] == [(2, True)]


def test_labs(spark):
    def one(task, code, value, unit, start=5):
        rows = [(1, 0, None, "x", None, None, None), (1, start, None, code, value, unit, None)]
        got = labelers.LabLabeler([code], **labelers.LABS[task][1]).label(events(spark, rows)).collect()
        return [(r.prediction_time, r.value) for r in got]

    before = at(5) - timedelta(minutes=1)
    assert one("lab_hyperkalemia", "k", "7.1", "mmol/L (See scan)") == [(before, 3)]
    assert one("lab_hyperkalemia", "k", "7.1", None) == []
    assert one("lab_hyperkalemia", "k", "7.1", "mmol/L", start=0) == []
    assert [one("lab_thrombocytopenia", "p", v, None) for v in ("Adequate", ">100", "149", "150", "1_0", "12d", "nan")] == [[(before, 0)], [], [(before, 1)], [(before, 0)], [], [], []]
    assert one("lab_anemia", "h", "11", "g/dL") == [(before, 1)] and one("lab_anemia", "h", "12", "g/dL") == [(before, 0)]


def test_asof_both_ways(spark):
    rows = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "patient_id long, at long")
    ev = spark.createDataFrame([(1, 3, "a"), (1, 5, "b"), (1, 9, "c"), (1, None, "z")], "patient_id long, time long, v string")
    assert {(r.patient_id, r["at"], r.next_time) for r in asof.next_at_or_after(rows, F.col("at"), ev).collect()} == {(1, 5, 5), (1, 1, 3), (2, 5, None)}
    assert {(r.patient_id, r["at"], r.last) for r in asof.last_at_or_before(rows, F.col("at"), ev, F.col("v")).collect()} == {(1, 5, "b"), (1, 1, None), (2, 5, None)}
    feats = spark.createDataFrame([(1, 5, 0.5)], "patient_id long, at long, f double")
    with pytest.raises(Exception, match="no feature row"):
        asof.exact_align(rows, feats, ("patient_id", "at")).collect()


def test_first_diagnosis_takes_any_later_one(spark):
    rows = [(1, 0, 30, "Visit/IP", None, None, "visit_occurrence"), (1, 60, None, "dx", None, None, None), (1, 24 * 12, None, "dx", None, None, None)]
    assert [r.value for r in labelers.FirstDiagnosisLabeler(["dx"]).label(events(spark, rows)).collect()] == [True]


def test_chest_bits(spark):
    names = [f"f{i}" for i in range(14)]
    ev = events(spark, [(1, 0, None, "x", None, None, None)])
    row = lambda hot, h: (1, at(h), *[1.0 if i == hot else None for i in range(14)])
    reports = spark.createDataFrame([row(0, 100), row(13, 101), row(3, 24)], "patient_id long, start_time timestamp_ntz, " + ", ".join(f"{n} double" for n in names))
    assert sorted(r.value for r in labelers.chest_findings(reports, ev, names).collect()) == [1, 8192]


def test_pandas_escape_hatch(spark):
    def last(pdf):
        return pdf.tail(1).assign(prediction_time=lambda d: d.start_time, value=True)[["patient_id", "prediction_time", "value"]]

    got = labelers.PandasLabeler(last).label(events(spark, [(1, 0, None, "x", None, None, None), (1, 4, None, "y", None, None, None)])).collect()
    assert [(r.patient_id, r.prediction_time) for r in got] == [(1, at(4))]
