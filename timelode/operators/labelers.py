"""Labelers: from a timeline to (patient_id, prediction_time, value) rows, as DataFrame plans.

A labeler is a small object with hooks that return DataFrames; subclasses override the hooks. Every plan
shuffles on patient_id alone.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.functions.hashing import random_num
from timelode.functions.times import end_of_day, hours_between, shifted
from timelode.operators import timeline
from timelode.operators.asof import next_at_or_after

OUT = ["patient_id", "prediction_time", "value"]


class Labeler:
    """Base: label(events) gives the labels of all patients."""

    label_type = "boolean"

    def label(self, events: DataFrame) -> DataFrame:
        raise NotImplementedError


class HorizonLabeler(Labeler):
    """True if an outcome falls within [t + start, t + end] of a prediction time t; end None is without end.

    Without an outcome: False, unless the timeline ends before t + end; then there is no label, or False if
    censoring is off. A first outcome at exactly t drops the prediction where same-time labels aren't allowed.
    """

    start, end = timedelta(0), None
    allow_same_time, apply_censoring = True, True

    def __init__(self, start: timedelta | None = None, end: timedelta | None = None, allow_same_time: bool | None = None, apply_censoring: bool | None = None, predictions: Callable[[DataFrame], DataFrame] | None = None, outcomes: Callable[[DataFrame], DataFrame] | None = None) -> None:
        if start is not None:
            self.start, self.end = start, end
        self.allow_same_time = self.allow_same_time if allow_same_time is None else allow_same_time
        self.apply_censoring = self.apply_censoring if apply_censoring is None else apply_censoring
        self._predictions, self._outcomes = predictions, outcomes

    def predictions(self, events: DataFrame) -> DataFrame:
        """(patient_id, prediction_time), distinct per patient."""
        return self._predictions(events)

    def outcomes(self, events: DataFrame) -> DataFrame:
        """(patient_id, time)."""
        return self._outcomes(events)

    def label(self, events: DataFrame) -> DataFrame:
        asked = self.predictions(events).select("patient_id", "prediction_time").distinct()
        t = F.col("prediction_time")
        found = next_at_or_after(asked, shifted(t, self.start), self.outcomes(events).select("patient_id", "time"))
        if not self.allow_same_time:
            found = found.filter(~F.coalesce(F.col("next_time") == t, F.lit(False)))
        if self.end is None:
            return found.select("patient_id", "prediction_time", F.col("next_time").isNotNull().alias("value"))
        found = found.withColumn("value", F.coalesce(F.col("next_time") <= shifted(t, self.end), F.lit(False)))
        if self.apply_censoring:
            known = timeline.bounds(events).select("patient_id", "last_time")
            found = found.join(known, "patient_id").filter(F.col("value") | (F.col("last_time") >= shifted(t, self.end)))
        return found.select(*OUT)


class WithinVisitLabeler(Labeler):
    """For each visit, at its adjusted start: whether an outcome falls between its adjusted bounds."""

    def __init__(self, visits: Callable[[DataFrame], DataFrame] | None = None, outcomes: Callable[[DataFrame], DataFrame] | None = None, adjust_start: Callable[[Column], Column] = lambda t: t, adjust_end: Callable[[Column], Column] = lambda t: t) -> None:
        self._visits, self._outcomes, self.adjust_start, self.adjust_end = visits, outcomes, adjust_start, adjust_end

    def visits(self, events: DataFrame) -> DataFrame:
        return self._visits(events)

    def outcomes(self, events: DataFrame) -> DataFrame:
        return self._outcomes(events)

    def label(self, events: DataFrame) -> DataFrame:
        rows = self.visits(events).select("patient_id", self.adjust_start(F.col("start_time")).alias("prediction_time"), self.adjust_end(F.col("end_time")).alias("_end"))
        wrong = F.col("prediction_time").isNull() | F.col("_end").isNull() | (F.col("prediction_time") > F.col("_end"))
        rows = rows.filter(F.when(wrong, F.raise_error(F.lit("an adjusted visit ends before it starts")).cast("boolean")).otherwise(True))
        found = next_at_or_after(rows, F.col("prediction_time"), self.outcomes(events).select("patient_id", "time"))
        return found.select("patient_id", "prediction_time", F.coalesce(F.col("next_time") <= F.col("_end"), F.lit(False)).alias("value"))


class CodeLabeler(HorizonLabeler):
    """Predictions at events with some codes (or all), outcomes at events with others; no same-time labels."""

    allow_same_time = False

    def __init__(self, outcome_codes, start: timedelta, end: timedelta | None, prediction_codes=None, adjust: Callable[[Column], Column] = lambda t: t, **kw) -> None:
        super().__init__(start, end, **kw)
        self.outcome_codes, self.prediction_codes, self.adjust = outcome_codes, prediction_codes, adjust

    def predictions(self, events: DataFrame) -> DataFrame:
        found = timeline.prediction_times(events, self.prediction_codes)
        return found.select("patient_id", self.adjust(F.col("prediction_time")).alias("prediction_time"))

    def outcomes(self, events: DataFrame) -> DataFrame:
        return timeline.with_codes(events, self.outcome_codes).select("patient_id", F.col("start_time").alias("time"))


class ConceptLabeler(CodeLabeler):
    """A code labeler whose outcomes are concepts with all their descendants."""

    def __init__(self, edges: DataFrame, roots: list[str], *args, **kw) -> None:
        from timelode.operators.ontology import code_set

        super().__init__(code_set(edges, roots), *args, **kw)


class FirstDiagnosisLabeler(HorizonLabeler):
    """At each discharge's end of day up to the first diagnosis: a diagnosis within 1 to 365 days. Censored counts as False."""

    start, end = timedelta(days=1), timedelta(days=365)
    allow_same_time, apply_censoring = False, False

    def __init__(self, codes: DataFrame | list[str]) -> None:
        super().__init__()
        self.codes, self._found = codes, None

    def outcomes(self, events: DataFrame) -> DataFrame:
        # Asked for twice, looked up once.
        if self._found is None or self._found[0] is not events:
            self._found = events, timeline.with_codes(events, self.codes).select("patient_id", F.col("start_time").alias("time"))
        return self._found[1]

    def predictions(self, events: DataFrame) -> DataFrame:
        leaves = timeline.admissions(events).select("patient_id", end_of_day(F.col("end_time")).alias("prediction_time")).distinct()
        first = self.outcomes(events).groupBy("patient_id").agg(F.min("time").alias("_first"))
        return leaves.join(first, "patient_id", "left").filter(F.col("_first").isNull() | (F.col("prediction_time") <= F.col("_first"))).select("patient_id", "prediction_time")


class NPerPatient(Labeler):
    """At most n labels of each patient, those of least seeded hash of their place."""

    def __init__(self, labeler: Labeler, n: int, seed: int = 1) -> None:
        self.labeler, self.n, self.seed, self.label_type = labeler, n, seed, labeler.label_type

    def label(self, events: DataFrame) -> DataFrame:
        place = Window.partitionBy("patient_id").orderBy("prediction_time", "value")
        rows = self.labeler.label(events).withColumn("_i", F.row_number().over(place) - 1)
        rows = rows.withColumn("_h", random_num(self.seed, F.col("patient_id"), F.col("_i")))
        rank = F.row_number().over(Window.partitionBy("patient_id").orderBy("_h", "_i"))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= self.n).select(*OUT)


class PandasLabeler(Labeler):
    """Escape hatch: a function from one patient's events, as a pandas frame, to labels. For what columns can't say."""

    def __init__(self, function, value_type: str = "boolean", label_type: str = "boolean") -> None:
        self.function, self.value_type, self.label_type = function, value_type, label_type

    def label(self, events: DataFrame) -> DataFrame:
        return events.groupBy("patient_id").applyInPandas(self.function, f"patient_id long, prediction_time timestamp_ntz, value {self.value_type}")


# Operational outcomes


def long_stay(events: DataFrame, days: int = 7) -> DataFrame:
    """At the end of each admission's first day: whether the stay lasts so many days; same-day stays have no label."""
    visits = timeline.admissions(events).filter(F.col("start_time").cast("date") != F.col("end_time").cast("date"))
    return visits.select("patient_id", end_of_day(F.col("start_time")).alias("prediction_time"), (F.col("end_time") - F.col("start_time") >= F.lit(timedelta(days=days))).alias("value"))


class ReadmissionLabeler(HorizonLabeler):
    """At each discharge, adjusted: whether a new admission follows within the horizon.

    A same-day stay is passed over if an earlier admission started on that day.
    """

    start, end = timedelta(minutes=1), timedelta(days=30)

    def __init__(self, end: timedelta | None = None, adjust: Callable[[Column], Column] = end_of_day, codes=None) -> None:
        super().__init__()
        self.end, self.adjust, self.codes = end or self.end, adjust, codes

    def predictions(self, events: DataFrame) -> DataFrame:
        order = Window.partitionBy("patient_id", F.col("start_time").cast("date")).orderBy("start_time", "event_idx")
        visits = timeline.admissions(events, self.codes).withColumn("_nth", F.row_number().over(order))
        kept = visits.filter((F.col("start_time").cast("date") != F.col("end_time").cast("date")) | (F.col("_nth") == 1))
        return kept.select("patient_id", self.adjust(F.col("end_time")).alias("prediction_time"))

    def outcomes(self, events: DataFrame) -> DataFrame:
        return timeline.admissions(events, self.codes).select("patient_id", F.col("start_time").alias("time"))


def icu_transfer(events: DataFrame) -> DataFrame:
    """At the end of an admission's first day: whether a transfer to intensive care follows before discharge.

    Same-day stays, and admissions on a day with a transfer, have no label.
    """
    moves = timeline.icu_stays(events).select("patient_id", F.col("start_time").alias("time"))

    def visits(e: DataFrame) -> DataFrame:
        longer = timeline.admissions(e).filter(F.col("start_time").cast("date") != F.col("end_time").cast("date"))
        first = next_at_or_after(longer, F.date_trunc("day", "start_time").cast("timestamp_ntz"), moves, out="_move")
        return first.filter(~F.coalesce(F.col("_move").cast("date") == F.col("start_time").cast("date"), F.lit(False)))

    return WithinVisitLabeler(visits, lambda _: moves, end_of_day).label(events)


def admission_and_discharge(events: DataFrame, adjust: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """True at both ends of every admission."""
    both = timeline.admissions(events).select("patient_id", F.explode(F.array("start_time", "end_time")).alias("t"))
    return both.select("patient_id", adjust(F.col("t")).alias("prediction_time"), F.lit(True).alias("value"))


def long_admission(events: DataFrame, long_time: timedelta = timedelta(days=7), adjust: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """At each admission's adjusted start: whether it lasts long_time; none after its end or the first death."""
    rows = timeline.admissions(events).join(timeline.first_death(events), "patient_id", "left").withColumn("prediction_time", adjust(F.col("start_time")))
    rows = rows.filter((F.col("prediction_time") <= F.col("end_time")) & (F.col("death_time").isNull() | (F.col("prediction_time") <= F.col("death_time"))))
    return rows.select("patient_id", "prediction_time", (F.col("end_time") - F.col("start_time") >= F.lit(long_time)).alias("value"))


def inpatient_mortality(events: DataFrame) -> DataFrame:
    """At the end of an admission's first day: whether the first death falls before discharge; none once that day reaches the discharge or the death precedes it."""
    rows = timeline.admissions(events).join(timeline.first_death(events), "patient_id", "left").withColumn("prediction_time", end_of_day(F.col("start_time")))
    rows = rows.filter((F.col("prediction_time") < F.col("end_time")) & (F.col("death_time").isNull() | (F.col("prediction_time") <= F.col("death_time"))))
    return rows.select("patient_id", "prediction_time", F.coalesce(F.col("death_time").between(F.col("prediction_time"), F.col("end_time")), F.lit(False)).alias("value"))


def mimic_readmission(events: DataFrame, codes=None, days: int = 30) -> DataFrame:
    """At the end of each admission's first day: whether another admission starts after it, within so many days."""
    visits = timeline.admissions(events, codes)
    rows = visits.select("patient_id", end_of_day(F.col("start_time")).alias("prediction_time"))
    t = F.col("prediction_time")
    found = next_at_or_after(rows, t + F.lit(timedelta(microseconds=1)), visits.select("patient_id", F.col("start_time").alias("time")))
    return found.select("patient_id", "prediction_time", F.coalesce(F.col("next_time") <= t + F.lit(timedelta(days=days)), F.lit(False)).alias("value"))


def mimic_mortality(events: DataFrame, codes=None, death_codes=None) -> DataFrame:
    """At each admission's start: whether a death falls within it."""
    dead = timeline.deaths(events, [timeline.DEATH_MIMIC] if death_codes is None else death_codes)
    return WithinVisitLabeler(lambda e: timeline.admissions(e, codes), lambda _: dead.select("patient_id", F.col("start_time").alias("time"))).label(events)


# Intensive care


def _with_care(events: DataFrame, hours: int, within: int | None) -> DataFrame:
    """Intensive-care stays of so many hours with some other event in them, or in their first `within` hours."""
    found = timeline.icu_stays(events)
    found = found.filter(F.col("end_time") - F.col("start_time") >= F.lit(timedelta(hours=hours)))
    last = F.col("end_time") if within is None else F.col("start_time") + F.lit(timedelta(hours=within))
    return timeline.exists_between(found.withColumn("_last", last), events, "start_time", "_last", timeline.is_stay(timeline.ICU_SITES, "visit_detail"))


def hourly_grid(events: DataFrame, first: int = 4) -> DataFrame:
    """(patient_id, prediction_time, over): each hour from `first` hours into an intensive-care stay until it is over, by its end or the first death."""
    rows = _with_care(events, first, None).join(timeline.first_death(events), "patient_id", "left")
    rows = rows.select("patient_id", (F.col("start_time") + F.lit(timedelta(hours=first))).alias("_from"), F.least("end_time", F.coalesce("death_time", "end_time")).alias("over"))
    step = F.sequence("_from", F.col("over") - F.lit(timedelta(microseconds=1)), F.lit(timedelta(hours=1)))
    return rows.filter(F.col("over") > F.col("_from")).select("patient_id", F.explode(step).alias("prediction_time"), "over")


class DecompensationLabeler(HorizonLabeler):
    """Each hour in intensive care: death within 24 hours. Times that overlapping stays share count once."""

    start, end = timedelta(0), timedelta(hours=24)
    allow_same_time, apply_censoring = False, False

    def __init__(self) -> None:
        super().__init__()

    def predictions(self, events: DataFrame) -> DataFrame:
        return hourly_grid(events)

    def outcomes(self, events: DataFrame) -> DataFrame:
        return timeline.deaths(events).select("patient_id", F.col("start_time").alias("time"))


def icu_mortality(events: DataFrame, hours: int = 48) -> DataFrame:
    """So many hours into an intensive-care stay: whether a death falls before its end."""
    dead = timeline.deaths(events).select("patient_id", F.col("start_time").alias("time"))
    return WithinVisitLabeler(lambda e: _with_care(e, hours, hours), lambda _: dead, lambda t: t + F.lit(timedelta(hours=hours))).label(events)


def remaining_stay(events: DataFrame) -> DataFrame:
    """Each hour in intensive care: hours until it is over."""
    return hourly_grid(events).select("patient_id", "prediction_time", hours_between(F.col("prediction_time"), F.col("over")).alias("value"))


# Laboratory values

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number_of(text: Column) -> Column:
    """The number that a text spells in plain decimal or exponent form, else null."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def _scaled(v: Column, unit: Column, factors: dict[str, tuple[float, float]] | None) -> Column:
    """v times and divided by the two factors of the first unit that a unit text begins with; null for other units."""
    if factors is None:
        return v
    out = F.lit(None).cast("double")
    for prefix, (times, by) in reversed(factors.items()):
        out = F.when(F.lower(unit).startswith(prefix), v * times / by).otherwise(out)
    return out


#: Words for a value in range.
WORDS = {"normal": 0, "adequate": 0}


class LabLabeler(Labeler):
    """Severity 0 to 3 of each laboratory value, a minute before it; none at the patient's first time, or for values that don't parse.

    steps are (bound, inclusive) for severe, moderate and mild; below tells the side of the bound that counts.
    """

    label_type = "categorical"

    def __init__(self, codes, steps: list[tuple[float, bool]], below: bool = True, units: dict[str, tuple[float, float]] | None = None, words: dict[str, int] | None = None) -> None:
        self.codes, self.steps, self.below, self.units, self.words = codes, steps, below, units, WORDS if words is None else words

    def severity(self, value: Column, unit: Column) -> Column:
        v = _scaled(number_of(value), unit, self.units)
        out = F.when(v.isNotNull(), 0)
        for level, (bound, inclusive) in zip((1, 2, 3), reversed(self.steps), strict=True):
            hit = (v <= bound if inclusive else v < bound) if self.below else (v >= bound if inclusive else v > bound)
            out = F.when(hit, level).otherwise(out)
        for word, level in self.words.items():
            out = F.when(F.lower(value) == word, level).otherwise(out)
        return out

    def label(self, events: DataFrame) -> DataFrame:
        rows = timeline.with_codes(events, self.codes).filter(F.col("value").isNotNull()).join(timeline.bounds(events), "patient_id").filter(F.col("start_time") != F.col("first_time"))
        level = self.severity(F.col("value"), F.col("unit"))
        return rows.select("patient_id", (F.col("start_time") - F.lit(timedelta(minutes=1))).alias("prediction_time"), level.cast("int").alias("value")).filter("value IS NOT NULL")


#: Root concepts, severity bounds (severe, moderate, mild; whether the bound counts) and unit factors (times, by) of the laboratory tasks.
LABS = {
    "lab_thrombocytopenia": (["LOINC/LP393218-5", "LOINC/LG32892-8", "LOINC/777-3"], {"steps": [(50, False), (100, False), (150, False)]}),
    "lab_hyperkalemia": (["LOINC/LG7931-1", "LOINC/LP386618-5", "LOINC/LG10990-6", "LOINC/6298-4", "LOINC/2823-3"], {"steps": [(7, False), (6.0, False), (5.5, False)], "below": False, "units": {"mmol/l": (1, 1), "meq/l": (1, 1), "mg/dl": (1, 18)}}),
    "lab_hypoglycemia": (["SNOMED/33747003", "LOINC/LP416145-3", "LOINC/14749-6"], {"steps": [(3, False), (3.5, False), (3.9, True)], "units": {"mg/dl": (1, 18), "mmol/l": (1, 1)}}),
    "lab_hyponatremia": (["LOINC/LG11363-5", "LOINC/2951-2", "LOINC/2947-0"], {"steps": [(125, False), (130, False), (135, True)]}),
    "lab_anemia": (["LOINC/LP392452-1"], {"steps": [(70, False), (110, False), (120, False)], "units": {"g/dl": (10, 1), "mg/dl": (1, 100), "g/l": (1, 1)}}),
}
#: Root concepts of the first-diagnosis tasks.
DIAGNOSES = {
    "new_pancan": "SNOMED/372003004",
    "new_celiac": "SNOMED/396331005",
    "new_lupus": "SNOMED/55464009",
    "new_acutemi": "SNOMED/57054005",
    "new_cteph": "SNOMED/233947005",
    "new_hypertension": "SNOMED/59621000",
    "new_hyperlipidemia": "SNOMED/55822004",
}


def lab(task: str, edges: DataFrame | None = None) -> LabLabeler:
    """The labeler of a laboratory task; with edges its roots stand for their descendants too."""
    from timelode.operators.ontology import code_set

    roots, rule = LABS[task]
    return LabLabeler(roots if edges is None else code_set(edges, roots), **rule)


def diagnosis(task: str, edges: DataFrame) -> FirstDiagnosisLabeler:
    from timelode.operators.ontology import code_set

    return FirstDiagnosisLabeler(code_set(edges, [DIAGNOSES[task]]))


# Imaging


def chest_findings(reports: DataFrame, events: DataFrame, findings: list[str]) -> DataFrame:
    """A day before each report, if later than the patient's first event: its findings as one number, first finding in the highest bit."""
    bits = F.concat(*(F.coalesce((F.col(f"`{c}`") == 1).cast("int"), F.lit(0)).cast("string") for c in findings))
    rows = reports.select("patient_id", (F.col("start_time") - F.lit(timedelta(hours=24))).alias("prediction_time"), F.conv(bits, 2, 10).cast("int").alias("value"))
    return rows.join(timeline.bounds(events), "patient_id").filter(F.col("prediction_time") > F.col("first_time")).select(*OUT)
