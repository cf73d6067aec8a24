"""Labelers as Arrow table functions: a timeline read once, in order, as a stream of batches.

What columns can't say, but one walk along a timeline can, is written as a subclass of Walk. It sees a
patient's events in batches and keeps what it must remember itself, so a timeline of any length takes the memory
of a batch and of that state; applyInPandas would hold the whole patient. The functions are called from SQL,

    SELECT * FROM readmissions(TABLE(events) PARTITION BY patient_id ORDER BY event_idx)

or through labeler(), which makes a Labeler of one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf
from pyspark.sql.types import StructType

from timelode.operators.labelers import Labeler
from timelode.operators.timeline import INPATIENT

Label = tuple[datetime, object]
MINUTE, DAY = timedelta(minutes=1), timedelta(days=1)


class Walk:
    """One patient's walk. Subclasses say what they need, what type their values have, and what batch() and end() find."""

    #: Columns that the table must have, and the type of the labels' values.
    needs: tuple[str, ...] = ("patient_id", "event_idx", "start_time")
    value = "boolean"
    label_type = "boolean"

    def batch(self, events: pa.RecordBatch) -> Iterable[Label]:
        """The labels that are settled by these events, which follow those of the call before."""
        raise NotImplementedError

    def end(self) -> Iterable[Label]:
        """The labels that the end of the timeline settles."""
        return ()

    # What Spark calls.

    patient: int | None = None

    @classmethod
    def returns(cls) -> StructType:
        return StructType.fromDDL(f"patient_id long, prediction_time timestamp_ntz, value {cls.value}")

    def _table(self, labels: Iterable[Label]) -> Iterator[pa.Table]:
        rows = list(labels)
        if rows:
            kind = {"boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}[self.value]
            yield pa.table([pa.array([self.patient] * len(rows), pa.int64()), pa.array([t for t, _ in rows], pa.timestamp("us")), pa.array([v for _, v in rows], kind)], ["patient_id", "prediction_time", "value"])

    def eval(self, events: pa.RecordBatch) -> Iterator[pa.Table]:
        missing = sorted(set(self.needs) - set(events.schema.names))
        if missing:
            raise ValueError(f"{type(self).__name__} needs the columns {', '.join(missing)}")
        if events.num_rows:
            self.patient = events.column("patient_id")[0].as_py()
            yield from self._table(self.batch(events))

    def terminate(self) -> Iterator[pa.Table]:
        yield from self._table(self.end())


def function(walk: type[Walk]):
    """walk as a table function. Spark doesn't ask Arrow table functions for a schema of their own, so it follows from the class."""
    return arrow_udtf(type(walk.__name__, (walk,), {}), returnType=walk.returns())


def registered(spark: SparkSession, name: str, walk: type[Walk]) -> None:
    """Make walk callable from SQL under a name."""
    spark.udtf.register(name, function(walk))


class WalkLabeler(Labeler):
    """The labeler of a walk; only the columns it needs are read."""

    def __init__(self, walk: type[Walk]) -> None:
        self.walk, self.label_type = walk, walk.label_type

    def label(self, events: DataFrame) -> DataFrame:
        return function(self.walk)(events.select(*self.walk.needs).asTable().partitionBy("patient_id").orderBy("event_idx"))


def _end_of_day(t: datetime) -> datetime:
    return datetime(t.year, t.month, t.day, 23, 59, 59)


class Readmissions(Walk):
    """30-day readmission, as labelers.ReadmissionLabeler has it: what waits for an outcome are the discharges of the last days."""

    needs = ("patient_id", "event_idx", "start_time", "end_time", "code", "omop_table")
    horizon = timedelta(days=30)

    def __init__(self) -> None:
        self.waiting: deque[datetime] = deque()
        self.day, self.last = None, None

    def batch(self, events: pa.RecordBatch) -> Iterator[Label]:
        stays = events.filter(pc.and_(pc.equal(events.column("code"), INPATIENT), pc.equal(events.column("omop_table"), "visit_occurrence")))
        for start, end in zip(stays.column("start_time").to_pylist(), stays.column("end_time").to_pylist(), strict=True):
            if start is None or end is None or start > end:
                raise ValueError("a visit has no or reversed bounds")
            if start == end:
                continue
            yield from self.outcome(start)
            first, self.day = self.day != start.date(), start.date()
            t = _end_of_day(end)
            if (start.date() != end.date() or first) and t not in self.waiting:
                self.waiting.append(t)
        self.last = events.column("start_time")[events.num_rows - 1].as_py()

    def outcome(self, start: datetime) -> Iterator[Label]:
        """The discharges that this admission is the next one of."""
        still = deque()
        for t in self.waiting:
            if start < t + MINUTE:
                still.append(t)
            else:
                yield t, start <= t + self.horizon
        self.waiting = still

    def end(self) -> Iterator[Label]:
        yield from ((t, False) for t in self.waiting if self.last >= t + self.horizon)


class LongestGap(Walk):
    """At each admission: the longest time, in days, between two events in a row before it; what no running total of the timeline's columns can say without a second sort."""

    needs = ("patient_id", "event_idx", "start_time", "code", "omop_table")
    value, label_type = "double", "numerical"

    def __init__(self) -> None:
        self.last, self.gap = None, 0.0

    def batch(self, events: pa.RecordBatch) -> Iterator[Label]:
        times = events.column("start_time").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
        import numpy as np

        before = np.append(times[0] if self.last is None else self.last, times[:-1])
        gaps = np.maximum.accumulate(np.append(self.gap, (times - before) / 86_400e6))[1:]
        self.last, self.gap = times[-1], float(gaps[-1])
        stays = pc.and_(pc.equal(events.column("code"), INPATIENT), pc.equal(events.column("omop_table"), "visit_occurrence"))
        for i in np.flatnonzero(stays.fill_null(False).to_numpy(zero_copy_only=False)).tolist():
            yield events.column("start_time")[i].as_py(), float(gaps[i])
