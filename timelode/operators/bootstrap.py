"""Patient bootstrap by vectors of replicates: one pass over the rows, however many replicates there are.

A row doesn't meet the draws in a join. How often a patient is drawn in each replicate follows from a hash of
the two, a Poisson(1) multiplicity, so a task makes the vector of a row's weights itself. Rows go to ranges of
scores, whose bounds are quantiles of the scores themselves; equal scores share a range. A range adds vectors
of weights up score by score and gives its totals and what of the curves lies within it; running totals over
the ranges of a key then put the curves together. What is shuffled are the rows, once, and a few vectors for each
range. Where so many rows of a batch have one score that their vector of sums is shorter, it goes in their place, so a
score that a third of all rows share costs a vector for each batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelode.sources.shared import written

REPLICATES = 1000
#: Rows that a range is to hold, and the fewest and most ranges of a key.
RANGE_ROWS, FEWEST, MOST = 50_000, 16, 4096
#: Rows whose vectors a task holds at a time.
BLOCK = 2048
#: Fixed values of the multiplicative hash.
MODULUS, STEP, SPREAD, MIX = 2147483647, 48271, 69621, 16807
METRICS = ("auroc", "auprc", "brier")


def cutoffs() -> list[float]:
    """Probabilities of at most 0, 1, 2 ... draws of Poisson(1), as far as a 31-bit hash tells them apart (12 draws)."""
    out, p = [], math.exp(-1)
    for k in range(13):
        out.append(p + (out[-1] if out else 0.0))
        p /= k + 1
    return out


def multiplicities(patients: np.ndarray, replicates: int) -> np.ndarray:
    """Patients x replicates: how often each is drawn. Replicate 0 draws each once: it is the score itself."""
    a, r = (patients.astype(np.int64) % MODULUS)[:, None], np.arange(1, replicates + 1, dtype=np.int64)
    x = (a * STEP + r * SPREAD + 11) % MODULUS
    x = (x * x + r) % MODULUS
    x = (x * MIX + a) % MODULUS
    out = np.ones((len(a), replicates + 1), np.uint8)
    out[:, 1:] = np.searchsorted(cutoffs(), x / MODULUS, "right")
    return out


def _ties(pred: np.ndarray, patient: np.ndarray, y: np.ndarray, n: np.ndarray, vectors, replicates: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(score, weights of positives, of negatives) of some distinct scores at a time, in the order of the rows."""
    starts = np.append(True, pred[1:] != pred[:-1])
    held = None
    for a in range(0, len(pred), BLOCK):
        b = slice(a, a + BLOCK)
        w = multiplicities(patient[b], replicates).astype(float) * n[b, None]
        pos, neg = w * y[b, None], w * (1 - y[b, None])
        for i, (p, q) in vectors.items():
            if a <= i < a + BLOCK:
                pos[i - a], neg[i - a] = p, q
        first = np.flatnonzero(starts[b])
        if not len(first) or first[0]:
            first = np.append(0, first)
        pos, neg, score = np.add.reduceat(pos, first), np.add.reduceat(neg, first), pred[b][first]
        if held is not None:
            if held[0] == score[0]:
                pos[0] += held[1]
                neg[0] += held[2]
            else:
                score, pos, neg = np.append(held[0], score), np.vstack([held[1], pos]), np.vstack([held[2], neg])
        if len(score) > 1:
            yield score[:-1], pos[:-1], neg[:-1]
        held = score[-1], pos[-1], neg[-1]
    if held is not None:
        yield np.array([held[0]]), held[1][None], held[2][None]


def _sorted(rows: pa.Table, descending: bool):
    pred = rows["pred"].to_numpy()
    order = np.argsort(-pred if descending else pred, kind="stable")
    pos, neg = rows["pos"].combine_chunks(), rows["neg"].combine_chunks()
    folded = np.flatnonzero(pos.is_valid().to_numpy(zero_copy_only=False)[order])
    vectors = {int(i): (np.array(pos[int(order[i])].as_py()), np.array(neg[int(order[i])].as_py())) for i in folded}
    return pred[order], *(rows[c].to_numpy()[order] for c in ("patient", "y", "n")), vectors


def _row(key: tuple, names: list[str], of: DataFrame | pa.Schema, **vectors: np.ndarray) -> pa.Table:
    columns = [pa.array([k.as_py()], of.field(n).type) for k, n in zip(key, names, strict=True)]
    return pa.table([*columns, *(pa.array([v.tobytes()], pa.binary()) for v in vectors.values())], [*names, *vectors])


def intervals(preds: DataFrame, keys: list[str], replicates: int = REPLICATES, patient: Column | None = None) -> DataFrame:
    """For each key and metric of preds (keys, patient_id, pred, y): the score, and std, 2.5 and 97.5 percentiles and mean over the replicates.

    Rows with a null score, label or patient are left out; a score is null where a class is missing, and a
    replicate that lacks a class doesn't count. Patients that aren't whole numbers count by a hash.
    """
    kind = dict(preds.dtypes)["patient_id"]
    who = patient if patient is not None else F.col("patient_id").cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64("patient_id")
    rows = preds.select(*keys, who.alias("patient"), F.col("pred").cast("double").alias("pred"), F.col("y").cast("double").alias("y")).filter("pred IS NOT NULL AND y IS NOT NULL AND patient IS NOT NULL")
    few = written(rows.groupBy(*keys, "patient", "pred", "y").agg(F.count(F.lit(1)).cast("double").alias("n")), "bootstrap-rows")
    parts = min(MOST, max(FEWEST, -(-few.count() // RANGE_ROWS)))
    # A bound for each range; what is broadcast or joined is a row for each key.
    names = [f"_of_{k}" for k in keys]
    bounds = few.groupBy(*keys).agg(F.percentile_approx("pred", [i / parts for i in range(1, parts)], 10 * parts).alias("_bounds")).toDF(*names, "_bounds")
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    place = F.size(F.filter("_bounds", lambda b: b <= F.col("pred"))).alias("range")
    few = few.join(bounds, same).select(*keys, place, "patient", "pred", "y", "n")
    none = F.lit(None).cast("array<double>")
    few = few.withColumns({"pos": none, "neg": none})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = batch.select([*keys, "range", "pred"]).to_pandas()
            group = frame.groupby([*keys, "range", "pred"], dropna=False, sort=False).ngroup().to_numpy()
            size = np.bincount(group)
            heavy = np.flatnonzero(size > replicates)
            yield batch.filter(pa.array(~np.isin(group, heavy)))
            for g in heavy.tolist():
                at = np.flatnonzero(group == g)
                own = batch.take(pa.array(at))
                pos, neg = np.zeros(replicates + 1), np.zeros(replicates + 1)
                patient, y, n = (own.column(c).to_numpy() for c in ("patient", "y", "n"))
                for a in range(0, len(at), BLOCK):
                    b = slice(a, a + BLOCK)
                    w = multiplicities(patient[b], replicates)
                    pos, neg = pos + (n[b] * y[b]) @ w, neg + (n[b] * (1 - y[b])) @ w
                one = own.slice(0, 1)
                yield pa.RecordBatch.from_arrays([*one.columns[:-2], pa.array([pos.tolist()]), pa.array([neg.tolist()])], schema=batch.schema)

    ranged = few.mapInArrow(fold, few.schema)
    unit = [*keys, "range"]

    def totals(key: tuple, rows: pa.Table) -> pa.Table:
        below, pos, area, brier = (np.zeros(replicates + 1) for _ in range(4))
        for score, p, q in _ties(*_sorted(rows, False), replicates):
            before = below + np.cumsum(q, axis=0) - q
            area += (p * (before + q / 2)).sum(axis=0)
            brier += ((1 - score[:, None]) ** 2 * p + score[:, None] ** 2 * q).sum(axis=0)
            below, pos = below + q.sum(axis=0), pos + p.sum(axis=0)
        return _row(key, unit, rows.schema, pos=pos, neg=below, area=area, brier=brier)

    types = dict(few.dtypes)
    keyed = ", ".join(f"`{k}` {types[k]}" for k in keys)
    comma = ", " if keys else ""
    sums = written(ranged.groupBy(*unit).applyInArrow(totals, f"{keyed}{comma}range int, pos binary, neg binary, area binary, brier binary"), "bootstrap-totals")

    def above(key: tuple, rows: pa.Table) -> pa.Table:
        """For each range of a key: what the ranges above it hold."""
        order = np.argsort(-rows["range"].to_numpy())
        pos, neg = (np.array([np.frombuffer(rows[c][int(i)].as_py()) for i in order]) for c in ("pos", "neg"))
        out = rows.take(pa.array(order)).select(unit)
        for name, v in (("tp", np.cumsum(pos, axis=0) - pos), ("all", np.cumsum(pos + neg, axis=0) - pos - neg)):
            out = out.append_column(name, pa.array([x.tobytes() for x in v], pa.binary()))
        return out

    offsets = sums.select(*unit, "pos", "neg").groupBy(*keys).applyInArrow(above, f"{keyed}{comma}range int, tp binary, all binary")

    def precision(key: tuple, rows: pa.Table, offset: pa.Table) -> pa.Table:
        tp, count = (np.frombuffer(offset[c][0].as_py()).copy() for c in ("tp", "all"))
        out = np.zeros(replicates + 1)
        for _, p, q in _ties(*_sorted(rows, True), replicates):
            hit, said = tp + np.cumsum(p, axis=0), count + np.cumsum(p + q, axis=0)
            out += (p * np.divide(hit, said, out=np.zeros_like(hit), where=said > 0)).sum(axis=0)
            tp, count = hit[-1], said[-1]
        return _row(key, unit, rows.schema, precision=out)

    steps = ranged.groupBy(*unit).cogroup(offsets.groupBy(*unit)).applyInArrow(precision, f"{keyed}{comma}range int, precision binary")

    def curves(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(left["range"].to_numpy())
        pos, neg, area, brier = (np.array([np.frombuffer(left[c][int(i)].as_py()) for i in order]) for c in ("pos", "neg", "area", "brier"))
        p, n = pos.sum(axis=0), neg.sum(axis=0)
        below = np.cumsum(neg, axis=0) - neg
        with np.errstate(invalid="ignore", divide="ignore"):
            scores = ((area + pos * below).sum(axis=0) / (p * n), sum(np.frombuffer(v.as_py()) for v in right["precision"]) / p, brier.sum(axis=0) / (p + n))
        out = []
        for name, v in zip(METRICS, scores, strict=True):
            drawn = v[1:][np.isfinite(v[1:])]
            ends = np.percentile(drawn, [2.5, 97.5]).tolist() if len(drawn) else [None, None]
            out.append((name, float(v[0]) if np.isfinite(v[0]) else None, float(drawn.std(ddof=1)) if len(drawn) > 1 else None, ends[0], float(drawn.mean()) if len(drawn) else None, ends[1]))
        columns = [pa.array([k.as_py()] * len(out), left.schema.field(c).type) for k, c in zip(key, keys, strict=True)]
        return pa.table([*columns, *(pa.array(c, pa.string() if i == 0 else pa.float64()) for i, c in enumerate(zip(*out, strict=True)))], [*keys, "metric", "score", "std", "lower", "mean", "upper"])

    return sums.groupBy(*keys).cogroup(steps.groupBy(*keys)).applyInArrow(curves, f"{keyed}{comma}metric string, score double, std double, lower double, mean double, upper double")
