"""Array files of every layout, read by ranges of rows and written by tasks, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelode.sources import arrays


def rows_of(n, width=3):
    rng = np.random.default_rng(n)
    return rng.normal(size=(n, width)), rng.integers(1, 99, n), np.datetime64("2024-01-01T00:00:00", "us") + rng.integers(0, 10**12, n)


def key(r):
    return (r.patient_id, r.prediction_time)


def want(x, who, when):
    return sorted((int(p), t.astype(object), v.tolist()) for p, t, v in zip(who, when, x, strict=True))


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_layouts_by_ranges(spark, tmp_path, save):
    x, who, when = rows_of(95)
    tokens, values = np.arange(95 * 4, dtype=np.int32).reshape(95, 4), np.arange(95.0)
    save(tmp_path / "a.npz", data_matrix=x, patient_ids=who, labeling_time=when)
    save(tmp_path / "b.npz", data_matrix=x, patient_ids=who, labeling_time=when, tokenized_timelines=tokens)
    save(tmp_path / "c.npz", x.astype(np.float32), who.astype(np.int32), values > 40, when.astype("datetime64[s]"))
    save(tmp_path / "d.npz", patient_ids=who, label_values=np.column_stack([values, who % 2]), label_times=when)
    (tmp_path / "_hidden.npz").write_text("not an archive")
    got = arrays.read(spark, str(tmp_path), 30)
    assert got.rdd.getNumPartitions() == 16 and got.count() == 4 * 95
    of = lambda f: got.filter(F.col("source_file").endswith(f)).collect()
    for f in "ab":
        assert sorted((r.patient_id, r.prediction_time, r.features) for r in of(f"{f}.npz")) == want(x, who, when)
    assert sorted(r.tokens for r in of("b.npz")) == tokens.tolist() and all(r.tokens is None for r in of("a.npz"))
    assert sorted((r.patient_id, r.prediction_time, r.features) for r in of("c.npz")) == want(x.astype(np.float32), who, when.astype("datetime64[s]"))
    assert sum(r.value for r in of("c.npz")) == 54
    assert sorted((r.value, r.is_censored) for r in of("d.npz")) == [(float(v), bool(w % 2)) for v, w in zip(values, who, strict=True)]
    assert arrays.read(spark, str(tmp_path / "a.npz")).count() == 95


@pytest.mark.parametrize("layout", ["named", "timelines", "positional", "labels"])
def test_round_trip(spark, tmp_path, layout):
    x, who, when = rows_of(50)
    rows = [(int(p), t.astype(object), v.tolist(), float(i), bool(i % 2), [i, i + 1]) for i, (p, t, v) in enumerate(zip(who, when, x, strict=True))]
    df = spark.createDataFrame(rows, "patient_id long, prediction_time timestamp_ntz, features array<double>, value double, is_censored boolean, tokens array<long>").repartition(3)
    arrays.write(df, str(tmp_path / "t"), layout, per_file=7)
    files = sorted((tmp_path / "t").iterdir())
    assert len(files) >= 9 and not [f for f in files if f.name.startswith("_")]
    plain = [dict(np.load(f)) for f in files]
    names = [a for a in arrays.LAYOUTS[layout] if a]
    assert all(sorted(p) == sorted(names) and len({len(v) for v in p.values()}) == 1 for p in plain)
    assert sorted(np.concatenate([p[arrays.LAYOUTS[layout][1]] for p in plain]).tolist()) == sorted(who.tolist())
    back = arrays.read(spark, str(tmp_path / "t")).drop("source_file")
    kept = {"named": ["features"], "timelines": ["features", "tokens"], "positional": ["features", "value", "is_censored"], "labels": ["value", "is_censored"]}[layout]
    same = ["patient_id", "prediction_time", *kept]
    assert sorted(map(tuple, back.select(same).collect())) == sorted(map(tuple, df.select(same).collect()))
    arrays.write(df.limit(4), str(tmp_path / "t"), layout, mode="overwrite")
    assert arrays.read(spark, str(tmp_path / "t")).count() == 4


def test_failed_writes_leave_nothing(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("patient_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("prediction_time"), F.when(F.col("id") == 33, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("features"))
    with pytest.raises(Exception, match="entries"):
        arrays.write(df.repartition(4), str(tmp_path / "t"))
    assert not [f for f in (tmp_path / "t").rglob("*") if f.suffix == ".npz"]


def test_refused_files(spark, tmp_path):
    np.savez(tmp_path / "a.npz", data_matrix=np.zeros((3, 2)), patient_ids=np.zeros(2), labeling_time=np.zeros(3, "datetime64[us]"))
    with pytest.raises(Exception, match="rows"):
        arrays.read(spark, str(tmp_path / "a.npz")).count()
    np.savez(tmp_path / "b.npz", patient_ids=np.array([object()]), label_values=np.zeros(1), label_times=np.zeros(1, "datetime64[us]"))
    with pytest.raises(Exception, match="objects"):
        arrays.read(spark, str(tmp_path / "b.npz")).count()
    np.savez(tmp_path / "c.npz", other=np.zeros(1))
    with pytest.raises(Exception, match="no layout"):
        arrays.read(spark, str(tmp_path / "c.npz")).count()
