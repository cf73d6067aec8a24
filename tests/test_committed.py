"""Results that survive reruns: versions, two writers, a write killed half-way, and stages that are resumed."""

import os
import subprocess
import sys
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from timelode.sources.committed import Committed

SCHEMA = "task string, k int, value double"
KEYS = ("task", "k")


def rows(spark, *r):
    return spark.createDataFrame(r, SCHEMA)


def content(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_upserts_by_key(spark, tmp_path):
    t = Committed(spark, str(tmp_path / "t"), SCHEMA)
    assert t.read().count() == 0 and t.version() == (0, None)
    assert t.upsert(rows(spark, ("a", 1, 0.5), ("a", 2, 0.6), (None, 1, 0.1)), KEYS) == 1
    assert t.upsert(rows(spark, ("a", 2, 0.9), ("b", 1, 0.7), ("b", 1, 0.2), (None, 1, 0.3)), KEYS) == 2
    assert content(t) == sorted([("a", 1, 0.5), ("a", 2, 0.9), ("b", 1, 0.7), (None, 1, 0.3)], key=str)
    wanted = spark.createDataFrame([("a", 1), ("c", 5)], "task string, k int")
    assert [tuple(r) for r in t.missing(wanted, KEYS).collect()] == [("c", 5)]
    assert t.swept() == 1 and t.swept() == 0 and len(content(t)) == 4


def test_failed_writes_leave_the_old_rows(spark, tmp_path):
    t = Committed(spark, str(tmp_path / "t"), SCHEMA)
    t.upsert(rows(spark, ("a", 1, 0.5)), KEYS)
    bad = rows(spark, *(("b", i, float(i)) for i in range(40))).repartition(4)
    with pytest.raises(Exception, match="half-way"):
        t.change(lambda old: old.unionByName(bad).withColumn("value", F.when(F.col("k") == 33, F.raise_error(F.lit("half-way"))).otherwise(F.col("value"))))
    assert content(t) == [("a", 1, 0.5)] and t.version()[0] == 1


def test_of_two_writers_the_later_starts_again(spark, tmp_path):
    t, made = Committed(spark, str(tmp_path / "t"), SCHEMA), []
    t.upsert(rows(spark, ("a", 1, 0.0)), KEYS)

    def slow(old):
        made.append(old.count())
        if len(made) == 1:  # another writer commits in between
            Committed(spark, str(tmp_path / "t"), SCHEMA).upsert(rows(spark, ("other", 1, 1.0)), KEYS)
        return old.unionByName(rows(spark, ("slow", 1, 2.0)))

    assert t.change(slow) == 3 and made == [1, 2]
    assert [r[0] for r in content(t)] == ["a", "other", "slow"]
    threads = [threading.Thread(target=lambda i=i: Committed(spark, str(tmp_path / "t"), SCHEMA).upsert(rows(spark, ("many", i, 0.0)), KEYS)) for i in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert len(content(t)) == 7 and t.version()[0] == 7


CHILD = """
import sys, time
sys.path.insert(0, sys.argv[1])
from timelode.session import local_session
from timelode.sources.committed import Committed
from pyspark.sql import functions as F
spark = local_session(2, "killed", "1g")
def slow(batches):
    for b in batches:
        yield b
        print("writing", flush=True)
        time.sleep(600)
t = Committed(spark, sys.argv[2], "task string, k int, value double")
t.change(lambda old: old.unionByName(spark.range(10).selectExpr("'new' AS task", "CAST(id AS INT) AS k", "1.0D AS value").mapInArrow(slow, "task string, k int, value double")))
"""


def test_a_killed_writer_leaves_the_old_rows(spark, tmp_path):
    t = Committed(spark, str(tmp_path / "t"), SCHEMA)
    t.upsert(rows(spark, ("a", 1, 0.5)), KEYS)
    with open(tmp_path / "log", "w") as log:
        child = subprocess.Popen([sys.executable, "-c", CHILD, str(Path(__file__).resolve().parents[1]), str(tmp_path / "t")], stdout=log, stderr=log, start_new_session=True)
        began = time.time()
        data = lambda: [f for f in os.listdir(tmp_path / "t") if f.startswith("data-")]
        while len(data()) < 2 and time.time() - began < 90 and child.poll() is None:
            time.sleep(0.2)
        time.sleep(1)
        os.killpg(child.pid, 9)
        child.wait()
    assert len(data()) == 2 and content(t) == [("a", 1, 0.5)]
    t.upsert(rows(spark, ("a", 1, 0.7)), KEYS)
    assert content(t) == [("a", 1, 0.7)] and t.swept() == 2
