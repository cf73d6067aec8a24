"""Stages whose outputs are kept: a study that failed goes on where it stopped.

A stage's output is a table in a folder named by the stage and a fingerprint of what it is made from: its
parameters, the fingerprints of the stages before it, and the files that its inputs are read from. A table counts once
its write has committed; so a run after a failure, or with one parameter changed, makes only what is missing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def files_of(df: DataFrame) -> str:
    """A fingerprint of the files that df reads, by path, size and time, and of its plan; data that is not from files counts by its plan alone."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = hashlib.sha256(df._jdf.queryExecution().analyzed().canonicalized().toString().encode())
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.update(f"{f}|{status.getLen()}|{status.getModificationTime()}".encode())
    return seen.hexdigest()[:16]


class Stages:
    """The stages of one study in a folder. made and found tell which this run computed and which it read back."""

    def __init__(self, spark: SparkSession, folder: str, refresh: tuple[str, ...] = ()) -> None:
        self.spark, self.folder, self.refresh = spark, folder.rstrip("/"), set(refresh)
        self.marks: dict[str, str] = {}
        self.made: list[str] = []
        self.found: list[str] = []

    def run(self, name: str, make: Callable[[], DataFrame], after: tuple[str, ...] = (), **params) -> DataFrame:
        """The output of a stage: read back where it is committed, else made and written. Stages in refresh, and those after them, are made again."""
        if name in self.marks:
            raise ValueError(f"there are two stages {name}")
        told = json.dumps([name, sorted(params.items()), [self.marks[a] for a in after]], default=str)
        self.marks[name] = hashlib.sha256(told.encode()).hexdigest()[:16]
        if self.refresh & set(after):
            self.refresh.add(name)
        path = f"{self.folder}/{name}-{self.marks[name]}"
        if name not in self.refresh and self._committed(path):
            self.found.append(name)
        else:
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)

    def _committed(self, path: str) -> bool:
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
