"""Tables that change by whole commits: readers see one version or the next, whatever happens to a writer.

A writer writes its rows to a folder of its own, and commits by giving a small marker, which names that folder,
the next number. A number is given once: of two writers that build on one version the later to commit starts
again from the other's. A killed writer leaves a folder that no marker names, and the old rows stay.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RESULT_KEYS = ("labeling_function", "sub_task", "model", "head", "replicate", "k", "score")


class Committed:
    """A table in a folder, as its last commit left it."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    @functools.cached_property
    def _files(self):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def version(self) -> tuple[int, str | None]:
        """(number, data folder) of the last commit; (0, None) before the first."""
        if not self._files.exists(self._path("_commits")):
            return 0, None
        numbers = [int(n) for s in self._files.listStatus(self._path("_commits")) if (n := s.getPath().getName()).isdigit()]
        if not numbers:
            return 0, None
        marker = self._files.open(self._path(f"_commits/{max(numbers):010d}"))
        data = bytes(marker.readAllBytes()).decode()
        marker.close()
        return max(numbers), data

    def read(self) -> DataFrame:
        _, data = self.version()
        if data is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{data}")

    def change(self, make: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
        """Commit make(current rows), again on newer rows as long as others commit first; the new number."""
        for _ in range(tries):
            number, _ = self.version()
            data = f"data-{uuid.uuid4().hex}"
            rows = make(self.read()).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
            rows.write.parquet(f"{self.folder}/{data}")
            if self._commit(number + 1, data):
                return number + 1
            self._files.delete(self._path(data), True)
        raise RuntimeError(f"other writers committed {tries} times first")

    def _commit(self, number: int, data: str) -> bool:
        """Name data as version number; False if there is such a version. The marker is written aside and then given its name, which only one writer can."""
        self._files.mkdirs(self._path("_commits"))
        aside = self._path(f"_commits/.{data}")
        out = self._files.create(aside, False)
        out.write(bytearray(data.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._path(f"_commits/{number:010d}"), options)
        except Py4JJavaError as e:
            self._files.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def upsert(self, rows: DataFrame, keys: tuple[str, ...] = RESULT_KEYS) -> int:
        """rows in place of those of the same keys; a key that rows has several times keeps one row, the greatest. Null keys are equal."""
        others = [f.name for f in self.schema if f.name not in keys]
        one = rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in others))

        def changed(old: DataFrame) -> DataFrame:
            fresh = one.select(*(F.col(k).alias(f"_new_{k}") for k in keys))
            same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys))
            return old.join(fresh, same, "left_anti").unionByName(one)

        return self.change(changed)

    def missing(self, wanted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """What of wanted has no row yet."""
        return wanted.join(self.read().select(*keys).distinct(), list(keys), "left_anti")

    def swept(self) -> int:
        """Delete data folders that the last commit doesn't name, once no reader or writer is at work; how many."""
        _, data = self.version()
        old = [s.getPath() for s in self._files.listStatus(self._path("")) if s.getPath().getName().startswith("data-") and s.getPath().getName() != data]
        for p in old:
            self._files.delete(p, True)
        return len(old)
