"""Array files of features and labels as a Spark data source: `spark.read.format("feature_arrays")`.

A file is a zip of numpy arrays (.npz), in one of four layouts that the names of its arrays tell:

* named: data_matrix, patient_ids, labeling_time;
* timelines: the same with tokenized_timelines, one row of tokens for each row of the matrix;
* positional: arr_0 the matrix, arr_1 patients, arr_2 label values, arr_3 label times;
* labels: patient_ids, label_values, label_times; values of survival labels are (time, censored) pairs.

Reading gives a partition to each range of rows of each file, and a task reads only its range of every array.
Writing makes files of at most rows_per_file rows; they get their names when the job commits, so a failed job
or a lost task leaves none. Arrays of Python objects are refused, as they would have to be unpickled.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "feature_arrays"
SCHEMA = "patient_id long, prediction_time timestamp_ntz, features array<double>, value double, is_censored boolean, tokens array<long>, source_file string"
#: Arrays of each layout: matrix, patients, values, times, tokens.
LAYOUTS = {
    "named": ("data_matrix", "patient_ids", None, "labeling_time", None),
    "timelines": ("data_matrix", "patient_ids", None, "labeling_time", "tokenized_timelines"),
    "positional": ("arr_0", "arr_1", "arr_2", "arr_3", None),
    "labels": (None, "patient_ids", "label_values", "label_times", None),
}
ROWS = 100_000
_ARROW = pa.schema(
    [("patient_id", pa.int64()), ("prediction_time", pa.timestamp("us")), ("features", pa.list_(pa.float64())), ("value", pa.float64()), ("is_censored", pa.bool_()), ("tokens", pa.list_(pa.int64())), ("source_file", pa.string())]
)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(member) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(member)
    shape, by_column, kind = np.lib.format.read_array_header_1_0(member) if version == (1, 0) else np.lib.format.read_array_header_2_0(member)
    if kind.hasobject:
        raise ValueError("arrays of objects are not read")
    if by_column and len(shape) > 1:
        raise ValueError("arrays in column order have no ranges of rows")
    return shape, kind


def _rows(archive: zipfile.ZipFile, name: str, first: int, last: int) -> np.ndarray:
    """Rows first to last of one array of the archive; what lies before them is skipped."""
    with archive.open(f"{name}.npy") as member:
        shape, kind = _header(member)
        width = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
        member.seek(first * width, io.SEEK_CUR)
        return np.frombuffer(member.read((last - first) * width), kind).reshape(last - first, *shape[1:])


def _layout(names: set[str]) -> str:
    """The layout with the most arrays, of those whose arrays are all there."""
    fitting = [k for k, arrays in LAYOUTS.items() if all(a in names for a in arrays if a)]
    if not fitting:
        raise ValueError(f"no layout has the arrays {sorted(names)}")
    return max(fitting, key=lambda k: sum(a is not None for a in LAYOUTS[k]))


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()).cast(kind))


@dataclass
class Range(InputPartition):
    path: str
    layout: str
    first: int
    last: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def _files(self) -> list[str]:
        own, path = _opened(self.path)
        info = own.get_file_info(path)
        if info.type == fs.FileType.File:
            return [path]
        found = own.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(path) :].split("/"))
        return sorted(f.path for f in found if f.path.endswith(".npz") and not hidden(f.path))

    def partitions(self) -> list[Range]:
        own, _ = _opened(self.path)
        out = []
        for path in self._files():
            with own.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                layout = _layout({n.removesuffix(".npy") for n in archive.namelist()})
                sizes = set()
                for name in filter(None, LAYOUTS[layout]):
                    with archive.open(f"{name}.npy") as member:
                        sizes.add(_header(member)[0][0])
            if len(sizes) != 1:
                raise ValueError(f"{path}: arrays of {sorted(sizes)} rows")
            n = sizes.pop()
            out += [Range(path, layout, a, min(a + self.rows, n)) for a in range(0, n, self.rows)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        own, _ = _opened(self.path)
        with own.open_input_file(part.path) as file, zipfile.ZipFile(file) as archive:
            for a in range(part.first, part.last, 4096):
                b = min(a + 4096, part.last)
                x, who, values, when, tokens = (None if k is None else _rows(archive, k, a, b) for k in LAYOUTS[part.layout])
                none, n = lambda kind: pa.nulls(b - a, kind), b - a
                pairs = values is not None and values.ndim == 2
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(who.ravel()).cast(pa.int64()), pa.array(when.ravel().astype("datetime64[us]")),
                        none(_ARROW.field(2).type) if x is None else _lists(x, pa.float64()),
                        none(pa.float64()) if values is None else pa.array(values.reshape(n, -1)[:, 0]).cast(pa.float64()),
                        pa.array(values[:, 1].astype(bool)) if pairs else none(pa.bool_()),
                        none(_ARROW.field(5).type) if tokens is None else _lists(tokens, pa.int64()), pa.array([part.path] * n),
                    ],
                    schema=_ARROW,
                )


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, layout: str, rows: int, overwrite: bool) -> None:
        self.path, self.layout, self.rows, self.overwrite, self.job = path, layout, rows, overwrite, uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        own, path = _opened(self.path)
        own.create_dir(f"{path}/_writing-{self.job}", recursive=True)
        names: list[str] = []
        held, n = [], 0

        def flush() -> None:
            names.append(f"part-{uuid.uuid4().hex[:12]}.npz")
            with own.open_output_stream(f"{path}/_writing-{self.job}/{names[-1]}") as file, io.BytesIO() as content:
                np.savez(content, **self._arrays(pa.Table.from_batches(held)))
                file.write(content.getbuffer())

        for batch in batches:
            for a in range(0, batch.num_rows, self.rows):
                part = batch.slice(a, self.rows)
                if n and n + part.num_rows > self.rows:
                    flush()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            flush()
        return Files(names)

    def _arrays(self, rows: pa.Table) -> dict[str, np.ndarray]:
        def matrix(name: str) -> np.ndarray:
            lists = rows[name].combine_chunks()
            width = set(np.asarray(lists.value_lengths()).tolist())
            if lists.null_count or len(width) != 1:
                raise ValueError(f"{name} has rows of {sorted(map(str, width))} entries")
            return np.asarray(lists.flatten()).reshape(len(lists), -1)

        x, who, values, when, tokens = LAYOUTS[self.layout]
        out = {who: rows["patient_id"].to_numpy(), when: rows["prediction_time"].cast(pa.timestamp("us")).to_numpy()}
        if x:
            out[x] = matrix("features")
        if tokens:
            out[tokens] = matrix("tokens")
        if values:
            v = rows["value"].to_numpy()
            censored = rows["is_censored"].to_numpy() if "is_censored" in rows.column_names else np.array([None])
            out[values] = v if any(c is None for c in censored) else np.column_stack([v, censored.astype(float)])
        return out

    def commit(self, messages: list[Files | None]) -> None:
        own, path = _opened(self.path)
        if self.overwrite:
            for f in own.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.path.endswith(".npz"):
                    own.delete_file(f.path)
        own.create_dir(path, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            own.move(f"{path}/_writing-{self.job}/{name}", posixpath.join(path, name))
        self.abort([])

    def abort(self, messages: list[Files | None]) -> None:
        own, path = _opened(self.path)
        if own.get_file_info(f"{path}/_writing-{self.job}").type == fs.FileType.Directory:
            own.delete_dir(f"{path}/_writing-{self.job}")


class FeatureArrays(DataSource):
    """Options: path; rows_per_partition of a read; layout and rows_per_file of a write."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], int(self.options.get("rows_per_partition", ROWS)))

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        layout = self.options.get("layout", "named")
        if layout not in LAYOUTS:
            raise ValueError(f"no layout {layout}: {', '.join(LAYOUTS)}")
        return ArrayWriter(self.options["path"], layout, int(self.options.get("rows_per_file", ROWS)), overwrite)


def read(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """The rows of one array file, or of all in a folder, as SCHEMA."""
    spark.dataSource.register(FeatureArrays)
    return spark.read.format(NAME).option("rows_per_partition", rows).load(path)


def write(rows: DataFrame, path: str, layout: str = "named", mode: str = "append", per_file: int = ROWS) -> None:
    """rows (those columns of SCHEMA that the layout calls for) as array files in a folder."""
    rows.sparkSession.dataSource.register(FeatureArrays)
    rows.write.format(NAME).option("layout", layout).option("rows_per_file", per_file).mode(mode).save(path)
