"""Clips as npz files, one a row, as a data source that Spark reads and writes.

    spark.dataSource.register(npz.NpzSource)
    rows.write.format("npz").mode("append").save(path)
    spark.read.format("npz").option("key", "frames").load(path)

A row to write has ``name`` (of the file, ``.npz`` is added if missing) and a struct column
(kind string, shape array<bigint>, data binary) for each array; a null one is left out. Files
are opened with ``pyarrow.fs``, in the tasks alone, so the folder has to be one that it opens."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

READ = "path string, name string, kind string, shape array<bigint>, data binary"
#: Bytes of files that a task reads; a file is never split.
PARTITION_BYTES = 32 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """Folder of a task whose files are whole, and their number."""

    folder: str
    files: int


@dataclass
class Files(InputPartition):
    paths: list[str]


class NpzWriter(DataSourceWriter):
    """A task writes into a folder of its own beside the others, under a name that readers
    skip. Commit gives the folders of the tasks that ended well their names, one rename a
    task; what failed, was repeated or lost goes with the hidden folder."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.arrays = [f.name for f in schema if f.name != "name"]
        if "name" not in schema.names or not self.arrays:
            raise ValueError("rows need a name and at least one array")
        self.job = uuid.uuid4().hex
        self.hidden = f"_writing-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = _opened(self.path)
        folder = f"{self.hidden}/{uuid.uuid4().hex}"
        fs.create_dir(f"{root}/{folder}", recursive=True)
        names: set[str] = set()
        for row in iterator:
            name = row["name"] if row["name"].endswith(".npz") else row["name"] + ".npz"
            if "/" in name or name in names:
                raise ValueError(f"not a new file name: {name}")
            names.add(name)
            held = {c: row[c] for c in self.arrays if row[c] is not None}
            packed = io.BytesIO()
            np.savez_compressed(packed, **{c: np.frombuffer(a["data"], np.dtype(a["kind"])).reshape(a["shape"]) for c, a in held.items()})
            with fs.open_output_stream(f"{root}/{folder}/{name}") as out:
                out.write(packed.getbuffer())
        return Written(folder, len(names))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        before = [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.Directory and i.base_name.startswith("part-")]
        for number, told in enumerate(m for m in messages if m is not None and m.files):
            fs.move(f"{root}/{told.folder}", f"{root}/part-{number:05d}-{self.job}")
        for old in before if self.overwrite else []:
            fs.delete_dir(old)
        self._clear(fs, root)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.hidden}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.hidden}")


class NpzReader(DataSourceReader):
    def __init__(self, path: str, key: str, partition_bytes: int):
        self.path, self.key, self.partition_bytes = path, key, partition_bytes

    def partitions(self) -> list[Files]:
        """Files in order of their paths, next to each other up to ``partition_bytes`` a task."""
        fs, root = _opened(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(root) :].split("/"))
        files = sorted((i.path, i.size) for i in found if i.type == pafs.FileType.File and i.path.endswith(".npz") and not hidden(i.path))
        parts: list[Files] = []
        room = 0
        for path, size in files:
            if not parts or size > room:
                parts.append(Files([]))
                room = self.partition_bytes
            parts[-1].paths.append(path)
            room -= size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("shape", pa.list_(pa.int64())), ("data", pa.binary())])
        for path in partition.paths:
            with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
                if f"{self.key}.npy" not in z.namelist():
                    continue
                with z.open(f"{self.key}.npy") as entry:
                    array = np.lib.format.read_array(entry, allow_pickle=False)
            name = path.rsplit("/", 1)[-1]
            yield pa.RecordBatch.from_pylist([{"path": path, "name": name, "kind": array.dtype.str, "shape": list(array.shape), "data": array.tobytes()}], schema=schema)


class NpzSource(DataSource):
    """Options: ``key``, the array to read, of which alone the entry is read and unpacked (a file
    without it gives no row); ``partitionBytes``, 0 for a task a file. Modes: append adds
    files, overwrite takes away those of earlier writes once the new ones have their names."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return READ

    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def reader(self, schema: StructType) -> NpzReader:
        if "key" not in self.options:
            raise ValueError("option key names the array to read")
        return NpzReader(self._path(), self.options["key"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(self._path(), schema, overwrite)


def array_of(values: Column, shape: Column) -> Column:
    """The struct of an array of doubles that are given flat; null if they are."""

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f8").tobytes())

    return F.when(values.isNotNull(), F.struct(F.lit("<f8").alias("kind"), shape.cast("array<bigint>").alias("shape"), packed(values).alias("data")))


def values_of(data: Column) -> Column:
    """Flat doubles of the bytes of such an array."""

    @F.pandas_udf("array<double>")
    def unpacked(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x, "<f8"))

    return unpacked(data)


def write_arrays(rows: DataFrame, path: str, mode: str = "append") -> None:
    """``rows`` (name, an array a column) as files. Names are to be unique: two equal ones in
    a task are an error, in two tasks a file each."""
    rows.sparkSession.dataSource.register(NpzSource)
    rows.write.format("npz").mode(mode).save(path)


def read_array(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(path, name, kind, shape, data) of one array of each file."""
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("key", key).load(path)
