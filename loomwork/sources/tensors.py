"""Tensors by key: a Spark data source of arrays with a type and a shape.

A store is a folder of Parquet files, each with a range of keys in order, and a manifest that names the
files and their first and last keys. Rows are (key, dtype, shape, data); the numbers are packed as the
bytes of their own type. A read may ask for keys, a prefix or a range: it has one task for each file
whose keys meet them, and inside a file whole row groups are skipped by their statistics. Without the
data option only the headers are read, so shapes and types cost no numbers.

What a read asks for is given as options, not as filters that Spark hands down: scans of one DataFrame
that stand in one plan with different filters share one Python reader, which then holds the filters of
the last of them. Filters on a read are evaluated by Spark as usual.

Writing is atomic: tasks write files with new names, and the commit replaces the manifest in one
rename; readers of the old manifest keep its files until `vacuum`. A failed write leaves the store as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "loomwork_tensors"
SCHEMA = "key string, dtype string, shape array<bigint>, data array<double>"
MANIFEST = "_tensors.json"
#: Packed bytes of a row group.
GROUP_BYTES = 8 << 20

_STORED = pa.schema([("key", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("data", pa.binary())])
_READ = pa.schema([("key", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("data", pa.list_(pa.float64()))])


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and its path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _manifest(path: str) -> list[dict]:
    fs, root = _place(path)
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.readall())["files"]


@dataclass
class Keys:
    """Which keys a read asks for: bounds (inclusive), a prefix, a set of keys; all of them must hold."""

    low: str | None = None
    high: str | None = None
    prefix: str = ""
    only: list[str] | None = None

    def meets(self, low: str, high: str) -> bool:
        """Can a run of keys from `low` to `high` hold a wanted one?"""
        if (self.low is not None and high < self.low) or (self.high is not None and low > self.high):
            return False
        if self.prefix and not (low[: len(self.prefix)] <= self.prefix <= high[: len(self.prefix)]):
            return False
        return self.only is None or any(low <= k <= high for k in self.only)

    def mask(self, key: pa.Array) -> pa.Array:
        out = pa.array(np.ones(len(key), bool))
        if self.only is not None:
            out = pc.and_(out, pc.is_in(key, pa.array(self.only, pa.string())))
        if self.low is not None:
            out = pc.and_(out, pc.greater_equal(key, self.low))
        if self.high is not None:
            out = pc.and_(out, pc.less_equal(key, self.high))
        return pc.and_(out, pc.starts_with(key, self.prefix)) if self.prefix else out


@dataclass
class KeyRange(InputPartition):
    """One file of the store."""

    name: str

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class TensorReader(DataSourceReader):
    def __init__(self, path: str, data: bool, keys: Keys):
        self.path, self.data, self.keys = path, data, keys

    def partitions(self) -> list[InputPartition]:
        return [KeyRange(f["name"]) for f in _manifest(self.path) if self.keys.meets(f["low"], f["high"])]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, KeyRange):  # Spark's stand-in where no file is left
            return
        fs, root = _place(self.path)
        columns = ["key", "dtype", "shape", *["data"] * self.data]
        with fs.open_input_file(f"{root}/{partition.name}") as handle:
            file = pq.ParquetFile(handle)
            for g in range(file.num_row_groups):
                s = file.metadata.row_group(g).column(0).statistics
                if s is not None and s.has_min_max and not self.keys.meets(s.min, s.max):
                    continue
                for batch in file.iter_batches(1024, [g], columns):
                    batch = batch.filter(self.keys.mask(batch.column("key")))
                    if batch.num_rows:
                        yield self._decoded(batch)

    def _decoded(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if not self.data:
            return pa.record_batch([*batch.columns, pa.nulls(batch.num_rows, _READ.field("data").type)], schema=_READ)
        numbers = [np.frombuffer(b, np.dtype(t)).astype(np.float64) for t, b in zip(batch.column("dtype").to_pylist(), batch.column("data").to_pylist(), strict=True)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int32)
        data = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(numbers)))
        return pa.record_batch([*batch.columns[:3], data], schema=_READ)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class TensorWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _place(self.path)
        name, out, low, high, rows, held, size = f"part-{uuid.uuid4().hex}.parquet", None, None, None, 0, [], 0
        fs.create_dir(root, recursive=True)

        def flush() -> None:
            nonlocal out, held, size
            if held:
                out = out or pq.ParquetWriter(f"{root}/{name}", _STORED, filesystem=fs, compression="zstd")
                out.write_table(pa.Table.from_batches(held), row_group_size=1 << 30)
                held, size = [], 0

        for batch in iterator:
            for at in range(0, batch.num_rows, 1024):
                part = self._packed(batch.slice(at, 1024))
                keys = part.column("key")
                first, last = pc.min(keys).as_py(), pc.max(keys).as_py()
                low, high = first if low is None else min(low, first), last if high is None else max(high, last)
                rows, size = rows + part.num_rows, size + part.nbytes
                held.append(part)
                if size >= GROUP_BYTES:
                    flush()
        flush()
        if out is None:
            return Written([])
        out.close()
        return Written([{"name": name, "rows": rows, "low": low, "high": high}])

    @staticmethod
    def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.select(["key", "dtype", "shape", "data"]).to_pydict()
        if any(k is None for k in rows["key"]):
            raise ValueError("a tensor has no key")
        data = []
        for key, dtype, shape, numbers in zip(*rows.values(), strict=True):
            if len(numbers) != int(np.prod(shape)):
                raise ValueError(f"{key}: {len(numbers)} numbers for the shape {shape}")
            data.append(np.asarray(numbers, np.float64).astype(np.dtype(dtype).newbyteorder("<")).tobytes())
        return pa.record_batch([pa.array(rows["key"], pa.string()), pa.array(rows["dtype"], pa.string()), pa.array(rows["shape"], pa.list_(pa.int64())), pa.array(data, pa.binary())], schema=_STORED)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        exists = fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.NotFound
        files = [] if self.overwrite or not exists else _manifest(self.path)
        files = sorted([*files, *(f for m in messages if m for f in m.files)], key=lambda f: f["low"])
        new = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as f:
            f.write(json.dumps({"files": files}).encode())
        fs.move(new, f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _place(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{f['name']}")


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TensorReader:
        return TensorReader(self.options["path"], self.options.get("data", "true").lower() != "false", Keys(**json.loads(self.options.get("keys", "{}"))))

    def writer(self, schema: StructType, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(TensorSource)


def write_tensors(rows: DataFrame, path: str, ranges: int = 16, append: bool = False) -> None:
    """Store rows (key, dtype, shape, data) as `ranges` files of consecutive keys; appended keys must be new ones."""
    register(rows.sparkSession)
    d = rows.select("key", F.col("dtype").cast("string"), F.col("shape").cast("array<bigint>"), F.col("data").cast("array<double>"))
    d.repartitionByRange(ranges, "key").sortWithinPartitions("key").write.format(NAME).mode("append" if append else "overwrite").save(path)


def read_tensors(spark: SparkSession, path: str, keys: list[str] | None = None, prefix: str = "", low: str | None = None, high: str | None = None, data: bool = True) -> DataFrame:
    """The stored tensors of the keys, with the prefix, from `low` to `high`; without `data` their headers only, data being null."""
    register(spark)
    wanted = Keys(low, high, prefix, None if keys is None else sorted(set(keys)))
    return spark.read.format(NAME).option("data", str(data).lower()).option("keys", json.dumps(asdict(wanted))).load(path)


def put_tensors(rows: DataFrame, path: str, order: str, ranges: int = 16) -> None:
    """Write many: of several rows of a key the last by `order` counts, and it replaces a stored one."""
    w = Window.partitionBy("key").orderBy(F.col(order).desc())
    new = rows.withColumn("n_", F.row_number().over(w)).where("n_ = 1").select("key", "dtype", "shape", "data")
    old = read_tensors(rows.sparkSession, path).join(new.select("key"), "key", "left_anti")
    write_tensors(old.unionByName(new), path, ranges)


def vacuum(path: str) -> None:
    """Delete the files that the manifest doesn't name, once nothing reads older versions or writes."""
    fs, root = _place(path)
    names = {f["name"] for f in _manifest(path)}
    for f in fs.get_file_info(pafs.FileSelector(root)):
        if f.base_name.startswith("part-") and f.base_name not in names:
            fs.delete_file(f.path)
