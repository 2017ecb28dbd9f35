"""Vector files: .fvecs, .ivecs and .bvecs as a Python data source, a reader and a writer.

A record is the dimension as a little-endian 32-bit integer and then that many elements.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sextant.arrow import map_arrays

KINDS = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int"), "bvecs": ("u1", "smallint")}
#: Bytes that a task reads, about.
SPLIT = 64 << 20
#: Records in an Arrow batch.
BATCH = 8192


def decode(data: bytes, kind: str, dim: int | None = None) -> np.ndarray:
    """All records as rows; raises ValueError if dimensions differ or a record is cut off."""
    dtype = np.dtype(KINDS[kind][0])
    if not data:
        return np.zeros((0, dim or 0), dtype)
    first = int.from_bytes(data[:4], "little", signed=True)
    stride = 4 + first * dtype.itemsize
    if first <= 0 or len(data) % stride or (dim is not None and dim != first):
        raise ValueError("vector dimensions differ or a record is cut off")
    rows = np.frombuffer(data, np.uint8).reshape(-1, stride)
    if (np.ascontiguousarray(rows[:, :4]).view("<i4")[:, 0] != first).any():
        raise ValueError("vector dimensions differ")
    return np.ascontiguousarray(rows[:, 4:]).view(dtype)


def encode(rows: np.ndarray, kind: str) -> bytes:
    dtype = np.dtype(KINDS[kind][0])
    head = np.full((len(rows), 1), rows.shape[1], "<i4").view(np.uint8)
    return np.concatenate([head, np.ascontiguousarray(rows.astype(dtype)).view(np.uint8).reshape(len(rows), -1)], 1).tobytes()


class _Part(InputPartition):
    def __init__(self, path: str, start: int, rows: int):
        self.path, self.start, self.rows = path, start, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.count = options["path"], options.get("count")
        self.kind = options.get("kind") or os.path.splitext(self.path)[1].lstrip(".")
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of vector file: {self.kind}")

    def partitions(self) -> list[_Part]:
        path = self.path.removeprefix("file://")
        files = sorted(glob.glob(f"{path}/*.{self.kind}")) if os.path.isdir(path) else [path]
        left, parts = int(self.count) if self.count is not None else 1 << 62, []
        for name in files:
            size = os.path.getsize(name)
            if not size:
                continue
            with open(name, "rb") as f:
                dim = int.from_bytes(f.read(4), "little", signed=True)
            stride = 4 + dim * np.dtype(KINDS[self.kind][0]).itemsize
            if dim <= 0 or size % stride:
                raise ValueError(f"{name}: vector dimensions differ or a record is cut off")
            rows, step = min(left, size // stride), max(1, SPLIT // stride)
            left -= rows
            parts += [_Part(name, a * stride, min(step, rows - a)) for a in range(0, rows, step)]
        return parts

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        dtype, name = KINDS[self.kind]
        kind = {"float": pa.float32(), "int": pa.int32(), "smallint": pa.int16()}[name]
        with open(part.path, "rb") as f:
            f.seek(0)
            dim = int.from_bytes(f.read(4), "little", signed=True)
            stride = 4 + dim * np.dtype(dtype).itemsize
            f.seek(part.start)
            for a in range(0, part.rows, BATCH):
                rows = decode(f.read(min(BATCH, part.rows - a) * stride), self.kind, dim)
                flat = pa.array(rows.astype(kind.to_pandas_dtype()).ravel(), kind)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), flat)
                yield pa.RecordBatch.from_arrays([lists], names=["vector"])


class VectorFiles(DataSource):
    """``spark.read.format("vecs").option("count", n).load(path)``; big files are read in parts."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        kind = self.options.get("kind") or os.path.splitext(self.options["path"])[1].lstrip(".")
        return f"vector array<{KINDS.get(kind, ('', 'float'))[1]}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str, count: int | None = None, kind: str | None = None) -> DataFrame:
    """``vector`` of each record, ``count`` at most."""
    from sextant.session import ship

    ship(spark)
    spark.dataSource.register(VectorFiles)
    reader = spark.read.format("vecs")
    for name, value in (("count", count), ("kind", kind)):
        reader = reader.option(name, value) if value is not None else reader
    return reader.load(path)


def parse_fvecs(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    return read(spark, path, count, "fvecs")


def parse_ivecs(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    return read(spark, path, count, "ivecs")


def parse_bvecs(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    return read(spark, path, count, "bvecs")


def write(df: DataFrame, folder: str, kind: str = "fvecs", vector: str = "embedding") -> int:
    """Every partition as a file of ``folder``, which all executors share; null vectors are skipped. Returns the vectors written."""
    folder = folder.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import uuid

        from sextant.arrow import matrix

        name, n = f"{folder}/{uuid.uuid4().hex}", 0
        with open(f"{name}.tmp", "wb") as f:
            for batch in batches:
                rows = matrix(batch.column(0))
                f.write(encode(rows, kind) if len(rows) else b"")
                n += len(rows)
        os.replace(f"{name}.tmp", f"{name}.{kind}") if n else os.remove(f"{name}.tmp")
        yield [np.array([n])]

    return map_arrays(df.where(F.col(vector).isNotNull()).select(vector), run, "n long").agg(F.sum("n")).first()[0] or 0
