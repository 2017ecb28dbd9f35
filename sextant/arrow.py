"""Arrow batches as numpy, and durable cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sextant.session import ship

#: Rows of the smaller side of a join that are broadcast at most; beyond, work goes in chunks or shuffles.
BROADCAST_ROWS = 10_000


def map_arrays(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterable[list]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow where ``make`` yields lists of arrays in the order of ``schema``."""
    ship(df.sparkSession)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(kind)
        for arrays in make(batches):
            yield pa.RecordBatch.from_arrays([a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, target)], schema=target)

    return df.mapInArrow(run, kind)


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column without nulls as rows of 64-bit floats; raises ValueError where the lengths differ."""
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1 or (dim is not None and len(lengths) and lengths[0] != dim):
        raise ValueError(f"expected vectors of {dim if dim is not None else 'one'} dimension, got {lengths.tolist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, dim or 0))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; one of our own only in local mode, ValueError elsewhere."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sextant-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so what follows doesn't depend on earlier stages' executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
