"""Tables in and out: vector literals in CSV, rows as JSON, images, updates by key."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.vectors import parse_vector

MAX_IMAGE_BYTES = 20 << 20


def read_vector_csv(spark: SparkSession, path: str, vector: str = "v", kind: str = "float", header: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV whose ``vector`` column has literals such as ``{1,2}`` or ``[1,2]``; without a header, ``columns`` names them."""
    df = spark.read.csv(path, header=header, inferSchema=False, quote='"', escape='"')
    df = df.toDF(*columns) if columns else df
    return df.withColumn(vector, parse_vector(F.col(vector), kind))


def write_vector_csv(df: DataFrame, path: str, vector: str = "v") -> None:
    df.withColumn(vector, F.concat(F.lit("{"), F.array_join(F.col(vector).cast("array<string>"), ","), F.lit("}"))).write.mode("overwrite").csv(path)


def rows_from_json(spark: SparkSession, rows: Sequence[dict], schema: str | None = None) -> DataFrame:
    """Rows given as JSON objects; the first object's names are the columns, what others lack is null."""
    objects = [r for r in rows if isinstance(r, dict)]
    if not objects:
        raise ValueError("no rows")
    names = list(objects[0])
    lines = [json.dumps({k: r.get(k) for k in names}) for r in objects]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    kind = schema or spark.range(1).select(F.schema_of_json(F.lit(lines[0]))).first()[0]
    return raw.select(F.from_json("value", kind).alias("r")).select("r.*").select(*names)


def update_from(target: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``target`` with ``columns`` of the matching row of ``changes`` where that isn't null. Of several changes of a key one whole row counts: the greatest by these columns, in their order."""
    new = changes.groupBy(key).agg(F.max(F.struct(*columns)).alias("_new")).select(key, *[F.col(f"_new.{c}").alias(f"_{c}") for c in columns]) if columns else changes.select(key).distinct()
    joined = target.join(new, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, readable`` of image files; beyond 20 MB the content is empty and a vector of it is all -1. Spark doesn't list empty files."""
    df = spark.read.format("binaryFile").load(path)
    good = (F.col("length") > 0) & (F.col("length") <= MAX_IMAGE_BYTES)
    return df.select("path", F.when(good, F.col("content")).otherwise(F.lit(b"")).alias("content"), good.alias("readable"))


def embeddable(df: DataFrame, source: str) -> DataFrame:
    """Rows whose source can be embedded: not null, not empty, no failed summary."""
    return df.where(F.col(source).isNotNull() & (F.trim(source) != "") & (F.col(source) != "Error: Summary failed (llm)"))


def pending(df: DataFrame, source: str, target: str) -> DataFrame:
    """Of those, the rows that have no result yet."""
    return embeddable(df, source).where(F.col(target).isNull())


def read_ranges(spark: SparkSession, read, low: int, high: int, parts: int) -> DataFrame:
    """A keyed source in ``parts`` ranges of its key: ``read(a, b)`` gives the rows from a up to, not including, b; the last has ``high``."""
    if parts < 1 or high < low:
        raise ValueError("parts must be positive and high not below low")
    edges = sorted({low + (high + 1 - low) * i // parts for i in range(parts + 1)})
    out = None
    for a, b in zip(edges, edges[1:]):
        part = read(a, b)
        out = part if out is None else out.unionByName(part)
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 8, fetch: int = 2000, **options) -> DataFrame:
    """A database's table, each task reading a range of ``key``, ``fetch`` rows at a time."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, fetchsize=fetch, **options)
    return reader.load()
