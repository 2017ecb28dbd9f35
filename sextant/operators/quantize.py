"""Product quantization: k-means codebooks, encoding, decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.arrow import map_arrays, matrix
from sextant.functions.distance import Metric, kernel
from sextant.functions.vectors import to_codes

#: Vectors that k-means uses at most, chosen by hash.
TRAIN_ROWS = 100_000
TOLERANCE, ROUNDS = 0.1, 200
CODEBOOK = "subvector_id int, centroid_id int, c array<float>"


def spans(dim: int, subvectors: int) -> list[tuple[int, int]]:
    """Start and end of each subvector; the last takes what is left over."""
    size = dim // subvectors
    return [(i * size, dim if i == subvectors - 1 else (i + 1) * size) for i in range(subvectors)]


def nearest(x: np.ndarray, centres: np.ndarray, metric: str = "l2sq", block: int = 1 << 22) -> np.ndarray:
    """The nearest centre of each row, the lowest of equals; ``block`` distances at a time."""
    step = max(1, block // max(1, len(centres)))
    return np.concatenate([kernel(metric)(x[i : i + step], centres).argmin(1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def lloyd(x: np.ndarray, clusters: int, metric: str = "l2sq", rounds: int = ROUNDS, tolerance: float = TOLERANCE, seed: int = 0) -> np.ndarray:
    """k-means from distinct random rows; a cluster without points keeps its centre. Ends when centres move by ``tolerance`` at most on average."""
    distances = kernel(metric)
    different = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = different[rng.choice(len(different), min(clusters, len(different)), replace=False)].copy()
    if len(centres) < clusters:
        centres = np.concatenate([centres, np.repeat(centres[-1:], clusters - len(centres), 0)])
    for _ in range(rounds):
        own = nearest(x, centres, metric)
        counts = np.bincount(own, minlength=clusters)
        sums = np.stack([np.bincount(own, column, clusters) for column in x.T], 1)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        moved = np.mean([distances(a[None], b[None])[0, 0] for a, b in zip(new, centres)])
        centres = new
        if moved <= tolerance:
            break
    return centres


def create_codebook(df: DataFrame, clusters: int, subvectors: int, metric: str = "l2sq", vector: str = "embedding", limit: int = TRAIN_ROWS, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """``subvector_id, centroid_id, c``: k-means of each subvector, one task each. Null vectors are skipped."""
    if subvectors <= 0:
        raise ValueError("Subvector count can not be zero")
    if not 1 <= clusters <= 256:
        raise ValueError("Cluster count can not be greater than 256")
    if limit < clusters:
        raise ValueError("Limit should be greater or equal to cluster count")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64("v"), F.to_json("v")).limit(limit)
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    if shape.n < clusters:
        raise ValueError("Clusters can not be bigger than the number of rows")
    if shape.a != shape.b:
        raise ValueError("Table should have equally sized array columns")
    if shape.a % subvectors:
        raise ValueError("Dimension should be divisible by the number of subvectors")
    Metric.of(metric)
    parts = F.array(*[F.struct(F.lit(i).alias("subvector_id"), F.slice("v", a + 1, b - a).alias("part")) for i, (a, b) in enumerate(spans(shape.a, subvectors))])

    def fit(table: pa.Table) -> pa.Table:
        number = table.column("subvector_id")[0].as_py()
        centres = lloyd(matrix(table.column("part").combine_chunks()), clusters, metric, rounds, seed=seed + number)
        return pa.table({"subvector_id": pa.array([number] * clusters, pa.int32()), "centroid_id": pa.array(range(clusters), pa.int32()), "c": pa.array(list(centres.astype(np.float32)), pa.list_(pa.float32()))})

    return rows.select(F.explode(parts).alias("p")).select("p.*").groupBy("subvector_id").applyInArrow(fit, CODEBOOK)


def load_codebook(codebook: DataFrame) -> list[np.ndarray]:
    """Centres by subvector; a codebook is 256 rows for each subvector at most."""
    rows = codebook.orderBy("subvector_id", "centroid_id").collect()
    if not rows:
        raise ValueError("Empty codebook")
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.subvector_id, []).append(r.c)
    return [np.array(out[k], np.float64) for k in sorted(out)]


def quantize(df: DataFrame, codebook: DataFrame, metric: str = "l2sq", vector: str = "embedding", to: str | None = None) -> DataFrame:
    """``df`` with ``<vector>_pq``: the nearest centre of each subvector, the lowest of equals; null of null."""
    to = to or f"{vector}_pq"
    centres = load_codebook(codebook)
    edges = np.cumsum([0, *(c.shape[1] for c in centres)])
    at = df.columns.index(vector)
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.ShortType()))])

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            x = matrix(column.filter(column.is_valid()), int(edges[-1]))
            codes = np.stack([nearest(x[:, a:b], c, metric) for a, b, c in zip(edges, edges[1:], centres)], 1).astype(np.int16)
            out: list = [None] * len(valid)
            for i, row in zip(np.flatnonzero(valid).tolist(), codes):
                out[i] = row
            yield [*batch.columns, pa.array(out, pa.list_(pa.int16()))]

    return map_arrays(df, run, schema)


def dequantize(df: DataFrame, codebook: DataFrame, codes: str = "embedding_pq", to: str = "vector") -> DataFrame:
    """``df`` with the concatenated centres of its codes; null of null; a wrong number of codes is an error."""
    centres = load_codebook(codebook)
    book = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in part]) for part in centres])
    wrong = F.raise_error(F.lit("Codebook has different subvector count")).cast("array<float>")
    whole = F.flatten(F.zip_with(to_codes(F.col(codes)), book, lambda code, part: F.element_at(part, code.cast("int") + 1))).cast("array<float>")
    return df.withColumn(to, F.when(F.col(codes).isNull(), F.lit(None).cast("array<float>")).when(F.size(codes) != len(centres), wrong).otherwise(whole))


def quantize_table(spark: SparkSession, table: str, vector: str, clusters: int, subvectors: int, metric: str = "l2sq", limit: int = TRAIN_ROWS) -> str:
    """Codebook table ``pq_<table>_<vector>`` and the column ``<vector>_pq`` in ``table``; returns the codebook's name."""
    name, df = f"pq_{table}_{vector}", spark.table(table)
    if len(name) > 63:
        raise ValueError("Codebook table name exceeds 63 characters")
    if f"{vector}_pq" in df.columns:
        raise ValueError(f"Column {vector}_pq already exists")
    create_codebook(df, clusters, subvectors, metric, vector, limit).write.mode("overwrite").saveAsTable(name)
    _replace(spark, table, quantize(df, spark.table(name), metric, vector))
    return name


def drop_quantization(spark: SparkSession, table: str, vector: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `pq_{table}_{vector}`")
    if f"{vector}_pq" in spark.table(table).columns:
        _replace(spark, table, spark.table(table).drop(f"{vector}_pq"))


def _replace(spark: SparkSession, table: str, df: DataFrame) -> None:
    """The table's rows by those of ``df``, which may read it: written beside it first."""
    df.write.mode("overwrite").saveAsTable(f"{table}__new")
    spark.sql(f"DROP TABLE `{table}`")
    spark.sql(f"ALTER TABLE `{table}__new` RENAME TO `{table}`")
