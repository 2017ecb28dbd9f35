"""Approximate nearest neighbours: an inverted file of cells with exact re-ranking.

A graph that grows row by row doesn't spread over a cluster. Here vectors are assigned to the nearest of
``nlist`` centres and stored by cell, so a search reads the files of the nearest cells only and ranks their
vectors exactly. How many cells that are is measured when the index is built: the fewest with which
``SAMPLE_QUERIES`` of its own rows find a share of ``RECALL`` of their true neighbours. ``ef``, the candidates
that a search looks at, raises or lowers that number in proportion. The centres are trained on a bounded sample
of ``train_rows``; every row is indexed.

All of an index is below its path: the cells, the centres, the options and the ids that were deleted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sextant.arrow import BROADCAST_ROWS, exists, map_arrays, matrix
from sextant.functions.distance import Metric, kernel
from sextant.functions.vectors import scalar_quantize
from sextant.operators import knn as exact
from sextant.operators.quantize import TRAIN_ROWS, lloyd, load_codebook, nearest, quantize
from sextant.session import ship

#: Cells at most: their centres are broadcast.
MAX_LISTS = 4096
#: Rows of a cell that a task of ``search_join`` takes at most.
CELL_ROWS = 65_536
#: Rows that are asked for when an index is built, their neighbours, and the share of these that must be found.
SAMPLE_QUERIES, SAMPLE_K, RECALL = 200, 10, 0.95
#: The ``ef`` at which as many cells are read as that takes.
DEFAULT_EF = 64


@dataclass(frozen=True)
class Options:
    metric: str = "l2sq"
    dim: int | None = None
    m: int = 16
    ef_construction: int = 128
    ef: int = 64
    quant_bits: int = 32
    pq: bool = False
    nlist: int | None = None
    train_rows: int = TRAIN_ROWS

    def __post_init__(self):
        Metric.of(self.metric)
        for name, low, high in (("m", 2, 128), ("ef_construction", 1, 400), ("ef", 1, 400)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")
        if self.dim is not None and not 1 <= self.dim <= exact.MAX_DIM:
            raise ValueError(f"dim must be between 1 and {exact.MAX_DIM}")
        if self.quant_bits not in (32, 16, 8, 1):
            raise ValueError("unimplemented quantization")


@dataclass
class Index:
    """Vectors by cell below ``path``, and their centres."""

    spark: SparkSession
    path: str
    options: Options
    centres: np.ndarray
    id: str = "vec_id"
    vector: str = "embedding"
    codebook: DataFrame | None = None
    probes: int = 1

    def deleted(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/deleted").distinct() if exists(self.spark, f"{self.path}/deleted") else None

    def table(self) -> DataFrame:
        df, gone = self.spark.read.parquet(f"{self.path}/cells"), self.deleted()
        return df if gone is None else df.join(gone, self.id, "left_anti").select(df.columns)

    def n_cells(self, ef: int | None = None) -> int:
        """How many cells a search with ``ef`` reads."""
        return max(1, min(len(self.centres), math.ceil(self.probes * (ef or self.options.ef) / DEFAULT_EF)))

    def cells_of(self, query: Sequence[float], ef: int | None = None) -> list[int]:
        d = kernel(self.options.metric)(self.centres, np.array(query, np.float64)[None])[:, 0]
        return np.argsort(d, kind="stable")[: self.n_cells(ef)].tolist()


def _assigned(df: DataFrame, centres: np.ndarray, metric: str, vector: str) -> DataFrame:
    at = df.columns.index(vector)
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            yield [*batch.columns, nearest(matrix(batch.column(at), shared.value.shape[1]), shared.value, metric).astype(np.int32)]

    return map_arrays(df, run, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())]))


def build(df: DataFrame, path: str, options: Options = Options(), id: str = "vec_id", vector: str = "embedding", where: Column | str | None = None, codebook: DataFrame | None = None) -> Index:
    """An index below ``path`` of the rows that satisfy ``where``; null vectors are left out.

    The dimension is that of ``options`` or of the vectors; another one raises ValueError. An empty table
    needs ``options.dim``. Centres are trained on ``train_rows`` rows at most, and 64 for each cell, chosen by hash.
    """
    df = (df.where(where) if where is not None else df).where(F.col(vector).isNotNull())
    sizes = df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    dim = options.dim or sizes.a
    if dim is None:
        raise ValueError("column does not have dimensions and can not be inferred from the first row")
    if sizes.n and (sizes.a != dim or sizes.b != dim):
        raise ValueError(f"Wrong number of dimensions: expected {dim}")
    if dim > exact.MAX_DIM:
        raise ValueError(f"dim must be between 1 and {exact.MAX_DIM}")
    if options.pq and codebook is None:
        raise ValueError("PQ index needs a codebook")
    lists = options.nlist or max(1, min(MAX_LISTS, round(math.sqrt(sizes.n))))
    wanted = min(options.train_rows, 64 * lists)
    share = max(1, sizes.n // max(1, 2 * wanted))  # a few more than wanted, so that no row but those is sorted
    vectors = df.select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(id).alias("h"))
    sample = vectors.where(F.pmod("h", F.lit(share)) == 0).orderBy("h").limit(wanted).select("v").toArrow().combine_chunks()
    x = matrix(sample.column("v").chunk(0)) if sample.num_rows else np.zeros((1, dim))
    centres = lloyd(x, min(lists, len(x)), options.metric, rounds=20, tolerance=1e-4)
    index = Index(df.sparkSession, path, options, centres, id, vector, codebook)
    insert(index, df, mode="overwrite")
    index.probes = _probes(index) if sizes.n else 1
    _save(index)
    return index


def _probes(index: Index) -> int:
    """The fewest cells with which a sample of rows find a share of RECALL of their neighbours, by brute force."""
    rows = index.spark.read.parquet(f"{index.path}/cells")
    asked = rows.select(F.col(index.id).alias("query_id"), index.vector).orderBy(F.xxhash64(index.id, F.lit(7)), index.id).limit(SAMPLE_QUERIES)
    asked = index.spark.createDataFrame(asked.toArrow())
    truth = exact.knn_join(asked, rows, SAMPLE_K, index.options.metric, query_vector=index.vector, vector=index.vector, id=index.id).select("query_id", index.id)
    cells = truth.join(rows.select(index.id, "cell"), index.id).join(asked, "query_id").select(F.col(index.vector).cast("array<double>").alias("v"), "cell").toArrow().combine_chunks()
    if not cells.num_rows:
        return 1
    d = kernel(index.options.metric)(matrix(cells.column("v").chunk(0)), index.centres)
    own = d[np.arange(len(d)), cells.column("cell").to_numpy()]
    needed = np.sort((d < own[:, None]).sum(1) + 1)
    return int(needed[math.ceil(RECALL * len(needed)) - 1])


def _save(index: Index) -> None:
    text = json.dumps({"options": asdict(index.options), "id": index.id, "vector": index.vector, "probes": index.probes})
    index.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{index.path}/options")
    index.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{index.path}/centres")
    if index.codebook is not None:
        index.codebook.write.mode("overwrite").parquet(f"{index.path}/codebook")


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that was built below ``path``, by any session."""
    said = json.loads(spark.read.text(f"{path}/options").first().value)
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
    codebook = spark.read.parquet(f"{path}/codebook") if exists(spark, f"{path}/codebook") else None
    return Index(spark, path, Options(**said["options"]), centres, said["id"], said["vector"], codebook, said["probes"])


def insert(index: Index, df: DataFrame, mode: str = "append") -> None:
    """More rows, each into the cell of its nearest centre."""
    o = index.options
    rows = _assigned(df.where(F.col(index.vector).isNotNull()), index.centres, o.metric, index.vector)
    if o.pq:
        rows = quantize(rows, index.codebook, o.metric, index.vector, "code")
    elif o.quant_bits != 32:
        rows = rows.withColumn("code", scalar_quantize(F.col(index.vector), o.quant_bits))
    rows.repartition("cell").write.mode(mode).partitionBy("cell").parquet(f"{index.path}/cells")


def delete(index: Index, ids: Sequence[int] | DataFrame) -> None:
    """Marks ids as deleted; ``vacuum`` takes their rows out."""
    kind = index.spark.read.parquet(f"{index.path}/cells").schema[index.id].dataType
    gone = ids.select(F.col(index.id).cast(kind)) if isinstance(ids, DataFrame) else index.spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField(index.id, kind)]))
    gone.write.mode("append").parquet(f"{index.path}/deleted")


def vacuum(index: Index, path: str) -> Index:
    """The index without deleted rows, below another path."""
    index.table().repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    new = Index(index.spark, path, index.options, index.centres, index.id, index.vector, index.codebook, index.probes)
    _save(new)
    return new


def search(index: Index, query: Sequence[float] | None, k: int = 10, ef: int | None = None, where: Column | str | None = None, rerank: int | None = None) -> DataFrame:
    """The ``k`` nearest of the rows in the nearest cells, with exact distances.

    Partitions of other cells aren't read. With codes, they choose ``rerank`` (10 k) rows first. If a filter
    leaves fewer than ``k`` rows in those cells, all cells are searched.
    """
    table = index.table()
    if query is None:
        return exact.knn(table, None, k, index.options.metric, index.vector, index.id)
    near = table.where(F.col("cell").isin(index.cells_of(query, ef)))
    if where is not None:
        near, table = near.where(where), table.where(where)
        if near.limit(k).count() < k:
            near = table
    o = index.options
    if o.pq:
        centres = load_codebook(index.codebook)
        edges = np.cumsum([0, *(c.shape[1] for c in centres)])
        costs = [kernel("l2sq" if o.metric == "l2sq" else o.metric)(c, np.array(query, np.float64)[None, a:b])[:, 0] for c, a, b in zip(centres, edges, edges[1:])]
        parts = [F.element_at(F.array(*[F.lit(float(v)) for v in cost]), F.element_at("code", i + 1).cast("int") + 1) for i, cost in enumerate(costs)]
        near = near.orderBy(sum(parts[1:], parts[0]), index.id).limit(rerank or 10 * k)
    elif o.quant_bits in (8, 1):
        coded = index.spark.range(1).select(scalar_quantize(F.array(*[F.lit(float(v)) for v in query]), o.quant_bits).alias("c")).first().c
        near = exact.knn(near, coded, rerank or (10 if o.quant_bits == 8 else 50) * k, "l2sq", "code", index.id, to="_code").drop("_code")
    return exact.knn(near, query, k, o.metric, index.vector, index.id).drop("cell", "code")


def search_join(index: Index, queries: DataFrame, k: int = 10, ef: int | None = None, where: Column | str | None = None, query_id: str = "query_id", query_vector: str = "embedding") -> DataFrame:
    """``query_id, id, dist, rank``: the ``k`` nearest rows in the nearest cells of each query; null vectors have none.

    Cells lie in groups of CELL_ROWS rows at most, and queries in blocks; a query goes once to each group that has some
    of its cells, and meets the rows of these. ``where`` chooses rows.
    """
    spark, o, probes = index.spark, index.options, index.n_cells(ef)
    ship(spark)
    table = index.table()
    rows = (table.where(where) if where is not None else table).select("cell", F.col(index.id).alias("i"), F.col(index.vector).alias("v"))
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(query_vector).alias("w"))
    first, parts, n_groups = _grouped({r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}, len(index.centres))
    ones = exact.blocks(asked.count(), exact.LARGER * BROADCAST_ROWS)
    shared = spark.sparkContext.broadcast((index.centres, first, parts))

    def choose(batches):
        for batch in batches:
            centres, first, parts = shared.value
            for a in range(0, batch.num_rows, 1024):
                names, w = batch.column(0).slice(a, 1024), batch.column(1).slice(a, 1024)
                d = kernel(o.metric)(matrix(w, centres.shape[1]), centres)
                cells = np.argsort(d, axis=1, kind="stable")[:, :probes]
                query, cell = np.repeat(np.arange(len(cells)), cells.shape[1]), cells.ravel()
                again = np.repeat(np.arange(len(cell)), parts[cell])
                nth = np.arange(len(again)) - np.repeat(np.cumsum(parts[cell]) - parts[cell], parts[cell])
                query, cell, group = query[again], cell[again], first[cell[again]] + nth
                order = np.lexsort((cell, group, query))
                query, cell, group = query[order], cell[order], group[order]
                starts = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (group[1:] != group[:-1])))
                at = pa.array(query[starts])
                yield [group[starts], names.take(at), w.take(at), pa.ListArray.from_arrays(pa.array(np.append(starts, len(cell)).astype(np.int32)), pa.array(cell.astype(np.int32)))]

    schema = T.StructType([T.StructField("b", T.LongType()), *asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    key = exact.spread(spark, ones * n_groups)
    of = lambda values: F.element_at(F.lit(values.tolist()).cast("array<int>"), F.col("cell") + 1)
    left = map_arrays(asked, choose, schema).select(key(F.pmod(F.xxhash64("q"), F.lit(ones)) * n_groups + F.col("b")).alias("g"), "q", "w", "cells")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(ones - 1)).cast("array<long>")).alias("a"), (of(first) + F.pmod(F.xxhash64("i"), of(parts))).alias("b"), "cell", "i", "v")
    right = right.select(key(F.col("a") * n_groups + F.col("b")).alias("g"), "cell", "i", "v")
    out = T.StructType([T.StructField(query_id, asked.schema["q"].dataType), T.StructField(index.id, rows.schema["i"].dataType), T.StructField("dist", T.DoubleType())])
    target = to_arrow_schema(out)

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.Table.from_batches([], target)
        one, two = one.combine_chunks(), two.combine_chunks()
        q, names, wanted = matrix(one.column("w").chunk(0)), one.column("q").chunk(0), one.column("cells").chunk(0)
        query, cell = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
        order = np.argsort(cell, kind="stable")
        query, cell = query[order], cell[order]
        two = two.take(pa.array(np.argsort(two.column("cell").to_numpy(), kind="stable"))).combine_chunks()
        cells, starts = np.unique(two.column("cell").to_numpy(), return_index=True)
        search = exact._Search(Metric.of(o.metric), q, k)
        for c, a, b in zip(cells, starts, [*starts[1:], two.num_rows]):
            chosen = query[slice(*np.searchsorted(cell, [c, c + 1]))]
            for s in range(a, b, 8192):
                n = min(8192, b - s)
                search.add(two.column("i").chunk(0).slice(s, n), matrix(two.column("v").chunk(0).slice(s, n), q.shape[1]), chosen)
        tables = [pa.Table.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, target)], schema=target) for columns in search.columns(names)]
        return pa.concat_tables(tables) if tables else pa.Table.from_batches([], target)

    met = left.repartition(ones * n_groups, "g").groupBy("g").cogroup(right.repartition(ones * n_groups, "g").groupBy("g")).applyInArrow(meet, out)
    return exact.ranked(met, k, query_id, index.id)


def _grouped(sizes: dict[int, int], n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each of ``n`` cells its first group and how many it has, and the number of groups.

    Small cells share a group of CELL_ROWS rows at most, or a sixth of all; a larger cell has several of its own.
    """
    most = max(1, min(CELL_ROWS, -(-sum(sizes.values()) // exact.BLOCKS)))
    first, parts, group, held = np.zeros(n, np.int64), np.ones(n, np.int64), 0, 0
    for c in range(n):
        size = sizes.get(c, 0)
        if held and held + size > most:
            group, held = group + 1, 0
        first[c] = group
        if size > CELL_ROWS:
            parts[c] = -(-size // CELL_ROWS)
            group += int(parts[c])
        else:
            held += size
    return first, parts, group + 1


def validate(index: Index) -> dict[str, int]:
    """Checks every row's cell and dimension; raises ValueError; returns counts."""
    table = index.table()
    again = _assigned(table.drop("cell"), index.centres, index.options.metric, index.vector).select(F.col(index.id).alias("i"), F.col("cell").alias("right"))
    wrong = table.join(again, table[index.id] == F.col("i")).where("cell <> right").count()
    if wrong:
        raise ValueError(f"{wrong} rows are in the wrong cell")
    return {"rows": table.count(), "cells": table.select("cell").distinct().count(), "deleted": 0 if (gone := index.deleted()) is None else gone.count()}


def expected_visits(index: Index, rows: int, ef: int | None = None) -> float:
    """Vectors that a search is expected to look at: what decides whether an exact scan is as cheap."""
    return len(index.centres) + rows * index.n_cells(ef) / len(index.centres)


def memory_bytes(rows: int, dim: int, options: Options = Options()) -> int:
    """Bytes of the index: vectors at their width, and links as a graph of ``m`` would have."""
    return rows * (dim * options.quant_bits // 8 + options.m * 2 * 4 + 16)
