"""Exact nearest neighbours: by one query, by many, within a distance, by weighted vectors; recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sextant.arrow import BROADCAST_ROWS, map_arrays, matrix
from sextant.functions.distance import Metric, distance, kernel, literal
from sextant.session import ship

MAX_DIM = 2000


def _place(df: DataFrame, name: str) -> int:
    return df.columns.index(name)


def with_distance(df: DataFrame, query: Sequence[float] | Column, metric: str = "l2sq", vector: str = "embedding", to: str = "dist") -> DataFrame:
    """``df`` with the distance from ``query`` as an expression; null vectors have a null distance."""
    query = query if isinstance(query, Column) else literal(query)
    return df.withColumn(to, distance(metric, F.col(vector), query))


def knn(df: DataFrame, query: Sequence[float] | None, k: int, metric: str = "l2sq", vector: str = "embedding", id: str = "vec_id", where: Column | str | None = None, to: str = "dist") -> DataFrame:
    """The ``k`` rows nearest to ``query`` of those that satisfy ``where``, nearest first, ties by ``id``.

    Rows with a null vector, or one whose distance isn't a finite number, are no candidates, and a null query has no neighbours. Distances are computed by
    whole Arrow batches and each task passes on its own ``k`` best rows only.
    """
    metric = Metric.of(metric)
    df = df.where(where) if where is not None else df
    schema = T.StructType([*df.drop(to).schema.fields, T.StructField(to, T.DoubleType())])
    df = df.drop(to)
    if query is None or k <= 0:
        return df.limit(0).withColumn(to, F.lit(None).cast("double"))
    q = np.array(query, np.float64)[None, :]
    at, ids = _place(df, vector), _place(df, id)

    def run(batches):
        best: pa.Table | None = None
        for batch in batches:
            d = kernel(metric)(matrix(batch.column(at), q.shape[1]), q)[:, 0]
            table = pa.Table.from_arrays([*batch.columns, pa.array(d)], names=[str(i) for i in range(batch.num_columns + 1)])
            d = np.where(np.isfinite(d), d, np.inf)
            keep = np.flatnonzero(np.isfinite(d) & (d <= np.partition(d, k - 1)[k - 1] if len(d) > k else True))
            table = table.take(pa.array(keep))
            best = table if best is None else pa.concat_tables([best, table])
            if best.num_rows > 2 * k:
                best = best.sort_by([(str(batch.num_columns), "ascending"), (str(ids), "ascending")]).slice(0, k)
        if best is not None:
            for batch in best.combine_chunks().to_batches():
                yield list(batch.columns)

    found = map_arrays(df.where(F.col(vector).isNotNull()), run, schema)
    return found.orderBy(to, id).limit(k)


def range_search(df: DataFrame, query: Sequence[float], max_dist: float, metric: str = "l2sq", vector: str = "embedding", id: str = "vec_id", to: str = "dist") -> DataFrame:
    """All rows whose distance from ``query`` is less than ``max_dist``, nearest first."""
    return with_distance(df.where(F.col(vector).isNotNull()), query, metric, vector, to).where(F.col(to) < max_dist).orderBy(to, id)


#: Distances that are in memory at once, about; the rows and queries of a block are taken in tiles of this size.
TILE = 1 << 20
#: Queries of a tile at most.
TILE_QUERIES = 1024


class _Best:
    """The ``k`` nearest rows of each of ``n`` queries, of blocks of rows that come one after another; ties by id.

    Rows that may be among them are kept until there are as many again as the k best of all, then ranked.
    """

    def __init__(self, k: int, n: int):
        self.k, self.n, self.edge = k, n, np.full(n, np.inf)
        self.q, self.row, self.d = [], [], []
        self.ids: list[pa.Array] = []
        self.rows = self.held = self.kept = 0

    def put(self, ids: pa.Array, row: np.ndarray, q: np.ndarray, d: np.ndarray) -> None:
        """Rows of ``ids`` and their distances from queries; of each query, all that may be among its k best."""
        if not len(row):
            return
        used, back = np.unique(row, return_inverse=True)
        self.q.append(q.astype(np.int64))
        self.row.append(back + self.rows)
        self.d.append(d)
        self.ids.append(ids.take(pa.array(used)))
        self.rows += len(used)
        self.held += len(row)
        if self.held > 2 * self.kept + self.k * self.n:
            self.rank()

    def rank(self) -> None:
        if not self.held:
            return
        q, row, d, ids = np.concatenate(self.q), np.concatenate(self.row), np.concatenate(self.d), pa.concat_arrays(self.ids)
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place[row], d, q))
        q, row, d = q[order], row[order], d[order]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        last = place == self.k - 1
        self.edge[q[last]] = np.minimum(self.edge[q[last]], d[last])
        keep = place < self.k
        used, back = np.unique(row[keep], return_inverse=True)
        self.q, self.row, self.d, self.ids = [q[keep]], [back], [d[keep]], [ids.take(pa.array(used))]
        self.rows, self.held = len(used), int(keep.sum())
        self.kept = self.held

    def columns(self, names: pa.Array) -> list | None:
        self.rank()
        return [names.take(pa.array(self.q[0])), self.ids[0].take(pa.array(self.row[0])), self.d[0]] if self.held else None


class _Search:
    """The ``k`` nearest of blocks of rows for every query, in tiles of bounded memory.

    Where a distance is a product of matrices, 32-bit ones find the rows that may be near enough, with a margin for
    their error; only these rows' distances are computed in 64 bits, each by itself, so that equal vectors have equal ones.
    """

    def __init__(self, metric: Metric, q: np.ndarray, k: int):
        self.metric, self.k, self.queries = metric, k, q
        self.parts = [_Best(k, len(q[a : a + TILE_QUERIES])) for a in range(0, len(q), TILE_QUERIES)]
        self.norms = np.sqrt((q * q).sum(1))
        self.fast = metric is not Metric.HAMMING and _plain(self.norms)
        self.left = self._laid(q, self.norms, -1 if metric is Metric.COS else -2).T if self.fast else None

    def _laid(self, x: np.ndarray, norms: np.ndarray, by: int) -> np.ndarray:
        """32-bit rows, those of queries times ``by``, and two more columns: with them a product of rows is the distance."""
        if self.metric is Metric.COS:
            x, ones, more = x / np.where(norms > 0, norms, 1)[:, None], np.ones(len(x)), np.zeros(len(x))
        else:
            ones, more = np.ones(len(x)), norms * norms
        return np.column_stack([x * by, ones, more] if by < 0 else [x, more if self.metric is not Metric.COS else ones, ones]).astype(np.float32)

    def add(self, ids: pa.Array, x: np.ndarray, chosen: np.ndarray | None = None) -> None:
        """``chosen``: the queries that the rows are for, in order; without it, all."""
        step = max(1, TILE // max(1, min(TILE_QUERIES, len(self.queries))))
        for a in range(0, len(x), step):
            rows, own = x[a : a + step], ids.slice(a, step)
            norms = np.sqrt((rows * rows).sum(1))
            right = self._laid(rows, norms, 1) if self.fast and _plain(norms) else None
            for i, best in enumerate(self.parts):
                if chosen is None:
                    self._tile(best, own, rows, norms, right, np.arange(best.n), i * TILE_QUERIES)
                else:
                    start, end = np.searchsorted(chosen, [i * TILE_QUERIES, (i + 1) * TILE_QUERIES])
                    if start < end:
                        self._tile(best, own, rows, norms, right, chosen[start:end] - i * TILE_QUERIES, i * TILE_QUERIES)

    def _tile(self, best: _Best, ids: pa.Array, x: np.ndarray, norms: np.ndarray, right: np.ndarray | None, at: np.ndarray, base: int) -> None:
        whole = len(at) == best.n
        own = slice(base, base + best.n) if whole else at + base
        q = self.queries[own]
        if right is None:
            d, margin = kernel(self.metric)(x, q), np.zeros(len(q))
            d[~np.isfinite(d)] = np.inf
        else:
            d = right @ self.left[:, own]
            # the error of a 32-bit product of n terms is at most n + 3 units of the product of the norms
            unit, qn = 8 * (x.shape[1] + 8) * 2.0**-24, self.norms[own]
            if self.metric is Metric.COS:
                if (norms == 0).any() and (qn == 0).any():
                    d[np.ix_(norms == 0, qn == 0)] = 0
                margin = np.full(len(q), unit)
            else:
                margin = unit * (norms.max(initial=0) + qn) ** 2 + 1e-36
        edge = best.edge[at]
        if len(d) > self.k and not np.isfinite(edge).all():
            edge = np.minimum(edge, np.partition(d, self.k - 1, axis=0)[self.k - 1] + margin)
            best.edge[at] = edge
        limit = edge + margin
        if right is not None:  # as a 32-bit number, a little above
            limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        row, of = np.divmod(np.flatnonzero(d <= limit[None, :]), len(at))
        exact = d[row, of] if right is None else _each(self.metric, x, q, row, of)
        keep = np.isfinite(exact) & (exact <= edge[of])
        best.put(ids, row[keep], at[of[keep]], exact[keep])

    def columns(self, names: pa.Array) -> Iterator[list]:
        for i, best in enumerate(self.parts):
            if (found := best.columns(names.slice(i * TILE_QUERIES, best.n))) is not None:
                yield found


def _plain(norms: np.ndarray) -> bool:
    """Whether 32-bit numbers hold the squares."""
    return bool((np.isfinite(norms) & (norms < 1e15) & ((norms == 0) | (norms > 1e-15))).all())


def _each(metric: Metric, x: np.ndarray, q: np.ndarray, row: np.ndarray, of: np.ndarray) -> np.ndarray:
    """64-bit distances of pairs of rows, each summed in the order of its elements."""
    out = np.empty(len(row))
    step = max(1, TILE // max(1, x.shape[1]))
    ordered = lambda v: np.add.accumulate(v, axis=1)[:, -1] if v.shape[1] else np.zeros(len(v))
    if metric is Metric.COS:
        nx, nq = np.sqrt(ordered(x * x)), np.sqrt(ordered(q * q))
    for a in range(0, len(row), step):
        r, o = row[a : a + step], of[a : a + step]
        if metric is Metric.COS:
            product = nx[r] * nq[o]
            d = np.maximum(1 - ordered(x[r] * q[o]) / np.where(product > 0, product, 1), 0)
            out[a : a + step] = np.where(product > 0, d, np.where((nx[r] == 0) & (nq[o] == 0), 0.0, 1.0))
        else:
            diff = x[r] - q[o]
            out[a : a + step] = ordered(diff * diff)
    return out


def _within(names: pa.Array, q: np.ndarray, ids: pa.Array, x: np.ndarray, metric: Metric, max_dist: float):
    for a in range(0, len(x), 1000):
        d = kernel(metric)(x[a : a + 1000], q)
        row, of = np.nonzero(d < max_dist)
        yield [names.take(pa.array(of)), ids.take(pa.array(row + a)), d[row, of]]


#: A block of queries that are shuffled is larger by this than one that is broadcast: the fewer blocks, the less often the rows are sent.
LARGER = 5
#: Blocks of a large side at least, so that there are tasks for all cores; rows of such a block at least.
BLOCKS, BLOCK_ROWS = 6, 1000


def blocks(n: int, most: int) -> int:
    """Of ``n`` rows, each of ``most`` rows at most, about."""
    return max(1, -(-n // most), min(BLOCKS, n // BLOCK_ROWS))


def spread(spark, n: int) -> Callable[[Column], Column]:
    """A key for each number below ``n``: ``repartition`` by it into ``n`` parts gives each number a part of its own."""
    rows = spark.range(n * 40).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).collect()
    keys = {r.p: r.id for r in rows}
    found = F.lit([keys.get(i, i) for i in range(n)]).cast("array<long>")
    return lambda number: F.element_at(found, (number + 1).cast("int"))


def _against(queries: DataFrame, df: DataFrame, query_id: str, query_vector: str, vector: str, id: str, chunk: int, block: int, compare) -> DataFrame:
    """``query_id, id, dist`` of what ``compare(names, queries, batches)`` finds.

    Up to ``chunk`` queries are broadcast and ``df`` isn't shuffled. More are split, like ``df``, in blocks by
    hash; each pair of blocks meets in a task of its own.
    """
    spark = df.sparkSession
    ship(spark)
    wanted = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"))
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(id, df.schema[id].dataType), T.StructField("dist", T.DoubleType())])
    base = df.where(F.col(vector).isNotNull()).select(F.col(id).alias("_id"), F.col(vector).alias("_v"))
    n = wanted.count()
    if n <= chunk:
        table = wanted.toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((table.column("q").chunk(0), matrix(table.column("v").chunk(0))) if n else None)

        def run(batches):
            if shared.value is not None:
                names, q = shared.value
                yield from compare(names, q, ((b.column(0), matrix(b.column(1), q.shape[1])) for b in batches))

        return map_arrays(base, run, schema)
    ones, twos = blocks(n, LARGER * chunk), blocks(base.count(), block)
    key = spread(spark, ones * twos)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    left = wanted.select(F.pmod(F.xxhash64("q"), F.lit(ones)).alias("a"), every(twos).alias("b"), "q", "v").select(key(F.col("a") * twos + F.col("b")).alias("g"), "q", "v")
    right = base.select(every(ones).alias("a"), F.pmod(F.xxhash64("_id"), F.lit(twos)).alias("b"), "_id", "_v").select(key(F.col("a") * twos + F.col("b")).alias("g"), "_id", "_v")
    target = to_arrow_schema(schema)

    def pair(one: pa.Table, two: pa.Table) -> pa.Table:
        one, two = one.combine_chunks(), two.combine_chunks()
        found = []
        if one.num_rows and two.num_rows:
            q = matrix(one.column("v").chunk(0))
            batches = ((b.column("_id"), matrix(b.column("_v"), q.shape[1])) for b in two.to_batches(max_chunksize=10_000))
            found = [pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, target)], schema=target) for columns in compare(one.column("q").chunk(0), q, batches)]
        return pa.Table.from_batches(found, target)

    return left.repartition(ones * twos, "g").groupBy("g").cogroup(right.repartition(ones * twos, "g").groupBy("g")).applyInArrow(pair, schema)


def knn_join(queries: DataFrame, df: DataFrame, k: int, metric: str = "l2sq", query_id: str = "query_id", query_vector: str = "embedding", vector: str = "embedding", id: str = "vec_id", chunk: int = BROADCAST_ROWS, block: int = 100_000) -> DataFrame:
    """``query_id, id, dist, rank`` of the ``k`` nearest rows of ``df`` for every query, ties by ``id``.

    Null vectors, and those whose distance isn't a finite number, take no part. A task passes on its k best for
    each query, so the shuffle that ranks them doesn't grow with ``df``'s rows.
    """
    metric = Metric.of(metric)

    def compare(names, q, batches):
        search = _Search(metric, q, k)
        for ids, x in batches:
            search.add(ids, x)
        yield from search.columns(names)

    return ranked(_against(queries, df, query_id, query_vector, vector, id, chunk, block, compare), k, query_id, id)


def ranked(found: DataFrame, k: int, query_id: str = "query_id", id: str = "vec_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy("dist", id))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def range_join(queries: DataFrame, df: DataFrame, max_dist: float, metric: str = "l2sq", query_id: str = "query_id", query_vector: str = "embedding", vector: str = "embedding", id: str = "vec_id", chunk: int = BROADCAST_ROWS, block: int = 100_000) -> DataFrame:
    """``query_id, id, dist`` of all rows of ``df`` whose distance from a query is less than ``max_dist``; null vectors take no part."""
    metric = Metric.of(metric)

    def compare(names, q, batches):
        for ids, x in batches:
            yield from _within(names, q, ids, x, metric, max_dist)

    return _against(queries, df, query_id, query_vector, vector, id, chunk, block, compare)


def _weigh(best: _Best, ids: pa.Array, x: np.ndarray, q: np.ndarray, weights: np.ndarray, metric: Metric, max_dist: float | None) -> None:
    """``q``: by query and weight. What may be near enough is computed again, each pair by itself, so that equal vectors have equal sums."""
    n, many = q.shape[:2]
    d = (kernel(metric)(x, q.reshape(n * many, -1)).reshape(len(x), n, many) * weights).sum(2)
    d[~np.isfinite(d)] = np.inf
    scale = np.abs(weights).sum() * (1 if metric is Metric.COS else (np.sqrt((x * x).sum(1).max(initial=0)) + np.sqrt((q * q).sum(2).max(initial=0))) ** 2)
    margin = 0.0 if metric is Metric.HAMMING else scale * (x.shape[1] + 8) * 2.0**-50
    if max_dist is not None:
        d[d > max_dist + margin] = np.inf
    if len(d) > best.k and not np.isfinite(best.edge).all():
        best.edge = np.minimum(best.edge, np.partition(d, best.k - 1, axis=0)[best.k - 1] + margin)
    row, of = np.divmod(np.flatnonzero((d <= best.edge + margin) & np.isfinite(d)), n)
    exact = d[row, of] if metric is Metric.HAMMING else sum(w * _each(metric, x, q[:, i], row, of) for i, w in enumerate(weights))
    keep = np.isfinite(exact) & (exact <= best.edge[of]) & (exact < max_dist if max_dist is not None else True)
    best.put(ids, row[keep], of[keep], exact[keep])


def weighted_join(queries: DataFrame, df: DataFrame, weights: Sequence[float], k: int, metric: str = "cos", query_id: str = "query_id", query_vectors: str = "vectors", vector: str = "embedding", id: str = "vec_id", ef: int | None = None, max_dist: float | None = None) -> DataFrame:
    """``query_id, id, dist, rank`` of the ``k`` rows with the least weighted sum of distances from the vectors of each query (an array of them).

    Exact without ``ef``; with it, the candidates are the ``ef`` rows nearest to each of the vectors.
    """
    metric, weights = Metric.of(metric), np.array(weights, float)
    many = len(weights)
    flat = queries.select(query_id, F.flatten(F.transform(query_vectors, lambda v: v.cast("array<double>"))).alias("_q"))

    def compare(names, q, batches):
        q = q.reshape(len(q), many, -1)
        step = max(1, TILE_QUERIES // many)
        parts = [(_Best(k, len(q[a : a + step])), q[a : a + step], names.slice(a, step)) for a in range(0, len(q), step)]
        for ids, x in batches:
            x = x[:, : q.shape[2]]
            for a in range(0, len(x), TILE // TILE_QUERIES):
                rows, own = x[a : a + TILE // TILE_QUERIES], ids.slice(a, TILE // TILE_QUERIES)
                for best, asked, _ in parts:
                    _weigh(best, own, rows, asked, weights, metric, max_dist)
        for best, _, of in parts:
            if (found := best.columns(of)) is not None:
                yield found

    if ef is None:
        wide = df.withColumn(vector, F.flatten(F.array_repeat(F.col(vector).cast("array<double>"), many)))  # as long as the queries, which are laid end to end
        return ranked(_against(flat, wide, query_id, "_q", vector, id, BROADCAST_ROWS, 100_000, compare), k, query_id, id)
    near = None
    for i in range(many):
        one = knn_join(queries.select(query_id, F.col(query_vectors)[i].alias("_q")), df, ef, metric, query_id, "_q", vector, id).select(query_id, id)
        near = one if near is None else near.unionByName(one)
    full = near.distinct().join(df.select(id, F.col(vector).alias("_v")), id).join(queries.select(query_id, F.col(query_vectors).alias("_qs")), query_id)
    total = sum(F.lit(float(w)) * distance(metric, F.col("_v"), F.col("_qs")[i]) for i, w in enumerate(weights))
    found = full.select(query_id, id, total.alias("dist"))
    return ranked(found if max_dist is None else found.where(F.col("dist") < max_dist), k, query_id, id)


def pages(df: DataFrame, query: Sequence[float], size: int, metric: str = "l2sq", vector: str = "embedding", id: str = "vec_id") -> Iterator[DataFrame]:
    """The rows by distance, ``size`` at a time, for as long as there are more: each page starts behind the last row of the one before."""
    last = None
    while True:
        rows = with_distance(df.where(F.col(vector).isNotNull()), query, metric, vector)
        rows = rows if last is None else rows.where((F.col("dist") > last.dist) | (F.col("dist") == last.dist) & (F.col(id) > last[id]))
        page = rows.orderBy("dist", id).limit(size)
        ends = page.select("dist", id).collect()
        if not ends:
            return
        last = ends[-1]
        yield page


def _joint(vectors: Sequence[tuple[float, str, Sequence[float]]], metric: str) -> Column:
    parts = [F.lit(float(w)) * distance(metric, F.col(c), literal(v)) for w, c, v in vectors]
    return sum(parts[1:], parts[0])


def weighted_search(df: DataFrame, vectors: Sequence[tuple[float, str, Sequence[float]]], metric: str = "l2sq", id: str = "vec_id", ef: int = 100, max_dist: float | None = None, exact: bool = False, to: str = "dist") -> DataFrame:
    """Rows by the weighted sum of distances; ``vectors`` has up to three of (weight, column, query).

    Exact: all rows. Otherwise the candidates are the ``ef`` nearest by each column alone, once each. Rows
    with a null vector are left out; ``max_dist`` is a strict bound.
    """
    if not 1 <= len(vectors) <= 3:
        raise ValueError("one to three vectors are needed")
    df = df.where(" and ".join(f"`{c}` is not null" for _, c, _ in vectors))
    if not exact:
        found = None
        for _, column, query in vectors:
            near = knn(df, query, ef, metric, column, id, to="_near").drop("_near")
            found = near if found is None else found.unionByName(near)
        df = found.dropDuplicates([id])
    df = df.withColumn(to, _joint(vectors, metric))
    return (df if max_dist is None else df.where(F.col(to) < max_dist)).orderBy(to, id)


def weighted_search_l2sq(df: DataFrame, vectors, **options) -> DataFrame:
    return weighted_search(df, vectors, "l2sq", **options)


def weighted_search_cos(df: DataFrame, vectors, **options) -> DataFrame:
    return weighted_search(df, vectors, "cos", **options)


def recall(truth: DataFrame, found: DataFrame, k: int, query_id: str = "query_id", id: str = "vec_id", decimals: int = 2) -> DataFrame:
    """One row, ``recall``: the mean share over the queries of ``truth`` of its ids that ``found`` has; no queries, null."""
    t = truth.groupBy(query_id).agg(F.collect_set(id).alias("t"))
    f = found.groupBy(query_id).agg(F.collect_set(id).alias("f"))
    share = F.size(F.array_intersect("t", F.coalesce("f", F.array().cast(t.schema["t"].dataType)))) / F.lit(k)
    return t.join(f, query_id, "left").agg(F.round(F.avg(share), decimals).alias("recall"))
