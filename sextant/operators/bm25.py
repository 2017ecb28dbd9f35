"""BM25: an inverted index in long form, search and scoring.

The index has a row for each term and document (``term, doc_id, fq, doc_len``), so that a common term's
postings are many rows and not one that must fit in memory; ``packed`` gives the form with one row a term.

It is stored as Parquet, sorted by term, so that a search's terms are pushed down and only the row groups that
may have them are read; their document frequencies are stored beside it, and the corpus's numbers.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.arrow import map_arrays, shared_dir
from sextant.functions import bloom

K1, B, THRESHOLD = 1.2, 0.75, 8000
#: Postings of one term that are shuffled in one row at most; words that are counted at once, about.
RUN, SLICE_WORDS = 128, 1 << 20


@dataclass(frozen=True)
class Parameters:
    k1: float = K1
    b: float = B
    threshold: int = THRESHOLD

    def __post_init__(self):
        if not 1 <= self.k1 <= 3 or not 0 <= self.b <= 1 or not 5000 <= self.threshold <= 100_000:
            raise ValueError("k1 must be in 1..3, b in 0..1, threshold in 5000..100000")


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, doc_id, fq, doc_len
    terms: DataFrame  # term, df
    n_docs: int
    avg_len: float
    runs: DataFrame | None = None  # term, ids, fqs, lens: postings that lie together, of an index that isn't stored


def build(df: DataFrame, id: str = "doc_id", tokens: str = "tokens", write: bool = True, path: str | None = None) -> Index:
    """Index of a column of token arrays, below ``path`` or in a folder of its own. Null arrays count as documents without words; the mean length has two decimals."""
    spark = df.sparkSession
    docs = df.select(F.col(id).alias("doc_id"), F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("t"))
    runs = _runs(docs)
    p = runs.select("term", F.explode(F.arrays_zip("ids", "fqs", "lens")).alias("p"))
    postings = p.select("term", F.col("p.ids").alias("doc_id"), F.col("p.fqs").alias("fq"), F.col("p.lens").alias("doc_len"))
    if not write:
        stats = docs.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size("t")) * 100).alias("a")).first()
        return Index(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats.n, (stats.a or 0.0) / 100, runs)
    path = path or f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}"
    # ranges of term and document: a term of very many documents is spread over several files; runs are shuffled, as each has its term once
    ranged = runs.repartitionByRange("term", F.col("ids")[0]).select("term", F.explode(F.arrays_zip("ids", "fqs", "lens")).alias("p"))
    ranged = ranged.select("term", F.col("p.ids").alias("doc_id"), F.col("p.fqs").alias("fq"), F.col("p.lens").alias("doc_len"))
    ranged.sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    # the words of all documents are those of the postings
    n, words = docs.count(), stored.agg(F.sum("fq")).first()[0] or 0
    mean = spark.range(1).select(F.round(F.lit(words / n if n else 0.0) * 100)).first()[0]
    spark.createDataFrame([(n, mean / 100)], "n_docs long, avg_len double").coalesce(1).write.parquet(f"{path}/stats")
    return open_index(spark, path)


def _runs(docs: DataFrame) -> DataFrame:
    """``term, ids, fqs, lens``: postings by term, RUN of them in a row at most.

    Words are counted within their document, without a shuffle; only where an id has several rows, their words are
    brought together first.
    """
    ids = docs.select("doc_id")
    if ids.distinct().count() < ids.count():
        long = docs.select("doc_id", F.size("t").alias("doc_len"), F.explode("t").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("fq"), F.first("doc_len").alias("doc_len"))
        return long.select("term", F.array("doc_id").alias("ids"), F.array("fq").alias("fqs"), F.array("doc_len").alias("lens"))
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("fqs", T.ArrayType(T.IntegerType())), T.StructField("lens", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            ends, a = np.concatenate([[0], np.cumsum(lengths)]), 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_WORDS, "right")) - 1)
                if ends[b] > ends[a]:
                    yield _count(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lengths[a:b])
                a = b

    return map_arrays(docs, run, schema)


def _count(ids: pa.Array, lists: pa.Array, lengths: np.ndarray) -> list:
    words = lists.flatten().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(ids).to_numpy()
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    pairs, fqs = np.unique(words.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(place, lengths), return_counts=True)
    term, row = pairs // len(ids), order[pairs % len(ids)]
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    nth = np.arange(len(term)) - np.repeat(starts, np.diff(np.append(starts, len(term))))
    starts = np.flatnonzero(nth % RUN == 0)
    edges = pa.array(np.append(starts, len(term)).astype(np.int32))
    columns = (ids.take(pa.array(row)), pa.array(fqs.astype(np.int32)), pa.array(lengths[row].astype(np.int32)))
    return [words.dictionary.take(pa.array(term[starts])), *[pa.ListArray.from_arrays(edges, c) for c in columns]]


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that was built below ``path``, by any session."""
    stats = spark.read.parquet(f"{path}/stats").first()
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), stats.n_docs, stats.avg_len)


def packed(index: Index, threshold: int = THRESHOLD) -> DataFrame:
    """One row a term, documents in order of id; terms of more than ``threshold`` documents have a Bloom filter of them."""
    runs = index.runs if index.runs is not None else index.postings.select("term", F.array("doc_id").alias("ids"), F.array("fq").alias("fqs"), F.array("doc_len").alias("lens"))
    lists = _merged(runs)
    out = lists.select("term", F.size("p").alias("term_freq"), F.size("p").alias("doc_ids_len"), F.col("p.doc_id").alias("doc_ids"), F.col("p.fq").alias("fqs"), F.col("p.doc_len").alias("doc_lens"))
    return out.withColumn("doc_ids_bloom", bloom.array_to_bloom(F.when(F.col("doc_ids_len") > threshold, F.col("doc_ids"))))


def _merged(runs: DataFrame) -> DataFrame:
    """``term, p``: all postings of a term in order. The arrays are shuffled as they are, and zipped where they meet."""
    met = runs.groupBy("term").agg(F.collect_list(F.struct("ids", "fqs", "lens")).alias("r"))
    each = F.flatten(F.transform("r", lambda x: F.arrays_zip(x["ids"], x["fqs"], x["lens"])))
    each = F.transform(each, lambda x: F.struct(x["ids"].alias("doc_id"), x["fqs"].alias("fq"), x["lens"].alias("doc_len")))
    return met.select("term", F.sort_array(each).alias("p"))


def unpack(df: DataFrame) -> DataFrame:
    """Long form of ``packed`` rows; rows of one term may be several."""
    p = df.select("term", F.explode(F.arrays_zip("doc_ids", "fqs", "doc_lens")).alias("p"))
    return p.select("term", F.col("p.doc_ids").alias("doc_id"), F.col("p.fqs").alias("fq"), F.col("p.doc_lens").alias("doc_len"))


def consolidate(parts: DataFrame) -> DataFrame:
    """Packed rows of the same term as one row."""
    lists = _merged(parts.select("term", F.col("doc_ids").alias("ids"), "fqs", F.col("doc_lens").alias("lens")))
    return lists.select("term", F.size("p").alias("term_freq"), F.size("p").alias("doc_ids_len"), F.col("p.doc_id").alias("doc_ids"), F.col("p.fq").alias("fqs"), F.col("p.doc_len").alias("doc_lens"))


def kernel(fq: Column, doc_len: Column, df: Column, n: float, avg_len: float, k1: float = K1, b: float = B) -> Column:
    """A term's share of a document's score."""
    idf = F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1)
    return idf * (fq * (k1 + 1)) / (fq + k1 * (1 - b + b * doc_len / F.lit(float(avg_len) or 1.0)))


def aggregate(rows: DataFrame, limit: int | None, n: int, avg_len: float, k1: float = K1, b: float = B) -> DataFrame:
    """``doc_id, bm25`` of postings with ``df``: sums, the best ``limit`` first, ties by doc_id; None: all."""
    if limit is not None and limit < 0 or n <= 0 or not avg_len >= 0:
        raise ValueError("limit must not be negative, n must be positive, avg_len a number from 0 up")
    scored = rows.groupBy("doc_id").agg(F.sum(kernel(F.col("fq"), F.col("doc_len"), F.col("df"), n, avg_len, k1, b)).alias("bm25")).orderBy(F.desc(F.round("bm25", 6)), "doc_id")
    return scored if limit is None else scored.limit(limit)


def search(index: Index, query: list[str], limit: int | None = 10, k1: float = K1, b: float = B, approx: int | None = None, content: DataFrame | None = None, content_id: str = "doc_id", parameters: Parameters | None = None) -> DataFrame:
    """The best documents for the query's terms; each counts once. ``content``'s columns are joined by its id.

    With ``approx``, terms of more documents than that count as if they occurred once in a document of mean
    length, so that their long postings' frequencies needn't be read. ``parameters`` stand for k1, b and approx.
    """
    if parameters is not None:
        k1, b, approx = parameters.k1, parameters.b, parameters.threshold
    terms = sorted({t for t in query if t is not None})
    if index.n_docs == 0 or not terms:
        return index.postings.select("doc_id", F.lit(0.0).alias("bm25")).limit(0)
    own = index.postings.where(F.col("term").isin(terms))
    found = own.join(F.broadcast(index.terms.where(F.col("term").isin(terms))), "term")  # as many rows as the query has terms
    if approx is not None:
        common = F.col("df") > approx
        found = found.withColumn("fq", F.when(common, F.least("fq", F.lit(1))).otherwise(F.col("fq"))).withColumn("doc_len", F.when(common, F.lit(index.avg_len)).otherwise(F.col("doc_len")))
    best = aggregate(found, limit, index.n_docs, index.avg_len, k1, b)
    if content is None:
        return best
    return best.join(content, best["doc_id"] == content[content_id], "left").drop(content[content_id]).orderBy(F.desc(F.round("bm25", 6)), "doc_id")


def _equals(term: str):
    return lambda x: x == F.lit(term)


def score(index: Index, documents: DataFrame, query: list[str], tokens: str = "tokens", k1: float = K1, b: float = B, threshold: int = THRESHOLD) -> DataFrame:
    """``documents`` with ``bm25``, by the index's statistics; query terms that it lacks count nothing."""
    terms = index.terms.where(F.col("term").isin(sorted(set(query)))).collect()
    length = F.size(F.col(tokens))
    total = F.lit(0.0)
    for row in terms:
        fq = F.size(F.filter(F.col(tokens), _equals(row.term))).cast("double")
        common = row.df > threshold
        part = kernel(F.least(fq, F.lit(1.0)) if common else fq, F.lit(index.avg_len) if common else length, F.lit(float(row.df)), index.n_docs, index.avg_len, k1, b)
        total = total + F.when(fq > 0, part).otherwise(0.0)
    return documents.withColumn("bm25", F.when(F.col(tokens).isNotNull(), total))
