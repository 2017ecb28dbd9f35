"""A training corpus from ``documents``: toxicity, line dedup, near-dedup, decontamination, tokens.

Every stage gets the rows that its predecessor kept, written as Parquet and read again. All but the last
return the columns of ``documents``; where a stage changes ``text``, ``n_chars`` follows it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from sextant.llm.common import discard, read, shared_dir

#: SQL can't express the classifier, the template tree, MinHash, spaced seeds or the merges.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; it is trained on the labelled ones. Rows without an id are judged, too."""
    return toxicity.clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without recurring lines, and without the documents that had nothing else but white space."""
    found = line_dedup.drop_lines(docs).where(r"n_dropped = 0 or text rlike '(?U)\\S'")
    return found.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that overlap with a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, tokens, n_tokens, lossless``: token ids, their number, whether decoding gives the text back."""
    return bpe.tokenized(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each gives is written to the folder that the executors share, until the next one has read it."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return docs
