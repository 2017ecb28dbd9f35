"""Queries of this subpackage: each applies one operator to its whole table and returns the whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import bpe, cover_tree, decontaminate, language_id, line_dedup, minhash, quality, toxicity, url_filter, warc
from sextant.llm.common import read

#: Words, without a plural's s, of the categories that public lists of unwanted hosts have: what stands for labels in op2's query.
SUSPECT = tuple("ad adult adserver banner bet betting casino click coupon crack dating escort gambling jackpot keygen loan lottery malware phish pharma pill poker popup porn promo replica sex slot spam torrent tracker viagra warez webcam xxx".split())


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no labels for addresses: a host is rejected if a word of its name is one of SUSPECT."""
    pages = read(spark, sf_dir, "pages")
    words = F.split(url_filter.host(), "[^a-z0-9]+")
    bad = F.exists(words, lambda w: F.regexp_replace(w, "s$", "").isin(*SUSPECT))
    return url_filter.filtered(pages, pages.where("url is not null").select("url", bad.alias("rejected")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenized(read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_groups(read(spark, sf_dir, "embeddings"))


#: By name; oracle SQL by the same names, where SQL can express the query.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_bpe": op3_bpe,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_minhash": op7_minhash,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_cover_tree": op10_cover_tree,
}
SQL: dict[str, str] = {
    "op4_warc": "SELECT page_id, url, md5(html) AS digest, strlen(html)::INT AS n_bytes FROM pages",
    "op10_cover_tree": """
        WITH RECURSIVE near AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
        reached(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, n.b FROM reached r JOIN near n ON r.b = n.a),
        links AS (SELECT a, count(*) AS n FROM near GROUP BY a)
        SELECT r.a AS vec_id, min(r.b) AS class_id, coalesce(any_value(links.n), 0) AS n_links FROM reached r LEFT JOIN links USING (a) GROUP BY r.a""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
