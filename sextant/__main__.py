"""Command line: ``python -m sextant COMMAND ...`` over Parquet tables; what a command makes is written to ``--out``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text
from sextant.operators import ann, bm25, embed, quantize, tune
from sextant.session import session


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sextant")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--table", required=True)
        p.add_argument("--out", required=name not in ("search-index", "search-bm25", "autotune"))
        p.add_argument("--id", default="vec_id" if "bm25" not in name else "doc_id")
        for option, default in options.items():
            p.add_argument(f"--{option.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        return p

    index = command("create-index", column="embedding", metric="l2sq", m=16, ef_construction=128, ef=64, quant_bits=32)
    index.add_argument("--dim", type=int)
    command("search-index", query=None, k=10, ef=64)
    command("autotune", column="embedding", metric="l2sq", k=10, sample=10_000, queries=10, recall=95.0)
    command("create-embeddings", column="text", target="embedding", model="hash/64", runtime="hash", params="{}")
    command("pq-table", column="embedding", metric="l2sq", clusters=256, splits=16, limit=quantize.TRAIN_ROWS)
    command("bm25-index", column="text", engine="rust")
    command("search-bm25", query=None, k=10)
    return top


def run(spark: SparkSession, args: Sequence[str]) -> DataFrame | None:
    """What a search finds or a trial measures; None of a command that writes."""
    o = _parser().parse_args(args)
    if o.command == "search-index":
        return ann.search(ann.open_index(spark, o.table), json.loads(o.query), o.k, o.ef)
    if o.command == "search-bm25":
        words = spark.range(1).select(text.stem_array(F.lit(o.query))).first()[0]
        return bm25.search(bm25.open_index(spark, o.table), words, o.k)
    df = spark.read.parquet(o.table)
    if o.command == "create-index":
        ann.build(df, o.out, ann.Options(o.metric, o.dim, o.m, o.ef_construction, o.ef, o.quant_bits), o.id, o.column)
    elif o.command == "autotune":
        return tune.best(tune.autotune(df, o.k, o.sample, o.queries, o.metric, o.column, o.id), o.recall)
    elif o.command == "create-embeddings":
        made = embed.llm_embedding(F.col(o.column), o.model, o.runtime, params=json.loads(o.params))
        df.withColumn(o.target, made).write.parquet(o.out)
    elif o.command == "pq-table":
        quantize.create_codebook(df, o.clusters, o.splits, o.metric, o.column, o.limit).write.parquet(f"{o.out}/codebook")
        quantize.quantize(df, spark.read.parquet(f"{o.out}/codebook"), o.metric, o.column).write.parquet(f"{o.out}/table")
    else:
        stems = df.select(o.id, text.stem_array(F.col(o.column), o.engine).alias("tokens"))
        bm25.build(stems, o.id, path=o.out)
    return None


def main() -> None:
    import sys

    if (found := run(session(), sys.argv[1:])) is not None:
        found.show(1000, truncate=False)


if __name__ == "__main__":
    main()
