"""Choosing index options by recall and latency on a sample."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.arrow import shared_dir
from sextant.operators import ann, knn

#: (ef, ef_construction, m) in the order in which they are tried.
VARIANTS = ((64, 32, 8), (64, 64, 16), (64, 64, 32), (128, 128, 16), (128, 128, 32), (256, 128, 32))
RESULTS = "experiment_id int, ef int, efc int, m int, recall double, latency double, build_time double"


def autotune(df: DataFrame, k: int = 10, sample: int = 10_000, queries: int = 10, metric: str = "l2sq", vector: str = "embedding", id: str = "vec_id", variants: Sequence[tuple[int, int, int]] = VARIANTS, enough: float = 99.9) -> DataFrame:
    """Recall (percent), latency and build time (seconds) of each variant, on ``sample`` rows and as many random queries as told.

    The metric is the one asked for. Stops at a variant whose recall reaches ``enough``.
    """
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id), id).limit(sample).select(id, vector).persist()
    asked = rows.orderBy(F.xxhash64(id, F.lit(1)), id).limit(queries).collect()
    truth = {r[id]: {x[id] for x in knn.knn(rows, r[vector], k, metric, vector, id).collect()} for r in asked}
    out = []
    for n, (ef, efc, m) in enumerate(variants):
        began = time.perf_counter()
        index = ann.build(rows, f"{shared_dir(spark)}/tune-{uuid.uuid4().hex}", ann.Options(metric=metric, ef=ef, ef_construction=efc, m=m), id, vector)
        built = time.perf_counter()
        hits = sum(len(truth[r[id]] & {x[id] for x in ann.search(index, r[vector], k).collect()}) for r in asked)  # a search each: latency is what is measured
        took = (time.perf_counter() - built) / max(1, len(asked))
        share = math.floor(hits / max(1, sum(map(len, truth.values()))) * 10_000) / 100
        out.append((n, ef, efc, m, share, math.floor(took * 100_000) / 100_000, built - began))
        if share >= enough:
            break
    rows.unpersist()
    return spark.createDataFrame(out, RESULTS)


def best(results: DataFrame, target: float) -> DataFrame:
    """One row: of the variants that reach ``target`` the one with the least latency and build time; else the best recall."""
    reached = F.col("recall") >= target
    cost = F.col("latency") + F.col("build_time")
    return results.orderBy(F.when(reached, 0).otherwise(1), F.when(reached, cost), F.desc("recall"), cost, "experiment_id").limit(1)


def reuse(history: DataFrame, model: str, metric: str) -> DataFrame:
    """Past results of the same model and metric."""
    return history.where((F.col("model") == model) & (F.col("metric") == metric))
