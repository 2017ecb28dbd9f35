import json

import numpy as np

from sextant.__main__ import run


def test_commands(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((120, 8))
    words = ["apples and pears", "pears", "quick foxes"]
    spark.createDataFrame([(i, v.tolist(), words[i % 3]) for i, v in enumerate(x)], "vec_id long, embedding array<float>, text string").write.parquet(f"{tmp_path}/t")
    at = lambda name: f"file://{tmp_path}/{name}"
    assert run(spark, ["create-index", "--table", at("t"), "--out", at("i"), "--metric", "cos"]) is None
    assert run(spark, ["search-index", "--table", at("i"), "--query", json.dumps(x[5].tolist()), "--k", "3"]).first().vec_id == 5
    assert run(spark, ["pq-table", "--table", at("t"), "--out", at("q"), "--clusters", "4", "--splits", "2"]) is None
    assert spark.read.parquet(at("q/table")).where("size(embedding_pq) = 2").count() == 120
    run(spark, ["create-embeddings", "--table", at("t"), "--out", at("e"), "--column", "text", "--target", "v"])
    assert spark.read.parquet(at("e")).where("size(v) = 64").count() == 120
    run(spark, ["bm25-index", "--table", at("t"), "--out", at("b"), "--id", "vec_id"])
    assert {r.doc_id % 3 for r in run(spark, ["search-bm25", "--table", at("b"), "--query", "Apple pears", "--k", "40"]).collect()} == {0}
