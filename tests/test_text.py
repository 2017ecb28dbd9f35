import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.functions import bloom, text
from sextant.operators import bm25

DOCS = [(1, "Apple banana kiwi"), (2, "apple apple, banana!"), (3, "banana banana cherry"), (4, "banana orange mango"), (5, None)]


@pytest.mark.parametrize("word, want", [("jumps", "jump"), ("lazy", "lazi"), ("apples", "appl"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("relational", "relat"), ("happiness", "happi"), ("agreed", "agre"), ("ties", "tie"), ("cries", "cri"), ("skies", "sky"), ("is", "is"), ("communication", "communic"), ("probability", "probabl"), ("yellow", "yellow"), ("flying", "fli"), ("news", "news"), ("", "")])
def test_stems(word, want):
    assert text.stem(word) == want


def test_stem_arrays(spark):
    df = spark.createDataFrame([("The quick, brown fox jumps over the lazy dog!",), (None,), ("",)], "t string")
    got = [r.s for r in df.select(text.stem_array(F.col("t")).alias("s")).collect()]
    assert got == ["quick brown fox jump over lazi dog".split(), None, []]
    lexemes = df.select(text.stem_array(F.col("t"), "tsvector").alias("s")).first().s
    assert lexemes == "quick brown fox jump lazi dog".split()
    with pytest.raises(ValueError, match="invalid engine"):
        text.stem_array(F.col("t"), "other")


def test_user_stop_words(spark):
    text.set_user_stop_words(spark, ["fox", "dog"])
    words = [r.stopword for r in text.user_stop_words(spark).collect()]
    assert words == ["fox", "dog"]
    row = spark.range(1).select(text.stem_array(F.lit("fox dogs dog"), user_stop_words=words).alias("s")).first()
    assert row.s == ["dog"]
    text.set_user_stop_words(spark, None)
    assert text.user_stop_words(spark).count() == 0


def test_bloom(spark):
    df = spark.createDataFrame([([1, 5, 9], ["a", "b"]), (None, [])], "n array<bigint>, s array<string>")
    made = df.select("n", bloom.array_to_bloom(F.col("n")).alias("b"), bloom.array_to_bloom(F.col("s")).alias("c"))
    row = made.select(*[bloom.elem_in_bloom(F.lit(v), F.col("b")).alias(f"x{v}") for v in (1, 5, 9)], bloom.elem_in_bloom(F.lit("a"), F.col("c")).alias("a"), bloom.elem_in_bloom(F.lit("zz"), F.col("c")).alias("z")).collect()
    assert list(row[0]) == [True, True, True, True, False] and row[1].x1 is None and row[1].a is False
    data = bloom.make(range(2000))
    assert all(bloom.contains(data, i) for i in range(2000)) and sum(bloom.contains(data, i) for i in range(2000, 12000)) < 200


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, content string").select("doc_id", "content", text.stem_array(F.col("content")).alias("tokens")).cache()


@pytest.fixture(scope="module")
def index(docs):
    return bm25.build(docs.where("doc_id < 5"))


def test_index(index):
    rows = {r.term: r for r in bm25.packed(index, threshold=3).collect()}
    assert (rows["appl"].term_freq, rows["appl"].doc_ids, rows["appl"].fqs) == (2, [1, 2], [1, 2])
    assert (rows["banana"].term_freq, rows["banana"].fqs) == (4, [1, 1, 2, 1])
    assert rows["banana"].doc_ids_bloom is not None and rows["kiwi"].doc_ids_bloom is None
    assert (index.n_docs, index.avg_len) == (4, 3.0)


def test_search(index, docs):
    got = {r.doc_id: r.bm25 for r in bm25.search(index, ["appl", "banana", "banana"], None).collect()}
    assert {k: round(v, 4) for k, v in got.items()} == {1: 0.7985, 2: 1.0584, 3: 0.1449, 4: 0.1054}
    assert [r.doc_id for r in bm25.search(index, ["appl", "banana"], 2, content=docs).select("doc_id", "content").collect()] == [2, 1]
    assert bm25.search(index, ["nothing"]).count() == bm25.search(index, []).count() == 0
    approx = {r.doc_id: r.bm25 for r in bm25.search(index, ["banana"], None, approx=3).collect()}
    assert len({round(v, 9) for v in approx.values()}) == 1
    scored = {r.doc_id: r.bm25 for r in bm25.score(index, docs, ["appl", "banana", "zzz"]).collect()}
    assert all(math.isclose(scored[k], v) for k, v in got.items()) and scored[5] is None
    for bad in ((-1, 4, 3.0), (1, 0, 3.0), (1, 4, -1.0), (1, 4, math.nan)):
        with pytest.raises(ValueError):
            bm25.aggregate(index.postings, *bad)
    with pytest.raises(ValueError):
        bm25.Parameters(k1=9)


def test_consolidate_and_null_documents(docs):
    halves = [bm25.packed(bm25.build(docs.where(f"doc_id % 2 = {k}"))).drop("doc_ids_bloom") for k in (0, 1)]
    merged = {r.term: r.doc_ids for r in bm25.consolidate(halves[0].unionByName(halves[1])).collect()}
    assert merged["banana"] == [1, 2, 3, 4]
    assert bm25.build(docs).n_docs == 5
    empty = bm25.build(docs.limit(0))
    assert empty.n_docs == 0 and bm25.search(empty, ["a"]).count() == 0


def test_user_stop_words_are_left_out(spark):
    df = spark.createDataFrame([("The quick fox jumps",)], "t string")
    text.set_user_stop_words(spark, ["fox"])
    assert df.select(text.stem_array(F.col("t"))).first()[0] == ["quick", "jump"]
    assert df.select(text.stem_array(F.col("t"), "tsvector", "simple")).first()[0] == ["the", "quick", "jumps"]
    text.set_user_stop_words(spark, None)
    assert df.select(text.stem_array(F.col("t"))).first()[0] == ["quick", "fox", "jump"]


def test_filters_by_a_plain_loop():
    lists = [["a", "b", None, "a"], [], None, [1, 2, 3], ["x"] * 5]
    made = bloom.make_all(lists)
    assert made[2] is None and made[0] == bloom.make(["b", "a"]) and len(made) == 5
    for x, f in ((x, f) for x, f in zip(lists, made) if x):
        assert all(bloom.contains(f, v) for v in x if v is not None)
    many = bloom.make(range(2000))
    assert sum(bloom.contains_all([many] * 4000, list(range(5000, 9000)))) < 80
    assert bloom.contains_all([made[0], None, made[0]], ["a", "a", None]) == [True, None, None]


def _near_whole(factor: int) -> list[float]:
    """Floats whose product with ``factor`` is another whole number in 32 than in 64 bits."""
    x = (np.arange(-300, 300, dtype=np.float64) / factor).astype(np.float32)
    x = np.concatenate([x, np.nextafter(x, np.float32(-9)), np.nextafter(x, np.float32(9))])
    x = x[np.floor(x * np.float32(factor)) != np.floor(x.astype(np.float64) * factor)]
    return [float(v) for v in x]


def test_codes_are_of_32_bit_products(spark, tmp_path):
    from sextant.plans import catalogue

    x = _near_whole(100)
    assert x
    spark.createDataFrame([(7, x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    row = catalogue.queries()["code_round_trips"](spark, str(tmp_path)).first()
    assert json.loads(row.text) == np.minimum(255, np.abs(np.floor(np.array(x, np.float32) * np.float32(100)))).astype(int).tolist()


def test_written_vectors_are_of_32_bit_products(spark, tmp_path):
    from sextant.plans import catalogue

    x = _near_whole(1000)[:64]
    assert len(x) == 64
    spark.createDataFrame([(7, x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    row = catalogue.queries()["ivecs_round_trip"](spark, str(tmp_path)).first()
    assert row.vec_id == 7 and row.vector == np.floor(np.array(x, np.float32) * np.float32(1000)).astype(int).tolist()


def test_stems_of_arrays_with_nulls_and_in_slices():
    import pyarrow as pa

    lists = pa.array([["running", "the", None], None, [], ["dogs", "running"], ["x"]])
    f = lambda w: None if w == "the" else text.stem(w)
    assert text._mapped(lists, f).to_pylist() == [["run"], None, [], ["dog", "run"], ["x"]]
    assert text._mapped(lists.slice(2, 2), f).to_pylist() == [[], ["dog", "run"]]
    assert text._mapped(lists.slice(0, 0), f).to_pylist() == []


def test_elements_of_arrays_in_filters(spark, tmp_path):
    """As asked one by one; a document's filter isn't sent with each of its words, and no row is multiplied."""
    from sextant.plans import catalogue

    df = spark.createDataFrame([(1, ["a", "b", None], ["a", "q", None]), (2, [], ["a"]), (3, None, ["a"]), (4, ["z"], None), (5, ["y"], [])], "i int, s array<string>, w array<string>")
    made = df.select("i", "w", bloom.array_to_bloom(F.col("s")).alias("f"))
    got = {r.i: r.x for r in made.select("i", bloom.elems_in_bloom(F.col("w"), F.col("f")).alias("x")).collect()}
    assert got == {1: [True, False, None], 2: [False], 3: [None], 4: None, 5: []}
    spark.createDataFrame([(1, "one two two"), (2, ""), (3, " ".join(f"w{i}" for i in range(3000)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.queries()["bloom_membership"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, 2, 2, True), (3, 3000, 3000, True)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def test_index_counts_within_documents(spark, tmp_path):
    """Many documents of a term, null words and ids of several rows, by a plain count; unique ids need no shuffle."""
    from collections import Counter

    rows = [(i, ["all", f"w{i % 7}", "all" if i % 2 else None]) for i in range(400)] + [(900, None), (901, [])]
    for extra in ([], [(3, ["all", "w3"])]):
        df = spark.createDataFrame(rows + extra, "doc_id long, tokens array<string>").repartition(3)
        want = Counter((t, i) for i, x in rows + extra for t in x or [])
        for write in (True, False):
            index = bm25.build(df, write=write, path=f"{tmp_path}/{len(extra)}" if write else None)
            assert {(r.term, r.doc_id): r.fq for r in index.postings.collect()} == want
            assert (index.n_docs, index.avg_len) == (402 + len(extra), round(sum(want.values()) / (402 + len(extra)), 2))
            packed = {r.term: (r.doc_ids, r.fqs) for r in bm25.packed(index).collect()}
            ids = sorted(i for t, i in want if t == "all")
            assert packed["all"] == (ids, [want["all", i] for i in ids]) and None in packed
            assert {r.term: r.df for r in index.terms.collect()} == Counter(t for t, _ in want)
        if not extra:
            assert "hashpartitioning" not in index.runs._jdf.queryExecution().executedPlan().toString()
