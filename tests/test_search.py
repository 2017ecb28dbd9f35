import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import ann, bm25, knn, quantize, tune
from sextant.plans import explain

RNG = np.random.default_rng(5)
X = RNG.random((300, 8)).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, [float(v) for v in x], i % 3) for i, x in enumerate(X)] + [(1000, None, 0), (300, [float(v) for v in X[0]], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).cache()


def nearest(q, k, ids=range(300)):
    d = {i: float(((X[i].astype(float) - q) ** 2).sum()) for i in ids} | {300: float(((X[0].astype(float) - q) ** 2).sum())}
    return sorted(d, key=lambda i: (d[i], i))[:k]


def test_knn(table):
    q = [float(v) for v in X[7]]
    assert [r.vec_id for r in knn.knn(table, q, 12).collect()] == nearest(X[7].astype(float), 12)
    assert [r.vec_id for r in knn.knn(table, [float(v) for v in X[0]], 2).collect()] == [0, 300]  # ties by id
    found = knn.knn(table, q, 50, where="label = 2").collect()
    assert len(found) == 50 and all(r.label == 2 for r in found)
    assert knn.knn(table, q, 5000).count() == 301  # null vectors are no candidates
    assert knn.knn(table, None, 5).count() == 0
    with pytest.raises(Exception, match="dimension"):
        knn.knn(table, [1.0, 2.0], 5).collect()


def test_knn_join_in_chunks(table):
    queries = table.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    for chunk in (10_000, 7):
        got = {}
        for r in knn.knn_join(queries, table.select("vec_id", "embedding"), 4, chunk=chunk).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {i: nearest(X[i].astype(float), 4) for i in range(20)}
    one = knn.knn_join(queries, table, 4)
    assert knn.recall(one, one, 4).first().recall == 1.0
    assert knn.recall(one, one.where("rank <= 2"), 4).first().recall == 0.5


def test_registered_searches_by_brute_force(spark, tmp_path):
    """Their queries are the ids divisible by 100; a null vector takes no part."""
    from sextant.plans import catalogue

    v = np.random.default_rng(8).standard_normal((90, 16)).astype(np.float32)
    v = (v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32)
    rows = [(50 * i, [float(z) for z in x], i % 5) for i, x in enumerate(v)] + [(5000, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    w = v.astype(float)
    l2 = ((w[:, None] - w[None]) ** 2).sum(2)
    cos = 1 - w @ w.T / np.sqrt((w * w).sum(1)[:, None] * (w * w).sum(1)[None])
    ints = np.floor(w * 1000).astype(np.int64).astype(np.uint32)
    ham = np.array([[sum(int(z).bit_count() for z in a ^ b) for b in ints] for a in ints])
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    asked = range(0, 90, 2)
    for name, d, ids in (("knn_l2sq", l2, range(90)), ("knn_cos", np.maximum(cos, 0), range(90)), ("knn_hamming", ham, range(90)), ("knn_filtered", l2, [i for i in range(90) if i % 5 in (1, 3)]), ("knn_partial", l2, range(3, 90, 5))):
        got = run(name)
        assert {(r.query_id // 50, r["rank"]) for r in got} == {(q, k) for q in asked for k in range(1, 11)} and len(got) == 450, name
        assert {(r.query_id // 50, r.vec_id // 50) for r in got} == {(q, i) for q in asked for i in sorted(ids, key=lambda i: (round(float(d[q, i]), 12), i))[:10]}
        assert all(abs(r.dist - d[r.query_id // 50, r.vec_id // 50]) < 1e-4 for r in got)
    got = run("range_search")
    assert {(r.query_id // 50, r.vec_id // 50) for r in got} == {(int(q), int(i)) for q, i in zip(*np.nonzero(l2 < 1.7)) if q % 2 == 0}
    df = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    every = df.withColumnRenamed("vec_id", "query_id")
    assert knn.range_join(every, df, 1.7, chunk=40, block=30).count() == (l2 < 1.7).sum() and knn.range_join(every.limit(0), df, 1.7).count() == 0


def test_joins_in_blocks_agree_and_ties_go_by_id(spark):
    r = np.random.default_rng(2)
    x = r.integers(0, 3, (200, 3)).astype(float)  # many copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    asked = df.withColumnRenamed("vec_id", "query_id")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {(q, i, k + 1) for q in range(200) for k, i in enumerate(sorted(range(200), key=lambda i: (d[q, i], i))[:7])}
    for options in ({}, {"chunk": 60, "block": 45}):
        assert {(r.query_id, r.vec_id, r["rank"]) for r in knn.knn_join(asked, df, 7, **options).collect()} == want


def test_vectors_without_a_finite_distance_are_no_candidates(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [nan, 0.0]), (4, [nan, nan]), (5, [inf, 0.0])], "vec_id long, embedding array<double>").coalesce(1)
    assert [r.vec_id for r in knn.knn(df, [0.0, 0.0], 3).collect()] == [1, 2]
    asked = spark.createDataFrame([(7, [0.0, 0.0]), (8, [nan, 0.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in knn.knn_join(asked, df, 3).orderBy("rank").collect()] == [(7, 1), (7, 2)]
    assert knn.knn_join(asked, df.where("vec_id > 2"), 3).count() == 0


def test_weighted_join_is_weighted_search(spark, table):
    qs = [[[float(v) for v in X[i]], [float(v) for v in X[i + 1]]] for i in (3, 9)]
    asked = spark.createDataFrame(list(enumerate(qs)), "query_id int, vectors array<array<double>>")
    for ef in (None, 12):
        got = knn.weighted_join(asked, table, [0.7, 0.3], 20, "l2sq", ef=ef).orderBy("query_id", "rank").collect()
        for q, (a, b) in enumerate(qs):
            want = knn.weighted_search_l2sq(table, [(0.7, "embedding", a), (0.3, "embedding", b)], exact=ef is None, ef=ef or 100).limit(20).collect()
            assert [r.vec_id for r in got if r.query_id == q] == [r.vec_id for r in want]


def test_pages_of_a_search(table):
    q = [float(v) for v in X[3]]
    pages = [[r.vec_id for r in page.collect()] for page, _ in zip(knn.pages(table, q, 7), range(3))]
    assert sum(pages, []) == [r.vec_id for r in knn.knn(table, q, 21).collect()]
    assert sum(1 for _ in knn.pages(table.where("vec_id < 5"), q, 3)) == 2


def test_range_and_weighted(table):
    q, p = [float(v) for v in X[3]], [float(v) for v in X[4]]
    assert all(r.dist < 0.5 for r in knn.range_search(table, q, 0.5).collect())
    exact = knn.weighted_search_l2sq(table, [(1.0, "embedding", q), (2.0, "embedding", p)], exact=True)
    assert exact.count() == 301
    some = knn.weighted_search_l2sq(table, [(1.0, "embedding", q), (2.0, "embedding", p)], ef=10)
    assert 10 <= some.count() <= 20
    assert some.first().vec_id == exact.first().vec_id
    with pytest.raises(ValueError):
        knn.weighted_search(table, [])


def test_top_k_plan_has_no_full_sort(table):
    names = explain.operators(knn.knn(table, [0.0] * 8, 3))
    assert "TakeOrderedAndProject" in names and "Sort" not in names
    assert "[MASKED_VECTOR]" in explain.mask_plan("Project [v#12 <-> [0.1,0.2]]")


@pytest.mark.parametrize("bits", [32, 8, 1])
def test_index_recall(spark, table, tmp_path, bits):
    index = ann.build(table, f"file://{tmp_path}/i", ann.Options(quant_bits=bits, nlist=12, ef=200))
    hits = 0
    for i in range(0, 100, 10):
        q = [float(v) for v in X[i]]
        hits += len({r.vec_id for r in ann.search(index, q, 10).collect()} & set(nearest(X[i].astype(float), 10)))
    assert hits / 100 >= (0.9 if bits != 1 else 0.6)


def test_index_life(spark, table, tmp_path):
    index = ann.build(table, f"file://{tmp_path}/a", ann.Options(nlist=8, ef=400))
    ann.insert(index, spark.createDataFrame([(2000, [0.5] * 8, 0)], table.schema))
    assert ann.search(index, [0.5] * 8, 1).first().vec_id == 2000
    ann.delete(index, [2000])
    assert ann.search(index, [0.5] * 8, 1).first().vec_id != 2000
    again = ann.open_index(spark.newSession(), f"file://{tmp_path}/a")
    assert again.options == index.options and again.probes == index.probes and (again.centres == index.centres).all()
    assert ann.search(again, [0.5] * 8, 1).first().vec_id != 2000  # deletes are stored, too
    assert ann.validate(index)["rows"] == 301
    assert ann.vacuum(index, f"file://{tmp_path}/b").table().count() == 301
    assert ann.search(index, [0.5] * 8, 40, ef=1, where="label = 1").count() == 40
    assert ann.search(index, None, 3).count() == 0
    with pytest.raises(ValueError, match="Wrong number of dimensions"):
        ann.build(table, f"file://{tmp_path}/c", ann.Options(dim=4))
    with pytest.raises(ValueError, match="can not be inferred"):
        ann.build(table.limit(0), f"file://{tmp_path}/d")
    assert ann.build(table.limit(0), f"file://{tmp_path}/e", ann.Options(dim=8)).options.dim == 8


@pytest.mark.parametrize("options", [{"m": 1}, {"m": 129}, {"ef": 0}, {"ef": 401}, {"ef_construction": 0}, {"dim": 2001}, {"quant_bits": 4}, {"metric": "x"}])
def test_index_options(options):
    with pytest.raises(ValueError):
        ann.Options(**options)


def test_product_quantization(spark, table, tmp_path):
    book = quantize.create_codebook(table, 32, 4).cache()
    assert book.count() == 128
    coded = quantize.quantize(table, book)
    assert coded.where("vec_id = 1000").first().embedding_pq is None
    x = quantize.load_codebook(book)
    row = coded.where("vec_id = 9").first()
    assert row.embedding_pq == [int(((c - X[9, 2 * i : 2 * i + 2]) ** 2).sum(1).argmin()) for i, c in enumerate(x)]
    back = quantize.dequantize(coded, book).where("vec_id = 9").first().vector
    assert np.allclose(back, np.concatenate([x[i][k] for i, k in enumerate(row.embedding_pq)]))
    for args in ((300, 4), (0, 4), (10, 0), (10, 3)):
        with pytest.raises(ValueError):
            quantize.create_codebook(table, *args)
    with pytest.raises(ValueError, match="number of rows"):
        quantize.create_codebook(table.limit(3), 10, 4)
    with pytest.raises(ValueError, match="Empty codebook"):
        quantize.quantize(table, book.limit(0))
    index = ann.build(table, f"file://{tmp_path}/q", ann.Options(pq=True, nlist=4, ef=400), codebook=book)
    assert ann.search(index, [float(v) for v in X[0]], 1, rerank=50).first().vec_id == 0


def test_quantize_table(spark, table):
    table.write.mode("overwrite").saveAsTable("vectors_t")
    name = quantize.quantize_table(spark, "vectors_t", "embedding", 8, 2)
    assert spark.table(name).count() == 16 and "embedding_pq" in spark.table("vectors_t").columns
    with pytest.raises(ValueError, match="already exists"):
        quantize.quantize_table(spark, "vectors_t", "embedding", 8, 2)
    quantize.drop_quantization(spark, "vectors_t", "embedding")
    assert "embedding_pq" not in spark.table("vectors_t").columns
    spark.sql("DROP TABLE vectors_t")


def test_autotune(spark, table):
    got = tune.autotune(table, k=3, queries=2, variants=((400, 32, 8), (64, 32, 8)))
    assert got.count() == 1 and got.first().recall == 100.0
    rows = spark.createDataFrame([(0, 1, 1, 4, 90.0, 0.1, 1.0), (1, 1, 1, 4, 96.0, 0.3, 1.0), (2, 1, 1, 4, 97.0, 0.2, 1.0)], tune.RESULTS)
    assert tune.best(rows, 95).first().experiment_id == 2 and tune.best(rows, 99).first().experiment_id == 2


@pytest.mark.parametrize("metric", ["l2sq", "cos"])
def test_recall_of_default_options(spark, tmp_path, metric):
    """Every row asked, without structure in the vectors, and with some."""
    r = np.random.default_rng(6)
    for name, x in (("flat", r.standard_normal((1500, 32))), ("lumps", r.standard_normal((30, 32))[r.integers(0, 30, 1500)] + 0.1 * r.standard_normal((1500, 32)))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
        index = ann.build(df, f"file://{tmp_path}/{name}", ann.Options(metric=metric))
        asked = df.withColumnRenamed("vec_id", "query_id")
        found = ann.search_join(index, asked, 10)
        assert knn.recall(knn.knn_join(asked, df, 10, metric), found, 10).first().recall >= 0.9
        assert name == "flat" or index.probes <= len(index.centres) / 4
        first = ann.search(index, x[0].tolist(), 10).collect()
        assert [q.vec_id for q in first] == [q.vec_id for q in found.where("query_id = 0").orderBy("rank").collect()]


def test_stored_bm25(spark, tmp_path):
    docs = spark.createDataFrame([(i, ["a"] * (i % 3) + [f"w{i}"]) for i in range(40)], "doc_id long, tokens array<string>")
    bm25.build(docs, path=f"file://{tmp_path}/b")
    index = bm25.open_index(spark.newSession(), f"file://{tmp_path}/b")
    assert index.n_docs == 40 and index.avg_len == 1.98
    found = bm25.search(index, ["a", "w5"], 3)
    assert found.first().doc_id == 5 and "PushedFilters: [In(term" in explain.masked_explain(found)
    assert [r.doc_id for r in bm25.search(index, ["a", "w5"], 3, parameters=bm25.Parameters(b=0.0)).collect()][0] == 5
    assert bm25.search(index, ["none"], 3).count() == 0


@pytest.mark.parametrize("metric", ["l2sq", "cos", "hamming"])
def test_tiles_are_of_bounded_memory_and_right(metric):
    """Of many queries and rows, some of them equal or zero; ties by id."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((6000, 16)) * 50)
    x[4000:4500] = x[:500]
    x[7] = x[4999] = 0
    ids, names = rng.permutation(6000), pa.array(np.arange(3000))
    tracemalloc.start()
    search = knn._Search(knn.Metric.of(metric), x[:3000], 5)
    for a in (0, 2500):
        search.add(pa.array(ids[a : 2500 if not a else None]), x[a : 2500 if not a else None])
    found = list(search.columns(names))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6  # all distances of 3,500 rows at once are 84 MB, and as much again several times over
    got = {}
    for q, i, _ in found:
        for a, b in zip(q.to_pylist(), i.to_pylist()):
            got.setdefault(a, []).append(b)
    for q in (0, 7, 499, 2999):
        y = x[q]
        if metric == "hamming":
            d = np.array([sum(((int(u) ^ int(v)) & 0xFFFFFFFF).bit_count() for u, v in zip(r, y)) for r in x])
        elif metric == "l2sq":
            d = ((x - y) ** 2).sum(1)
        else:
            d = knn._each(knn.Metric.COS, x, y[None], np.arange(len(x)), np.zeros(len(x), int))
        assert got[q] == ids[np.lexsort((ids, d))[:5]].tolist()


def test_equal_vectors_are_ranked_by_id(spark):
    """Of twenty queries, equal rows have equal distances and sums, wherever they lie."""
    v = np.random.default_rng(9).standard_normal((40, 24)).astype(np.float32)
    rows = [(1000 - i, [float(z) for z in v[i % 40]]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    asked = df.where("vec_id > 980").withColumnRenamed("vec_id", "query_id")
    pairs = asked.select("query_id", F.array("embedding", "embedding").alias("vectors"))
    for found in (knn.knn_join(asked, df, 30, "cos"), knn.knn_join(asked, df, 30), knn.weighted_join(pairs, df, [0.7, 0.3], 30)):
        by = {}
        for r in found.orderBy("query_id", "rank").collect():
            by.setdefault(r.query_id, []).append(r.vec_id)
        assert len(by) == 20
        for q, ids in by.items():
            assert len(ids) == 30 and all(ids[a : a + 10] == sorted(ids[a : a + 10]) and len({i % 40 for i in ids[a : a + 10]}) == 1 for a in (0, 10, 20))


def test_search_join_in_blocks_and_groups(spark, table, tmp_path, monkeypatch):
    """All rows as queries of all cells give what brute force does, with cells in groups and with a cell in parts."""
    index = ann.build(table, f"{tmp_path}/index", ann.Options(nlist=9))
    index.probes = 9
    asked = table.where("vec_id < 300").select(F.col("vec_id").alias("query_id"), "embedding")
    want = {(r.query_id, r.vec_id, r.rank) for r in knn.knn_join(asked, table, 4).collect()}
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    for rows in (65_536, 20):
        monkeypatch.setattr(ann, "CELL_ROWS", rows)
        assert {(r.query_id, r.vec_id, r.rank) for r in ann.search_join(index, asked, 4).collect()} == want
    monkeypatch.setattr(ann, "CELL_ROWS", 40)
    first, parts, n = ann._grouped({0: 10, 1: 100, 2: 30, 3: 9, 4: 1, 5: 25}, 6)
    assert parts.tolist() == [1, 3, 1, 1, 1, 1] and n == first.max() + 1 and len({0, 1, 2, 3, *first.tolist()}) >= 4
