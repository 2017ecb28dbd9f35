import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.functions import distance as D
from sextant.functions import vectors as V

WORLD = [(f"{i:03b}", [float(c) for c in f"{i:03b}"]) for i in range(8)]
CENTRE = [0.0, 1.0, 0.0]


@pytest.fixture(scope="module")
def world(spark):
    return spark.createDataFrame(WORLD, "id string, v array<float>")


def groups(df):
    out = {}
    for r in df.select("id", F.round("dist", 2).alias("d")).collect():
        out.setdefault(r.d, []).append(r.id)
    return {k: sorted(v) for k, v in out.items()}


def test_l2sq_groups(world):
    got = groups(world.withColumn("dist", D.l2sq_dist(F.col("v"), D.literal(CENTRE))))
    assert got == {0: ["010"], 1: ["000", "011", "110"], 2: ["001", "100", "111"], 3: ["101"]}


def test_cos_groups(world):
    got = groups(world.where("id <> '000'").withColumn("dist", D.cos_dist(F.col("v"), D.literal(CENTRE))))
    assert got == {0: ["010"], 0.29: ["011", "110"], 0.42: ["111"], 1: ["001", "100", "101"]}


def test_hamming_groups(world):
    ints = world.withColumn("v", F.col("v").cast("array<int>"))
    got = groups(ints.withColumn("dist", D.hamming_dist(F.col("v"), D.literal([0, 1, 0]))))
    assert got == {0: ["010"], 1: ["000", "011", "110"], 2: ["001", "100", "111"], 3: ["101"]}


@pytest.mark.parametrize("a, b, metric, want", [([0, 0, 0], [2, 3, -4], "<->", 29), ([3, 3], [0, 0], "<+>", 4), ([0.0, 0.0], [1.0, 2.0], "<=>", 1), ([0.0], [0.0], "cosine", 0), ([-1], [0], "hamming", 32)])
def test_values(spark, a, b, metric, want):
    assert spark.range(1).select(D.distance(metric, D.literal(a), D.literal(b)).alias("d")).first().d == want


def test_null_and_unequal_lengths(spark):
    df = spark.createDataFrame([(None, [1.0])], "a array<float>, b array<float>")
    for m in D.Metric:
        assert df.select(D.distance(m, F.col("a"), F.col("b")).alias("d")).first().d is None
        with pytest.raises(Exception, match="equally sized"):
            spark.range(1).select(D.distance(m, D.literal([1, 2]), D.literal([1]))).collect()
    with pytest.raises(Exception, match="inside of an index"):
        spark.range(1).select(D.generic_dist()).collect()


def test_metric_names():
    assert D.Metric.of("dist_cos_ops") is D.Metric.COS and D.Metric.of("l2sq_dist").operator == "<->"
    with pytest.raises(ValueError):
        D.Metric.of("l1")


@given(st.lists(st.lists(st.floats(-10, 10, width=32), min_size=3, max_size=3), min_size=1, max_size=6))
def test_kernels_agree_with_plain_python(rows):
    x = np.array(rows, float)
    assert np.allclose(D.kernel("l2sq")(x, x), [[sum((p - q) ** 2 for p, q in zip(a, b)) for b in rows] for a in rows], atol=1e-9)
    cos = D.kernel("cos")(x, x)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            na, nb = np.linalg.norm(a), np.linalg.norm(b)
            if na * nb > 1e-12:
                assert abs(cos[i, j] - (1 - np.dot(a, b) / na / nb)) < 1e-6


def test_scalar_quantization(spark):
    v = D.literal([-2.0, -0.504, 0.0, 0.256, 1.0])
    row = spark.range(1).select(V.scalar_quantize(v, 8).alias("i8"), V.scalar_quantize(v, 1).alias("b1"), V.scalar_quantize(D.literal([0.1, 1.0]), 16).alias("f16")).first()
    assert row.i8 == [-100, -50, 0, 26, 100] and row.b1 == [0, 0, 0, 1, 1]
    assert np.allclose(row.f16, np.array([0.1, 1.0], np.float16))
    with pytest.raises(NotImplementedError, match="unimplemented quantization"):
        V.scalar_quantize(v, 4)


def test_codes(spark):
    row = spark.createDataFrame([("{1,2,255}",)], "t string").select(V.text_to_codes(F.col("t")).alias("c")).select("c", V.codes_to_text(F.col("c")).alias("t"), V.bytes_to_codes(V.codes_to_bytes(F.col("c"))).alias("b")).first()
    assert row.c == row.b == [1, 2, 255] and row.t == "[1,2,255]"
    for bad in ([256], [-1], []):
        with pytest.raises(Exception, match="pqvec"):
            spark.createDataFrame([(bad,)], "c array<int>").select(V.to_codes(F.col("c"))).collect()


def test_casts_and_masks(spark):
    df = spark.createDataFrame([("12",), ("x",), ("[1,2]",)], "t string")
    assert [r.n for r in df.select(V.try_cast(F.col("t"), "int").alias("n")).collect()] == [12, None, None]
    assert [r.n for r in df.select(V.try_cast(F.col("t"), "array<int>").alias("n")).collect()][2] == [1, 2]
    assert spark.range(1).select(V.mask_arrays(F.lit("v <-> '{0.5,1e-3,-2}' [1, 2]")).alias("m")).first().m == "v <-> '[MASKED_VECTOR]' [MASKED_VECTOR]"
    assert all(len(r.v) == 3 and all(0 <= x < 1 for x in r.v) for r in spark.range(5).select(V.random_array(3, seed=1).alias("v")).collect())
