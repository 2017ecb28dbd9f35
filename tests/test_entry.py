import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry():
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and {"knn_l2sq", "bm25_search", "pq_quantize"} <= set(sql)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "dist"] and df.count() == 10 and df.first().vec_id == 0
