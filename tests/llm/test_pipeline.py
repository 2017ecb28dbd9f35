"""The pipeline's stages, alone and together, against what the rows are made to hold."""

import pytest
from tests.llm.conftest import prose

import corpus_pipeline as c

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def rows_of(texts):
    return [(i, t, "en", "web", None if t is None else len(t), "?") for i, t in texts]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """400 labelled documents, of which every fifth is rude; copies, shared lines, leaks and odd rows besides."""
    folder = str(tmp_path_factory.mktemp("made"))
    rude = "you disgusting idiotic scumbag"
    texts = [(i, prose(i) + (f"\n{rude} {prose(i + 5000, 5)}" if i % 5 == 0 else "")) for i in range(1, 401)]
    item = prose(70_000, 30)
    texts += [(500, prose(600) + "\nshared line of several words here\n"), (501, prose(601) + "\nshared line of several words here"), (502, "shared line of several words here\n \t\n\u00a0\n")]
    texts += [(510, prose(700, 100)), (511, prose(700, 100)), (512, prose(700, 100))]
    texts += [(520, prose(701, 30) + "\n" + item + "\n" + prose(702, 30)), (None, rude), (None, prose(703)), (530, None), (531, ""), (532, "word " * 300_000)]
    spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1, 401)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_one_by_one(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    left = c.drop_toxic(spark, docs, made).cache()
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert left.columns == docs.columns and left.schema == docs.schema
    assert ids == [i for i in range(1, 401) if i % 5] + [500, 501, 502, 510, 511, 512, 520, 530, 531, 532]
    assert [r.text for r in left.where("doc_id is null").collect()] == [prose(703)]
    lines = c.drop_lines(spark, left, made).cache()
    by = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == docs.columns and by[500].text == prose(600) + "\nshared line of several words here\n"
    assert by[501].text == prose(601) and by[501].n_chars == len(prose(601)) and 502 not in by and 511 not in by
    assert by[530].text is None and by[531].text == "" and None in by
    near = c.drop_near(spark, left, made)
    assert sorted(r.doc_id for r in near.where("doc_id between 510 and 512").collect()) == [510] and near.columns == docs.columns
    assert near.count() == left.count() - 2
    clean = c.drop_leaks(spark, left, made)
    assert clean.where("doc_id = 520").count() == 0 and clean.count() == left.count() - 1 and clean.columns == docs.columns
    assert c.tokenize(spark, left, made).where("not lossless").count() == 0


def test_all_stages(spark, made):
    out = c.run(spark, made).cache()
    assert out.columns == ["doc_id", "tokens", "n_tokens", "lossless"]
    got = sorted((r.doc_id for r in out.collect()), key=lambda i: (i is not None, i))
    assert got == [None, *[i for i in range(1, 401) if i % 5], 500, 501, 510, 530, 531, 532]
    assert [name for name, _ in c.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]


def test_no_rows(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet").limit(0)
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, docs, made).columns == docs.columns and stage(spark, docs, made).count() == 0
    assert c.tokenize(spark, docs, made).count() == 0
