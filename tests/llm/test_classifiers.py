import random

import numpy as np
import pytest
from tests.llm.conftest import prose

from sextant.llm import quality, toxicity


def labelled(n=240):
    """Documents of which every fifth has rude words and every seventh is shouted."""
    r, docs, labels = random.Random(3), [], []
    for i in range(n):
        words = prose(i).split()
        if i % 5 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["idiotic", "disgusting", "scumbag"]))
        text = " ".join(words)
        docs.append((i, text.upper() + "!! ++ ##" if i % 7 == 0 else text))
        labels.append((i, int(i % 7 > 0), int(i % 5 == 0)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled()
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_toxicity_held_out(tables):
    docs, labels = tables
    got = toxicity.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.select("doc_id", "toxic").withColumnRenamed("toxic", "truth"), "doc_id").where("doc_id % 2 = 1").toPandas()
    hit = got.toxic.astype(int) == got.truth
    assert hit.mean() > 0.97 and (got.toxic & (got.truth == 0)).sum() <= 1


def test_toxicity_scores_by_hand(spark, tables):
    """The vectorised sum over n-grams is that of a plain loop."""
    docs, labels = tables
    model = toxicity.train(docs, labels)
    text = "You idiotic  fool\nof 3 idiotic"
    rows, grams, _ = toxicity._grams([text], np.ones(1 << toxicity.BITS, bool))
    plain = "".join(c if c.isalnum() else " " for c in f" {text.lower()} ")
    want = {plain[i : i + k] for k in toxicity.LENGTHS for i in range(len(plain) - k + 1) if plain[i + 1 : i + k - 1].isalnum()}
    assert abs(len(set(grams.tolist())) - len(want)) <= 1
    score = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert score.toxic and abs(score.score - (model.weights[grams].sum() + model.bias - model.cutoff)) < 1e-4


def test_toxicity_odd_rows(messy, none, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    rows = toxicity.score(messy, model).collect()
    assert len(rows) == messy.count() and not any(r.toxic for r in rows)
    assert sum(r.score is None for r in rows) == 2
    assert toxicity.score(none, model).count() == 0
    assert all(r.score is None for r in toxicity.score(messy, None).collect())
    rude = messy.selectExpr("cast(null as long) as doc_id", "'you disgusting idiotic scumbag' as text", *[f"`{c}`" for c in messy.columns[2:]]).limit(2)
    left = toxicity.clean(messy.unionByName(rude), model)
    assert left.columns == messy.columns and left.count() == messy.count()  # judged by row: those without an id go, too
    twice = labels.unionByName(labels.selectExpr("doc_id", "1 as quality", "0 as toxic"))
    assert toxicity.score(docs, toxicity.train(docs, twice)).where("toxic").count() > 30  # of several labels, toxic wins
    assert toxicity.train(none, labels) is None and toxicity.train(docs, labels.limit(0)) is None and toxicity.train(docs, labels.where("toxic = 0")) is None
    assert not any(r.toxic for r in toxicity.classify(messy, labels.limit(0)).collect())


def test_quality_held_out(tables):
    docs, labels = tables
    got = quality.score(docs, quality.train(docs, labels.where("doc_id % 2 = 0")), k=5).join(labels, "doc_id").where("doc_id % 2 = 1").toPandas()
    assert (got.high.astype(int) == got.quality).mean() > 0.97


def test_votes_against_brute_force():
    r = np.random.default_rng(2)
    vectors, known = quality._normal(r.standard_normal((500, 8))), quality._normal(r.standard_normal((90, 8)))
    model = quality.Model(np.ones(1), np.ones((1, 1)), known, np.arange(90), (np.arange(90) % 3 > 0).astype(float))
    got = quality.vote(vectors, np.arange(500), model, 7)
    for i in range(500):
        cosine = {j: vectors[i] @ known[j] for j in range(90) if j != i}
        near = sorted(cosine, key=lambda j: -cosine[j])[:7]
        weight = np.array([max(0, cosine[j]) for j in near])
        assert abs(got[i] - (weight * model.good[near]).sum() / weight.sum()) < 1e-9


def test_quality_odd_rows(messy, none, tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.score(messy, model).collect() if r.doc_id is not None}
    assert rows[3].score is None and not rows[3].high and rows[4].score == 0 and rows[1].high
    assert quality.score(messy, model).count() == messy.count() and quality.score(none, model).count() == 0
    assert quality.train(docs, labels.limit(0)) is None and quality.train(none, labels) is None
    assert all(r.score is None and not r.high for r in quality.score(messy, None).collect())
    few = quality.train(docs.where("doc_id < 3"), labels)
    assert quality.score(docs, few).count() == 240


def test_log_ratios_by_hand(spark):
    rows = [(1, 3, 0), (2, 1, 5), (3, 4, 4)]
    got = {r.gram: (r.ratio, r.g2) for r in toxicity.log_ratios(spark.createDataFrame(rows, "gram long, clean long, toxic long"), 10, 30).collect()}
    for gram, clean, toxic in rows:
        ratio = np.log((toxic + 1) / 11) - np.log((clean + 1) / 31)
        g2 = 2 * sum(n * np.log(n / ((clean + toxic) * s)) for n, s in ((toxic, 0.25), (clean, 0.75)) if n)
        assert np.allclose(got[gram], (ratio, g2))


def test_fit_is_at_the_minimum():
    r = np.random.default_rng(0)
    y = (r.random(200) < 0.3).astype(float)
    ratio = r.standard_normal(12)
    x = [np.flatnonzero(r.random(12) < 0.3 + 0.3 * (k % 2 == 0) * t) for k, t in enumerate(y)]
    w, bias = toxicity._fit(x, y, ratio, l2=1e-2, rounds=20_000)
    dense = np.zeros((200, 12))
    for i, f in enumerate(x):
        dense[i, f] = ratio[f]
    weight = 0.5 / y.sum() * y + 0.5 / (1 - y).sum() * (1 - y)
    slope = weight * (1 / (1 + np.exp(-(dense @ w + bias))) - y)
    assert abs(dense.T @ slope + 1e-2 * w).max() < 1e-6 and abs(slope.sum()) < 1e-6


def test_long_texts_in_parts_give_the_same(monkeypatch):
    from sextant.llm import bpe, language_id

    texts = [prose(5, 400), "short one", "", prose(6, 300).replace("a", "a1 ") + " end", None, "x" * 30]
    whole = np.ones(1 << toxicity.BITS, bool)
    plain = [x or "" for x in texts]
    encoder = bpe.Encoder(bpe.Merges(bpe.load_vocabulary()))
    before = toxicity._grams(texts, whole), quality.features(texts), language_id._trigrams(plain), encoder(plain)
    monkeypatch.setattr(toxicity, "RUN_CHARS", 100)
    monkeypatch.setattr(quality, "CHUNK_CHARS", 100)
    monkeypatch.setattr(language_id, "_CHARS", 100)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 100)
    monkeypatch.setattr(quality, "slices", lambda t: ((i, i + 1) for i in range(len(t))))
    after = toxicity._grams(texts, whole), quality.features(texts), language_id._trigrams(plain), encoder(plain)
    assert all((a == b).all() for a, b in zip(before[0], after[0])) and (before[1] == after[1]).all()
    assert [sorted(zip(*(v.tolist() for v in x))) for x in (before[2],)] == [sorted(zip(*(v.tolist() for v in x))) for x in (after[2],)]
    assert all((a == b).all() for a, b in zip(before[3], after[3]))


def test_ties_with_the_last_neighbour():
    """Copies lie at the same cosine: those with the lowest ids vote, whatever the order of the products."""
    r = np.random.default_rng(8)
    base = quality._normal(r.standard_normal((30, 16)).astype(np.float32))
    known = np.repeat(base, 40, 0)
    good = np.tile((np.arange(40) < 15).astype(float), 30)
    model = quality.Model(np.ones(1), np.ones((1, 1)), known, np.arange(1200), good)
    got = quality.vote(base, np.full(30, -1), model, 15)
    assert np.allclose(got, 1.0)


def test_latent_space_is_the_leading_singular_vectors(tables):
    docs, labels = tables
    model = quality.train(docs, labels, dimensions=8)
    rows = docs.join(labels, "doc_id").orderBy("doc_id").collect()
    counts = quality.features([r.text for r in rows])
    seen = (counts > 0).sum(0)
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    idf[-1] *= quality.REPEATED
    assert np.allclose(model.idf, idf)
    x = quality._weighted(counts, idf)
    _, sizes, axes = np.linalg.svd(x, full_matrices=False)
    assert abs((model.axes * np.sqrt(sizes[:8])).T @ axes[:8].T).max(1) == pytest.approx(1, abs=1e-2)
    assert abs(model.vectors - quality._normal(x @ model.axes)).max() < 1e-4 and (model.ids == [r.doc_id for r in rows]).all()
