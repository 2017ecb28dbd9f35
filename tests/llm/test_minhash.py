import numpy as np
import pytest
from tests.llm.conftest import WORDS, prose

from sextant.llm import minhash


def groups(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent) if root(x) != x}


def brute(rows, least=minhash.LEAST):
    ids = [i for i, _ in rows]
    have, keys = minhash.signatures([t for _, t in rows])
    pairs = [(ids[have[i]], ids[have[j]]) for i in range(len(have)) for j in range(i) if (keys[i] == keys[j]).sum() >= least]
    return groups((a, b) for a, b in pairs if a != b)


def edited(text, share, seed):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[r.integers(len(WORDS))] if r.random() < share else w for w in text.split())


def test_groups_are_those_of_all_matching_pairs(spark):
    rows = [(i, prose(i)) for i in range(40)]
    rows += [(100 + i, edited(prose(i % 8), 0.02 * (i % 7), i)) for i in range(120)]
    rows += [(300 + i, prose(39)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.kept_doc_id for r in minhash.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert all(got[300 + i] == 39 for i in range(50)) and not set(got) & set(range(40))
    loose = {r.doc_id: r.kept_doc_id for r in minhash.near_duplicates(df, least=20).collect()}
    assert loose == brute(rows, 20)


def test_merging_a_list_finds_every_chain():
    r = np.random.default_rng(1)
    codes = r.integers(1, 4, (60, 16)).astype(np.uint16)
    nodes = np.arange(60) * 10
    found = minhash._Links()
    minhash._merge_list(nodes, codes, 9, found)
    want = groups((10 * i, 10 * j) for i in range(60) for j in range(i) if (codes[i] == codes[j]).sum() >= 9)
    assert groups(found.links) == want and len(found.links) == len(want)


def test_odd_rows(messy, none):
    got = {r.doc_id: r.kept_doc_id for r in minhash.near_duplicates(messy).collect()}
    assert got == {9: 1}
    kept = minhash.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").where("doc_id is not null").collect()) == [(False, i) for i in (1, 2, 2, 3, 4, 5, 7, 8, 10)]
    assert kept.where("doc_id is null").count() == 2
    assert minhash.near_duplicates(none).count() == 0 and minhash.keep_one(none).count() == 0
    for bad in ({"least": 0}, {"least": 65}, {"coordinates": 65}):
        with pytest.raises(ValueError):
            minhash.matching(messy, **bad) if "coordinates" not in bad else minhash.signatures(["a"], 65)


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}
