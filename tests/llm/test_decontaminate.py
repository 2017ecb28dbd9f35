import random

import pytest
from tests.llm.conftest import WORDS, prose

from sextant.llm import decontaminate as d
from sextant.llm.common import words


def scored(same):
    """The best run by trying all."""
    best = (0, 0, 0, 0)
    for i in range(len(same)):
        total = 0
        for j in range(i, len(same)):
            total += 1 if same[j] else -2
            best = max(best, (total, i, -j - 1, int(same[i : j + 1].sum())))
    return best[1], -best[2], best[3]


def brute(docs, items, least=d.LEAST):
    """Best overlap at any alignment that has a window of 7 equal places of a mask; short items whole."""
    out = {}
    for i, t in docs:
        a, _ = words([t])
        for j, u in items:
            b, _ = words([u])
            if len(b) < least:
                if len(b) >= d.SHORT and any((a[k : k + len(b)] == b).all() for k in range(len(a) - len(b) + 1)) or len(a) == len(b) and (a == b).all():
                    out[i, j] = len(b), -len(b)
                continue
            for shift in range(-len(b) + 1, len(a)):
                x, y = a[max(0, shift) :], b[max(0, -shift) :]
                n = min(len(x), len(y))
                same = x[:n] == y[:n]
                if same.sum() < 7 or not any(all(same[k + p] for p, c in enumerate(m) if c == "1") for m in d.MASKS for k in range(n - len(m) + 1)):
                    continue
                start, end, equal = scored(same)
                if equal >= least:
                    out[i, j] = max(out.get((i, j), (0, 0)), (equal, start - end))
    return {k: (n, -w) for k, (n, w) in out.items()}


def leaky(seed, share, item):
    r = random.Random(seed)
    return prose(seed) + " " + " ".join(r.choice(WORDS) if r.random() < share else w for w in item.split()) + "\n" + prose(seed + 500)


@pytest.fixture(scope="module")
def items():
    return [(j, prose(9000 + j, 20 + j)) for j in range(12)] + [(50, "too short to find"), (49, prose(9500, 10)), (48, prose(9501, 7)), (47, "kasana lotenos"), (51, prose(9000, 20))]


def test_overlaps_against_brute_force(spark, items):
    docs = [(i, prose(i)) for i in range(10)] + [(100 + i, leaky(i, 0.02 * (i % 6), items[i % 12][1])) for i in range(36)]
    docs += [(200, prose(9500, 10)), (201, prose(3) + " " + prose(9501, 7) + " " + prose(4)), (202, "Kasana, lotenos!"), (203, prose(5) + " kasana lotenos " + prose(6)), (204, "it was too short to find, ever"), (205, prose(7) + "\n" + prose(9500, 10) + "\n" + prose(8))]
    got = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_equal, r.n_words) for r in got.collect()} == brute(docs, items)


@pytest.mark.parametrize("n", [20, 300, 600, 2000, 3000])
def test_long_overlaps_are_whole(spark, n):
    """Wherever an item stands in a document, all its words count."""
    item = prose(n, n)
    docs = [(k, prose(k, k) + "\n" + item + "\n" + prose(77 + k, 40)) for k in (0, 100, 298, 447, 1000)] + [(9, item)]
    got = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {i for i, _ in docs} and all(n <= r.n_equal <= r.n_words <= n + 3 for r in got)


def test_repetition_is_found_by_its_ends(spark):
    items = [(1, "la " * 40), (2, "ka lo " * 15), (3, "x1 x2 x3 x4 x5 " * 6 + "then it ends here"), (4, "oh " * 12)]
    docs = [(1, "la " * 30_000), (2, "so " + "lo ka " * 30), (3, "a b c " + "x1 x2 x3 x4 x5 " * 50 + "then it ends here"), (4, "oh no"), (5, "word " * 50_000)]
    got = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.n_equal for r in got.collect()} == {(1, 1): 40, (2, 2): 30, (3, 3): 34}


def test_both_ways_of_joining_agree(spark, items, monkeypatch):
    docs = spark.createDataFrame([(i, leaky(i, 0.05, items[i % 12][1])) for i in range(24)], "doc_id long, text string")
    wanted = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, d.overlaps(docs, wanted).collect()))
    monkeypatch.setattr("sextant.llm.common.BROADCAST_BYTES", -1)
    assert sorted(map(tuple, d.overlaps(docs, wanted).collect())) == one and len(one) > 10
    assert d.clean(docs, wanted).count() == 24 - len({r[0] for r in one})


def test_substitutions_are_survived(spark, items):
    docs = [(i, leaky(i, 0.1, items[i % 12][1])) for i in range(100)]
    found = d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found.select("doc_id").distinct().count() >= 90


def test_odd_rows(spark, messy, none):
    items = spark.createDataFrame([(1, prose(1), "?"), (1, prose(1), "?"), (2, None, "?"), (None, prose(2), "?"), (3, "", "?"), (4, "word " * 40, "?")], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in d.overlaps(messy, items).collect()} == {(1, 1), (9, 1), (7, 4)}
    left = d.clean(messy, items)
    assert left.columns == messy.columns and {r.doc_id for r in left.collect()} == {2, 3, 4, 5, None, 8, 10}
    assert d.overlaps(none, items).count() == 0 and d.overlaps(messy, items.limit(0)).count() == 0
    assert d.clean(messy, items.limit(0)).count() == messy.count()
    with pytest.raises(ValueError):
        d.overlaps(messy, items, masks=("102",))
