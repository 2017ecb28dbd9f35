import hashlib
import random

import numpy as np
import pytest

from sextant.llm import cover_tree, language_id, url_filter, warc

TONGUES = {"en": "the quick house over there with water and stone", "de": "der schnelle wagen über straße und wasser nicht", "fr": "le rapide château près de l'eau où être"}


def page_text(lang, seed, n=30):
    r = random.Random(seed)
    return " ".join(r.choice(TONGUES[lang].split()) for _ in range(n))


PAGES = [(i, f"https://{'spam-shop' if i % 9 == 0 else 'site'}{i % 4}.example.{'de' if lang == 'de' else 'org'}/{i}", f'<html lang="{lang}"><style>p{{}}</style><p>{page_text(lang, i)}</p></html>') for i, lang in enumerate(["en", "de", "fr"] * 30)]
ODD = [(900, None, None), (901, "", ""), (None, "http://x", "<p>the house"), (902, "no address\r\nat all", "<html lang=>\x00"), (903, "http://a.b/ü", "word " * 300_000), (0, PAGES[0][1], PAGES[0][2])]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "?", "?") for r in PAGES + ODD], "page_id long, url string, html string, host string, lang string").repartition(3).cache()


def test_archive_round_trip(spark, pages, tmp_path):
    index = warc.write(pages, f"file://{tmp_path}", roll=20_000)
    back = warc.read(spark, index, f"file://{tmp_path}")
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.page_id, r.url, r.html) for r in back.collect()) == order(PAGES + ODD)
    assert len(list(tmp_path.glob("*.warc.zst"))) > 2
    for row in index.where("page_id in (5, 900)").collect():
        fields, body = warc.read_one(f"file://{tmp_path}", row.path, row.offset, row.length)
        assert fields["X-Page-ID"] == str(row.page_id) and body.decode() == ({5: PAGES[5][2], 900: ""}[row.page_id])
    data = next(tmp_path.glob("*.warc.zst")).read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    assert warc.write(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_files_are_read_by_several_tasks(spark, pages, tmp_path):
    index = warc.write(pages.repartition(4), f"file://{tmp_path}", roll=20_000)
    back = warc.read(spark, index, f"file://{tmp_path}")
    assert back.rdd.getNumPartitions() >= min(4, index.select("path").distinct().count())


def test_archived_digests(pages):
    got = {r.page_id: (r.digest, r.n_bytes) for r in warc.archived(pages).collect()}
    assert got[5] == (hashlib.md5(PAGES[5][2].encode()).hexdigest(), len(PAGES[5][2].encode())) and got[900] == (None, None)


def test_dictionary_helps():
    records = [warc.record(i, f"http://a/{i}", page_text("en", i), "2020-01-01T00:00:00Z") for i in range(500)]
    import zstandard

    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(warc.pack(records)[0]) < 0.7 * plain
    data, offsets, lengths = warc.pack([b"x"])
    reader, start = warc.unpack(data)
    assert start == offsets[0] and reader.decompress(data[start : start + lengths[0]]) == b"x"


@pytest.fixture(scope="module")
def labelled(spark):
    """Labels by host: 5 hosts of either kind; other hosts of the same kinds are in PAGES."""
    r = random.Random(3)
    rows = [(f"https://{'spam-shop' if bad else 'site'}{k}.example.org/{r.randrange(10**4)}", bool(bad)) for bad in (0, 1) for k in range(20, 32) for _ in range(12)]
    return spark.createDataFrame(rows + [rows[0], (None, True), ("http://x", None)], "url string, rejected boolean")


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_url_chances_by_brute_force(spark, pages, labelled, monkeypatch, limit):
    monkeypatch.setattr("sextant.llm.common.BROADCAST_BYTES", limit)
    rows = labelled.where("url is not null and rejected is not null").selectExpr("url", "int(rejected) as rejected")
    want = {0: {}, 1: {}}
    for url, label in map(tuple, rows.collect()):
        data = ("\x02" * 5 + url.lower() + "\x03").encode()
        for i in range(5, len(data)):
            for k in range(6):
                after = want[label].setdefault((k, data[i - k : i]), {})
                after[data[i]] = after.get(data[i], 0) + 1

    def log(probe, label):
        data, total = (b"\x02" * 5 + probe.lower().encode() + b"\x03"), 0.0
        for i in range(5, len(data)):
            p = 1 / 256
            for k in range(6):
                if after := want[label].get((k, data[i - k : i])):
                    n, t = sum(after.values()), len(after)
                    p = (after.get(data[i], 0) + t * p) / (n + t)
            total += np.log(p)
        return total / (len(data) - 5)

    counts = url_filter._counted(rows, 5)
    got = {r.url: r.score for r in url_filter.scores(pages, counts).collect()}
    assert len(got) == len({u for _, u, _ in PAGES + ODD if u is not None})
    for url, score in got.items():
        assert abs(score - (log(url, 1) - log(url, 0))) < 1e-9


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_url_filter_of_hosts_it_has_not_seen(spark, pages, labelled, monkeypatch, limit):
    monkeypatch.setattr("sextant.llm.common.BROADCAST_BYTES", limit)
    rows = {r.page_id: r for r in url_filter.filtered(pages, labelled).collect()}
    wrong = [i for i, _, _ in PAGES if rows[i].rejected != (i % 9 == 0)]
    assert not wrong and rows[900].score is None and not rows[900].rejected
    assert url_filter.filtered(pages, labelled).count() == len(PAGES + ODD)
    assert url_filter.filtered(pages.limit(0), labelled).count() == 0
    one = url_filter.filtered(pages, spark.createDataFrame([("http://a", False)], "url string, rejected boolean"))
    assert one.count() == len(PAGES + ODD) and one.where("rejected or score is not null").count() == 0
    both = spark.createDataFrame([("http://a", False), ("http://a", True)], "url string, rejected boolean")
    assert all(abs(r.score or 0) < 1e-12 for r in url_filter.filtered(pages, both).collect())


def test_url_cutoff_by_brute_force():
    r = np.random.default_rng(5)
    for _ in range(50):
        score = np.unique(r.integers(-20, 20, 12)) / 10
        bad, good = r.integers(0, 3, len(score)), r.integers(0, 3, len(score))
        bad[0] += 1
        cutoff = url_filter.best_cutoff(score, bad, good)
        f1 = lambda c: 2 * bad[score > c].sum() / ((bad + good)[score > c].sum() + bad.sum())
        assert f1(cutoff) >= max(f1(c - 1e-9) for c in score) - 1e-12


def grams(text):
    t = " " + "".join(c if c.isalnum() else " " for c in text.lower()) + " "
    return [t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " " or (t[i] != " " and t[i + 2] != " ")]


def test_language_posteriors_by_brute_force(spark):
    """Every number from counts in dictionaries; trigrams share no place in so few texts."""
    langs = ["de", "en", "fr"]
    docs = [(i, page_text(lang, 700 + i, 12), lang) for i, lang in enumerate(["en", "de", "fr"] * 5)]
    rows = [(i, f"http://{'a' if i % 2 else 'b'}.example.{'de' if i % 3 else 'org'}/{i}", f'<html{" lang=" + chr(34) + ("de-AT" if i % 4 else "fr") + chr(34) if i % 5 else ""}><p>{page_text(langs[i % 3], 40 + i, 3)}</p></html>') for i in range(24)]
    counts = {x: {} for x in langs}
    for _, text, lang in docs:
        for g in grams(text):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    places = 1 << language_id.BITS
    total = {x: sum(counts[x].values()) + 0.5 * places for x in langs}
    data = []
    for i, url, html in rows:
        text = html.split("<p>")[1].split("</p>")[0]
        logs = np.array([language_id.TEMPER * sum(np.log((counts[x].get(g, 0) + 0.5) / total[x]) for g in grams(text)) for x in langs])
        logs -= logs.max()
        host = url.split("/")[2]
        data.append((i, host, host.split(".")[-1], ("de" if i % 4 else "fr") if i % 5 else "", logs, np.exp(logs) / np.exp(logs).sum()))
    sums = lambda k, v: sum(d[5] for d in data if d[k] == v)
    number = lambda k, v: sum(1 for d in data if d[k] == v)
    kinds, every = len({d[3] for d in data}), sum(d[5] for d in data)
    want = {}
    for i, host, suffix, declared, logs, p in data:
        overall = (every + 1) / (len(data) + 3)
        by_suffix = (np.maximum(sums(2, suffix) - p, 0) + 10 * overall) / (number(2, suffix) - 1 + 10)
        prior = (np.maximum(sums(1, host) - p, 0) + 10 * by_suffix) / (number(1, host) - 1 + 10)
        z = logs + np.log(prior) + (np.log((sums(3, declared) + 1) / (every + kinds)) if declared else 0)
        want[i] = langs[int(z.argmax())], float(np.exp(z).max() / np.exp(z).sum())
    got = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    for r in got.collect():
        assert r.lang == want[r.page_id][0] and abs(r.probability - want[r.page_id][1]) < 1e-3


def test_equally_likely_languages(spark):
    docs = spark.createDataFrame([(1, "same words", "fr"), (2, "same words", "de")], "doc_id long, text string, lang string")
    got = language_id.identify(spark.createDataFrame([(1, "http://a.b/", "<p>words</p>")], "page_id long, url string, html string"), docs).first()
    assert got.lang == "de" and abs(got.probability - 0.5) < 1e-6


def test_markup_is_scanned_in_one_pass():
    import time

    v = language_id.visible
    assert v("a<!-- x > --> b<b class='>'>c</b>&amp;d") == "a  b '>c  d" or v("a<!-- x > --> b<i>c</i>&amp;d") == "a  b c  d"
    assert v("<script>var t='<p>';</script >x<style a>y</STYLE>z") == " x z"
    assert v("1 < 2 and no end <b") == "1 < 2 and no end <b" and v("<!-- open >x") == " x" and v("<script>x") == " x" and v("") == ""
    began = time.perf_counter()
    for part in ("<!--", "<", "<script ", "<html ", "<style>", "</script", "lang=", "<html lang"):
        text = part * (1_000_000 // len(part))
        v(text)
        language_id.declared_language(text)
    assert time.perf_counter() - began < 8
    assert language_id.declared_language("<HTML class=x LANG = 'De-at'>") == "de" and language_id.declared_language("<html><p lang=fr>") == ""


def test_language(spark, pages):
    docs = spark.createDataFrame([(i, page_text(lang, 500 + i), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)] + [(None, "x", "en"), (90, None, "en"), (91, "x", None), (92, "x", " ")], "doc_id long, text string, lang string")
    rows = {r.page_id: r for r in language_id.identify(pages, docs).collect()}
    assert all(rows[i].lang == ["en", "de", "fr"][i % 3] for i, _, _ in PAGES)
    assert all(0 < r.probability <= 1 for r in rows.values()) and len(rows) == len(PAGES) + 5
    assert language_id.identify(pages, docs).count() == len(PAGES + ODD)
    assert language_id.identify(pages.limit(0), docs).count() == 0
    assert all(r.lang is None for r in language_id.identify(pages, docs.limit(0)).collect())


def test_priors_decide_where_the_text_says_nothing(spark):
    docs = spark.createDataFrame([(i, page_text(lang, i), lang) for i, lang in enumerate(["en", "de"] * 20)], "doc_id long, text string, lang string")
    rows = [(i, f"http://h.example.de/{i}", f"<p>{page_text('de', i)}</p>") for i in range(20)] + [(50 + i, f"http://h.example.com/{i}", f"<p>{page_text('en', i)}</p>") for i in range(30)] + [(99, "http://h.example.de/x", "<p>12345</p>"), (98, "http://new.example.de/x", "<p></p>")]
    got = {r.page_id: r.lang for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert got[99] == got[98] == "de"


def vectors(n, seed):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 6))
    return np.concatenate([x, x[: n // 3] + 0.05 * r.standard_normal((n // 3, 6)), x[:5] * 2])


@pytest.mark.parametrize("cell, least", [(40, 0.95), (4096, 0.9), (15, 1.0)])
def test_cover_tree_pairs_are_exact(spark, cell, least):
    x = vectors(150, 4)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r.vec_id_a, r.vec_id_b) for r in cover_tree.near_pairs(df, least, cell).collect()}
    s = unit @ unit.T
    sure = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= least + 1e-9}
    may = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= least - 1e-9}
    assert sure <= got <= may and len(may) > 0


def test_cover_tree_nodes_cover():
    x = vectors(300, 9).astype(np.float32)
    root = cover_tree.build(x, np.arange(len(x)))
    seen, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.children:
            assert sorted(n.points.tolist()) == sorted(i for c in n.children for i in c.points.tolist())
            assert n.children[-1].centre == n.centre or n.centre in [c.centre for c in n.children]
            todo += n.children
            for i, c in enumerate(n.children):
                assert all(((x[c.centre] - x[d.centre]) ** 2).sum() > (n.radius / 4) ** 2 for d in n.children[:i])
        else:
            seen += n.points.tolist()
    assert sorted(seen) == list(range(len(x)))


@pytest.mark.parametrize("cell, group, pivots", [(40, 60, 4096), (4096, 1 << 16, 4096), (15, 30, 3)])
def test_cover_tree_groups_by_brute_force(spark, cell, group, pivots):
    x = vectors(150, 4)
    x = np.concatenate([x, np.repeat(x[7:8], 120, 0)])  # a hot vector
    ids = np.random.default_rng(1).permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)
    x = x.astype(np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    root = list(range(len(x)))
    for _ in range(len(x)):
        new = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(x))]
        if new == root:
            break
        root = new
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(int(ids[i]))
    want = {(int(ids[i]), min(groups[root[i]]), int(near[i].sum()) - 1) for i in range(len(x))}
    got = cover_tree.near_groups(df, cell=cell, group=group, pivots=pivots).collect()
    assert {(r.vec_id, r.class_id, r.n_links) for r in got} == want and len(got) == len(want)


def test_cover_tree_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [2.0, 0.0]), (9, [0.0, 3.0])]
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], "vec_id long, embedding array<float>, cell string, v string")
    assert sorted((r.vec_id_a, r.vec_id_b) for r in cover_tree.near_pairs(df).collect()) == [(1, 2), (8, 9)]
    got = {r.vec_id: (r.class_id, r.n_links) for r in cover_tree.near_groups(df).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0), 8: (8, 1), 9: (1, 3)}
    assert cover_tree.near_pairs(df.limit(0)).count() == cover_tree.near_groups(df.limit(0)).count() == 0
    assert [tuple(r) for r in cover_tree.near_groups(df.where("vec_id = 3")).collect()] == [(3, 3, 0)]
    with pytest.raises(Exception, match="differ in length"):
        cover_tree.near_pairs(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    with pytest.raises(ValueError):
        cover_tree.near_pairs(df, 0)


def test_cover_tree_of_vectors_that_hardly_differ(spark):
    """Radii far below what 32-bit products can tell apart."""
    r = np.random.default_rng(3)
    one = r.standard_normal(64)
    x = one + 10.0 ** -r.integers(3, 9, (400, 1)) * r.standard_normal((400, 64))
    x = np.concatenate([x, np.repeat(x[:1], 40, 0)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    f = x.astype(np.float32)
    root = cover_tree.build(f, np.arange(len(x)))
    hits = set()
    cover_tree.traverse(f, root, f, root, 0.01, lambda p, qs: hits.update((i, j) for q in qs for i in p.points.tolist() for j in q.points.tolist()))
    assert {(i, j) for i, j in zip(*np.nonzero(1 - x @ x.T <= 0.00005))} <= hits
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in cover_tree.near_groups(df, 0.99999, cell=100, group=200).collect()}
    s = x @ x.T
    assert all((s[i] >= 0.99999 + 1e-12).sum() - 1 <= got[i] <= (s[i] >= 0.99999 - 1e-12).sum() - 1 for i in range(len(x)))
