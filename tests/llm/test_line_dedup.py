from sextant.llm import line_dedup


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(df, **options).collect()}


def test_templates_with_variables(spark):
    rows = [
        (1, "own words of the first one\nPage 12 of 40 in this book\nOnly here it stands alone"),
        (2, "Page 13 of 41 in this book\nother text that nobody else has"),
        (3, "page 7 of 9 in this BOOK"),
        (4, "Copyright by the authors and the printers of it\nok"),
        (5, "Copyright by the authors and the sellers of it\nok"),
        (6, "Copyright by the authors of quite different other things"),
        (7, "same same same words\nsame same same words"),
    ]
    got = run(spark, rows, least=3)
    assert got[1] == (rows[0][1], 3, 0)
    assert got[2] == ("other text that nobody else has", 2, 1) and got[3] == ("", 1, 1)
    assert got[4][2] == 0 and got[5] == ("ok", 2, 1)  # eight of nine places are equal; lines below ``least`` stay
    assert got[6][2] == 0 and got[7][2] == 0  # repeated in one document only


def test_recurring_lines_against_brute_force(spark):
    from tests.llm.conftest import prose

    rows = [(i, prose(i) + "\n" + prose(1000 + i % 5, 9, 9) + "\n" + prose(2000 + i, 9, 9)) for i in range(60)]
    got = run(spark, rows, similar=1.0)
    first = {}
    for i, t in rows:
        for x in t.split("\n"):
            first.setdefault(x, i)
    for i, t in rows:
        assert got[i][0] == "\n".join(x for x in t.split("\n") if first[x] == i)


def test_templates_by_brute_force(spark):
    """Each line in turn joins the template of its leaf to which most places are equal, if four of five are; changed places are variable."""
    import random

    from tests.llm.conftest import WORDS

    r = random.Random(11)
    heads = [[r.choice(WORDS) for _ in range(3)] for _ in range(3)]
    rows = []
    for i in range(150):
        line = [*heads[i % 3], *[f"w{k}{r.choice('abcd')}x" if r.random() < 0.25 else f"w{k}x" for k in range(7)]]
        line = [w.replace("w1", "ab") if "1" in w else w.translate(str.maketrans("0123456", "klmnopq")) for w in line]
        if i % 9 == 0:
            line[5] = str(i)
        rows.append((i, " ".join(line)))
    got = run(spark, rows)
    leaves: dict = {}
    for i, text in rows:
        words = [None if any(c.isdigit() for c in w) else w for w in text.split()]
        known = leaves.setdefault((len(words), *words[:3]), [])
        same = [sum(a == b for a, b in zip(t, words)) for t, _ in known]
        best = max(range(len(known)), key=lambda k: (same[k], -k), default=None)
        if best is not None and same[best] >= 8:
            known[best] = [a if a == b else "*" for a, b in zip(known[best][0], words)], known[best][1]
            assert got[i] == ("", 1, 1), i
        else:
            known.append((words, i))
            assert got[i] == (text, 1, 0), i
    assert 3 < sum(map(len, leaves.values())) < 120


def test_both_ways_of_joining_agree(spark, monkeypatch):
    from tests.llm.conftest import prose

    rows = [(i, prose(i) + "\n" + prose(1000 + i % 5, 9, 9) + f"\n{prose(i + 50, 9)} {prose(3, 60, 60)} {prose(2000 + i, 9, 9)}") for i in range(20)]
    one = run(spark, rows)
    monkeypatch.setattr("sextant.llm.common.BROADCAST_BYTES", -1)
    assert run(spark, rows) == one and sum(n for _, _, n in one.values()) > 20


def test_long_passage_repeats(spark):
    from tests.llm.conftest import prose

    passage = prose(77, 70, 70)
    got = run(spark, [(i, f"{prose(i)}\n{passage}\n{prose(100 + i)}") for i in range(12)])
    assert [passage in got[i][0] for i in range(12)] == [True] + [False] * 11
    assert all(prose(i) in got[i][0] and prose(100 + i) in got[i][0] for i in range(12))


def test_passage_inside_longer_lines(spark):
    from tests.llm.conftest import prose

    passage, own = prose(77, 51, 51), [prose(i, 30, 30) for i in range(24)]
    broken = passage.replace(" ", "\n", 30)
    rows = [(i, f"{own[2 * i]} {broken if i == 3 else passage}, {own[2 * i + 1]}.\nİ {prose(5000 + i, 6, 6)}") for i in range(12)]
    got = run(spark, rows)
    assert got[0] == (rows[0][1], 2, 0)
    for i in range(1, 12):
        assert got[i][0].split() == f"{own[2 * i]} {own[2 * i + 1]}. İ {prose(5000 + i, 6, 6)}".split() or i == 3
    assert got[5][1:] == (2, 1) and got[3][1:] == (32, 31) and own[7] in got[3][0] and own[6] in got[3][0] and len(got[3][0].split()) == 67
    shorter = [(i, f"{own[i]} before{i} {prose(77, 50, 50)} after{i} {own[i + 3]}") for i in range(3)]
    assert {i: x for i, (x, _, _) in run(spark, shorter).items()} == dict(shorter)
    assert run(spark, rows, passage=0)[5] == (rows[5][1], 2, 0)
    endless = run(spark, [(i, f"{own[i]} " + "la " * 70 + own[i + 3]) for i in range(3)])
    assert [x.split().count("la") for x, _, _ in (endless[i] for i in range(3))] == [70, 0, 0]


def test_lines_of_one_or_two_words(spark, tmp_path):
    import corpus_pipeline
    from sextant.llm import registry

    texts = ["Les.\nown words of the first\n17\npage 3\n--", "les\nquite other words in here\n18\nPage 3\n--", "Les.\n17\nPage 4", "LES"]
    docs = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(texts)], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_dropped) for r in registry.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (texts[0], 0), 1: ("quite other words in here\n18\n--", 2), 2: ("Page 4", 2), 3: ("", 1)}
    assert {r.doc_id for r in corpus_pipeline.drop_lines(spark, docs, str(tmp_path)).collect()} == {0, 1, 2}


def test_odd_rows(messy, none):
    out = line_dedup.drop_lines(messy)
    assert sorted(out.columns) == sorted(messy.columns)
    got = [(r.doc_id, r.text, r.n_dropped) for r in out.collect()]
    assert len(got) == messy.count()
    texts = dict((i, t) for i, t, _ in got if i is not None)
    assert texts[3] is None and texts[4] == "" and texts[5] == " \n\t " and texts[9] == "" and texts[1]
    assert [n for i, _, n in got if i == 2] == [0, 0] and [n for i, _, n in got if i is None] == [0, 0]
    assert line_dedup.drop_lines(none).count() == 0
