import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "pe", "ri") for b in ("san", "ten", "vor", "zil", "bem") for c in ("a", "os", "it", "ul", "em", "y")]
#: Names that operators use inside, on columns that aren't theirs.
CLASHES = ("tokens", "score", "toxic", "node", "key", "id", "n_lines", "n_dropped", "region", "kept_doc_id", "high", "lang", "gone", "_gone", "_gone_id", "rejected", "place")


def prose(seed, n=60, line=12):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) for _ in range(min(line, n - k))) for k in range(0, n, line))


@pytest.fixture(scope="session")
def messy(spark):
    """Null and empty texts, a very long one, rows that are repeated, null ids, and extra columns."""
    rows = [(1, prose(1)), (2, prose(2)), (2, prose(2)), (3, None), (4, ""), (5, " \n\t "), (None, prose(6)), (None, None), (7, "word " * 400_000), (8, "\U0001f600" * 50 + " ñandú́ 漢字"), (9, prose(1)), (10, "x")]
    more = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, *["?"] * len(CLASHES)) for i, t in rows], f"doc_id long, text string, {more}").repartition(3)


@pytest.fixture(scope="session")
def none(messy):
    return messy.limit(0)
