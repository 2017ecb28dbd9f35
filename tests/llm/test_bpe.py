import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def other():
    ranks = {t: i for i, t in enumerate(bpe.load_vocabulary())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Merges(bpe.load_vocabulary()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_ids_are_the_library_s(encoder, other, texts):
    ids, counts = encoder(texts)
    assert ids.tolist() == [i for t in texts for i in other.encode_ordinary(t)] and counts.sum() == len(ids)


def test_special_shapes(encoder, other):
    texts = ["I've  they're it's  x'", "a" * 5000, "  \n\n  tail  ", "naïve 　漢字 12345", "\x00\x00a", "'s's 'll", "=" * 300 + " end"]
    ids, _ = encoder(texts)
    assert ids.tolist() == [i for t in texts for i in other.encode_ordinary(t)]


def test_long_pieces_by_rows(encoder, other):
    """Rows of more than WIDEST bytes merge many places in a round; a lesser rank that comes of one stops that."""
    import random

    r = random.Random(1)
    texts = ["".join(r.choice("etaoinshrdlu") for _ in range(n)) for n in (257, 1000, 4000)] + ["ab" * 2000, "a" * 5001, "漢字" * 300, "".join(r.choice(["ing", "tion", "er", "abcd"]) for _ in range(2000))]
    ids, counts = encoder(texts)
    assert ids.tolist() == [i for t in texts for i in other.encode_ordinary(t)] and (counts > 0).all()
    own = bpe.Merges([bytes([i]) for i in range(256)] + [b"ab", b"cd", b"abcd", b"abc"])
    pieces = [b"abcdabcabcd" * 50, b"abcd" * 90]
    ids, _ = own.encode(pieces)
    assert ids.tolist() == [i for p in pieces for i in plain(own, p)]


def plain(merges, piece):
    ids = merges.byte_ids[list(piece)]
    while len(ids) > 1:
        ranks = merges.rank(ids[:-1], ids[1:])
        if ranks.min() == bpe._NONE:
            break
        k = int(ranks.argmin())
        ids = [*ids[:k], ranks[k], *ids[k + 2 :]]
        import numpy as np

        ids = np.array(ids, np.int32)
    return list(ids)


def test_round_trip_and_odd_rows(messy, none):
    out = bpe.tokenized(messy)
    rows = out.collect()
    assert len(rows) == messy.count() and all(r.lossless for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[3].tokens is None and by[3].n_tokens is None and by[4].tokens == [] and by[7].n_tokens >= 400_000
    both = bpe.decode(bpe.encode(messy, to="tokens"), "tokens", "score")
    assert both.where("not (score <=> text)").count() == 0
    assert bpe.tokenized(none).count() == 0 and bpe.tokenized(none).columns == out.columns


def test_wrong_ids(spark):
    for ids in ([10**6], [-1], [None]):
        with pytest.raises(Exception, match="id"):
            bpe.decode(spark.createDataFrame([(ids,)], "tokens array<int>")).collect()
