"""Byte-level BPE: encoding in length-bucketed padded matrices, and decoding.

The text is split by the vocabulary's pattern. The distinct pieces that a worker hasn't met yet are laid
as byte ids into matrices, one for each bucket of lengths. In each round every row merges its leftmost
pair of minimum rank; pairs are looked up in a hash table, the row closes up by one place, rows without a
pair leave the matrix, and columns that no row uses any more are cut off.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sextant.llm.common import CHUNK_CHARS, KEPT, code_points, gather, map_batches, slices, span_hashes, with_field

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers; when there are more, it starts afresh.
REMEMBERED = 400_000
#: Longer pieces (bytes) are matrices of one row, in which a round merges all places of the least rank.
WIDEST = 256
_BETWEEN = regex.compile(r"(?<=\p{L}) (?=\p{L})")
_NONE = np.int32(2**31 - 1)
_BUCKETS = np.array([2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, WIDEST])
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The byte strings of a rank file, by rank. Raises ValueError unless ranks are 0.. without gaps and all bytes occur."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))) or not {bytes([i]) for i in range(256)} <= set(ranks.values()):
        raise ValueError(f"{path}: ranks have gaps or a byte is missing")
    return [ranks[i] for i in range(len(ranks))]


class Merges:
    """Pairs of ids and the id they merge into, which is also their rank, in a hash table with open addresses."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens)}
        self.byte_ids = np.array([ids[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, i in ids.items():
            for k in range(1, len(token)):
                left, right = ids.get(token[:k]), ids.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.bits = max(8, int(4 * len(pairs) + 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        keys, values = np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # place those whose slot is free, one for each slot; the others move on
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            _, first = np.unique(at[left], return_index=True)
            chosen = first[free[first]]
            self.keys[at[left[chosen]]], self.values[at[left[chosen]]] = keys[left[chosen]], values[left[chosen]]
            left = np.delete(left, chosen)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NONE where there is none or an id is negative."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).ravel().view(np.uint64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
        out = out.reshape(shape)
        return np.where((left < 0) | (right < 0), _NONE, out)

    def _matrix(self, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (their numbers and ids, padded with -1) as they are done."""
        rows = np.arange(len(m))
        ranks = self.rank(m[:, :-1], m[:, 1:])
        while len(rows):
            at = ranks.argmin(1)  # the leftmost of equal ranks
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                yield rows[done], m[done]
                keep = ~done
                rows, m, ranks, at, best = rows[keep], m[keep], ranks[keep], at[keep], best[keep]
                if not len(rows):
                    return
                used = int((m >= 0).sum(1).max())
                if used < m.shape[1]:
                    m, ranks = m[:, :used], ranks[:, : used - 1]
            n, width = m.shape
            line = np.arange(n)
            m = m.copy()
            m[line, at] = best
            columns = np.arange(width - 1)[None, :]
            m = np.take_along_axis(m, columns + (columns > at[:, None]), 1)
            if width == 2:
                yield rows, m
                return
            columns = columns[:, : width - 2]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            has = at < width - 2
            ranks[line[has], at[has]] = self.rank(m[line[has], at[has]], m[line[has], at[has] + 1])
            has = at > 0
            ranks[line[has], at[has] - 1] = self.rank(m[line[has], at[has] - 1], m[line[has], at[has]])

    def _row(self, ids: np.ndarray) -> np.ndarray:
        """Ids of one long row. All places of the least rank merge in a round, from the left, unless a lesser rank comes of it: then the leftmost only."""
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == best)
            runs = np.append(True, at[1:] != at[:-1] + 1)  # of neighbouring places, which share a token, every other one
            first = np.flatnonzero(runs)
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2 == 0]
            for some in (at, at[:1]):
                merged = ids.copy()
                merged[some] = best
                merged = np.delete(merged, some + 1)
                new = some - np.arange(len(some))
                left, right = new[new > 0] - 1, new[new < len(merged) - 1]
                touched = np.unique(np.concatenate([left, right]))
                found = self.rank(merged[touched], merged[touched + 1])
                if len(some) == 1 or not (found < best).any():
                    break
            ids, ranks = merged, np.delete(ranks, some)
            ranks[touched] = found
        return ids

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(lengths) - lengths
        counts = lengths.copy()
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of pieces, ids
        bucket = np.searchsorted(_BUCKETS, lengths)
        one = np.flatnonzero(lengths == 1)
        if len(one):
            parts.append((one, self.byte_ids[data[starts[one]]][:, None]))
        for b, width in enumerate(_BUCKETS):
            mine = np.flatnonzero((bucket == b) & (lengths > 1))
            for a in range(0, len(mine), step := max(1, 2_000_000 // int(width))):
                some = mine[a : a + step]
                column = np.arange(width)[None, :]
                inside = column < lengths[some][:, None]
                m = np.where(inside, self.byte_ids[data[np.where(inside, starts[some][:, None] + column, 0)]], np.int32(-1))
                for rows, ids in self._matrix(m):
                    parts.append((some[rows], ids))
        for i in np.flatnonzero(lengths > WIDEST):
            parts.append((np.array([i]), self._row(self.byte_ids[data[starts[i] : starts[i] + lengths[i]]])[None, :]))
        for rows, ids in parts:
            counts[rows] = (ids >= 0).sum(1)
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for rows, ids in parts:
            out[gather(at[rows], counts[rows])] = ids[ids >= 0]
        return out, counts


class _Memory(dict):
    """Numbers of the pieces met; ``new`` has the keys of those that aren't encoded yet."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, piece) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


@functools.cache
def _kinds() -> np.ndarray:
    """By code point, as the pattern sees it: 0 white space, 1 letter, 2 number, 3 anything else."""
    table = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


def split_points(points: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that PATTERN finds; ``breaks`` are places between texts, which belong to none."""
    kind = np.full(len(points) + 4, 4, np.uint8)
    inner = kind[1:-3]
    inner[:] = _kinds()[points]
    inner[breaks] = 4
    before, after = kind[:-4], kind[2:-2]
    solid = (inner >= 1) & (inner <= 3)
    start = inner != before
    last = (inner == 0) & (after >= 1) & (after <= 3)  # the last white space before something solid
    start |= last
    spaced = np.zeros(len(points), bool)
    spaced[1:] = (points[:-1] == 32) & (before[1:] == 0)
    start &= ~(solid & spaced)
    start |= inner == 4
    quote = np.flatnonzero((points == 39) & start & (after == 1))
    if len(quote):
        ahead = np.concatenate([points, np.zeros(3, np.uint32)])
        one, two = ahead[quote + 1], ahead[quote + 2]
        long = ((kind[quote + 3] == 1) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)))
        short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
        cut = quote[short | long]
        start[cut + 1] = False
        ends = cut + 2 + long[short | long]
        start[ends[ends < len(points)]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(points))
    real = inner[starts] != 4
    return starts[real], ends[real]


def _parts(text: str) -> Iterator[str]:
    a = 0
    while len(text) - a > CHUNK_CHARS and (m := _BETWEEN.search(text, a + CHUNK_CHARS // 2)):
        yield text[a : m.start()]
        a = m.start()
    yield text[a:]


class Encoder:
    """Encodes lists of texts, remembering pieces between calls.

    The usual pattern is followed by numpy and pieces are known by their length and a 64-bit hash; any other goes
    through ``regex``. Long texts are cut where a single space stands between two words, which no piece reaches over.
    """

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.merges, self.split = merges, None if pattern == PATTERN else regex.compile(pattern).findall
        self._reset()

    def _reset(self) -> None:
        self.memory = _Memory()
        self.flat, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _hashed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        joined = "\x00".join(texts)
        points = code_points(joined)
        edges = np.cumsum([0, *(len(x) + 1 for x in texts)])
        starts, ends = split_points(points, edges[1:-1] - 1)
        keys, first, back = np.unique(span_hashes(points, starts, ends) + (ends - starts).astype(np.uint64), return_index=True, return_inverse=True)
        known = len(self.memory)
        numbers = np.fromiter(map(self.memory.__getitem__, keys.tolist()), np.int64, len(keys))
        new = first[numbers >= known]
        self.memory.new = []
        return numbers[back], np.diff(np.searchsorted(starts, edges)), [joined[a:b].encode("utf-8", "surrogatepass") for a, b in zip(starts[new].tolist(), ends[new].tolist())]

    def _searched(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        found = [list(map(self.memory.__getitem__, self.split(x))) for x in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        new, self.memory.new = self.memory.new, []
        return np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum())), sizes, [x.encode("utf-8", "surrogatepass") for x in new]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if not self.split and max(map(len, texts)) > CHUNK_CHARS:
            parts = [(i, part) for i, x in enumerate(texts) for part in _parts(x)]
            found, counts = zip(*(self([x for _, x in parts[a:b]]) for a, b in slices([x for _, x in parts])))
            return np.concatenate(found), np.bincount([i for i, _ in parts], np.concatenate(counts), len(texts)).astype(np.int64)
        at, sizes, new = self._searched(texts) if self.split else self._hashed(texts)
        if new:
            flat, counts = self.merges.encode(new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, flat])
        lengths = self.counts[at]
        ids = self.flat[gather(self.starts[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(sizes)]
        if len(self.memory) > REMEMBERED:
            self._reset()
        return ids, np.diff(ends, prepend=0)


_encoders: dict[tuple, Encoder] = {}
KEPT[__name__] = _encoders.clear


def _encoder(tokens: Broadcast, pattern: str) -> Encoder:
    key = (tokens.value[0], pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Merges(tokens.value[1]), pattern)
    return _encoders[key]


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str) -> list[bytes]:
    return load_vocabulary(path)


def _shared(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast((path, _vocabulary(path)))


def _encoded(encoder: Encoder, texts: list[str | None]) -> pa.ListArray:
    ids, counts = encoder([x or "" for x in texts])
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    missing = np.array([x is None for x in texts], bool)
    offsets = pa.array(ends, mask=np.append(missing, False)) if missing.any() else pa.array(ends)
    return pa.ListArray.from_arrays(offsets, pa.array(ids)).cast(pa.list_(pa.field("element", pa.int32())))


class Decoder:
    """Texts of lists of ids."""

    def __init__(self, known: list[bytes]):
        self.table = np.frombuffer(b"".join(known), np.uint8)
        self.lengths = np.fromiter(map(len, known), np.int64, len(known))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, column: pa.ListArray) -> list[str | None]:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("a null among the ids")
        ids = flat.to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths)):
            raise ValueError("an id outside the vocabulary")
        ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        out: list[str | None] = [None] * len(column)
        for i in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)).tolist():
            own = ids[ends[i] : ends[i + 1]]
            out[i] = self.table[gather(self.starts[own], self.lengths[own])].tobytes().decode("utf-8", "replace")
        return out


def encode(df: DataFrame, text: str = "text", to: str = "tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``df`` with the ids of ``text`` in ``to`` (array<int>); nothing is shuffled.

    A null text has null, an empty one no ids. A column that is already called ``to`` is replaced. All rows
    stay, repeated ones too. ``vocabulary`` is read by the driver and broadcast: its size is fixed.
    """
    shared = _shared(df.sparkSession, vocabulary)
    df = df.drop(to)
    place = df.columns.index(text)

    def run(batches):
        encoder = _encoder(shared, pattern)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in slices(texts):
                yield [*(c.slice(a, b - a) for c in batch.columns), _encoded(encoder, texts[a:b])]

    return map_batches(df, run, with_field(df.schema, to, "array<int>"))


def decode(df: DataFrame, tokens: str = "tokens", to: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the text of the ids of ``tokens`` in ``to``; nothing is shuffled.

    Null ids give null, none give "". Bytes that aren't UTF-8 become U+FFFD. Ids outside the vocabulary, and
    null elements, raise ValueError. A column that is already called ``to`` is replaced.
    """
    shared = _shared(df.sparkSession, vocabulary)
    df = df.drop(to)
    place = df.columns.index(tokens)

    def run(batches):
        decoder = Decoder(shared.value[1])
        for batch in batches:
            yield [*batch.columns, pa.array(decoder(batch.column(place)), pa.string())]

    return map_batches(df, run, with_field(df.schema, to, "string"))


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, tokens, n_tokens, lossless``: ids, their number, whether decoding them gives the text back; in one pass.

    A null text has null tokens, which decode to null, an empty one none. Every row has a result, repeated ones
    too. A text that doesn't come back is encoded again without the pieces that the worker remembers, should two
    have shared a hash. Other columns aren't read.
    """
    shared = _shared(docs.sparkSession, vocabulary)
    docs = docs.select("doc_id", "text")

    def run(batches):
        encoder, decoder = _encoder(shared, PATTERN), Decoder(shared.value[1])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                tokens = _encoded(encoder, texts[a:b])
                same = [x == y for x, y in zip(texts[a:b], decoder(tokens))]
                if not all(same):
                    tokens = pa.concat_arrays([tokens.slice(i, 1) if good else _encoded(Encoder(encoder.merges), [texts[a + i]]) for i, good in enumerate(same)])
                    same = [x == y for x, y in zip(texts[a:b], decoder(tokens))]
                yield [batch.column(0).slice(a, b - a), tokens, tokens.value_lengths(), pa.array(same, pa.bool_())]

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("tokens array<int>, n_tokens int, lossless boolean")])
    return map_batches(docs, run, schema)
