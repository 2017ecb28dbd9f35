"""Quality classifier: labelled neighbours vote in a latent semantic space.

A text's features are hashed: characters in threes, the shapes of characters in threes (letters of either
case, digits, spaces; anything else as it is), and words that repeat the one before. They are weighted by
log(1 + tf) and idf, which is counted over all documents, and projected on the leading singular vectors of the
labelled sample, each divided by the root of its singular value. Every document is compared with all labelled vectors by blocked products; of the ``k``
nearest, each votes with its cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import CHUNK_CHARS, char_classes, code_points, cut, map_batches, mix, slices, words

#: Labelled documents that vote at most, chosen by a hash of doc_id: they are broadcast as vectors.
SAMPLE_ROWS = 3_000
#: Places for each of the two kinds of trigrams; one more is for repeated words.
PLACES = 1 << 11
FEATURES = 2 * PLACES + 1
DIMENSIONS = 64
NEIGHBOURS = 15
#: A document is of high quality from this share of the votes up.
CUTOFF = 0.5
#: Weight of repeated words, one feature beside thousands of trigrams.
REPEATED = 10.0
_BLOCK = 2048
#: Cosines that differ by less are ties.
_TIE = 5e-6


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # features by dimensions
    vectors: np.ndarray  # of the labelled documents
    ids: np.ndarray
    good: np.ndarray


def _shapes() -> np.ndarray:
    """By code point of the first plane; beyond it, as 'x'."""
    table = np.full(0x10000, ord("x"), np.uint32)
    for c in range(0x10000):
        s = chr(c)
        if s.isspace():
            table[c] = 10 if s == "\n" else 32
        elif s.isdigit():
            table[c] = ord("9")
        elif s.isupper():
            table[c] = ord("X")
        elif not s.isalpha():
            table[c] = c
    return table


_SHAPES: list[np.ndarray] = []


def features(texts: list[str | None]) -> np.ndarray:
    """Counts, by row; a long text is taken in parts."""
    if not _SHAPES:
        _SHAPES.append(_shapes())
    texts = [x or "" for x in texts]
    n = len(texts)
    out = np.zeros(n * FEATURES)

    def take(points: np.ndarray, row: np.ndarray) -> None:
        shape = np.where(points < 0x10000, _SHAPES[0][np.minimum(points, 0xFFFF)], np.uint32(ord("x")))
        upper = (points >= 65) & (points <= 90)
        plain = np.where(char_classes()[points] > 0, np.where(upper, points + np.uint32(32), points), np.uint32(32))
        inside = row[2:] == row[:-2]
        for k, line in enumerate((plain, shape)):
            line = line.astype(np.uint64)
            if len(line) >= 3:
                keys = mix((line[:-2] << np.uint64(42) | line[1:-1] << np.uint64(21) | line[2:]) + np.uint64(k + 1)) >> np.uint64(64 - 11)
                first = int(row[0])  # rows of this part only
                found = np.bincount(((row[2:] - first) * FEATURES + k * PLACES + keys.astype(np.int64))[inside], minlength=FEATURES)
                out[first * FEATURES : first * FEATURES + len(found)] += found

    for a, b in slices(texts):
        if b - a == 1:
            text = texts[a] + "\x00"
            for i in range(0, max(1, len(text) - 2), CHUNK_CHARS):  # a part's last two characters are the next one's first
                points = code_points(text[i : i + CHUNK_CHARS + 2])
                take(points, np.full(len(points), a))
        else:
            take(code_points("\x00".join(texts[a:b]) + "\x00"), np.repeat(np.arange(a, b), np.fromiter((len(x) + 1 for x in texts[a:b]), np.int64, b - a)))
    out = out.reshape(n, FEATURES)
    hashes, offsets = words(texts)
    again = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes):
        same = np.append(False, hashes[1:] == hashes[:-1])
        same[offsets[:-1][offsets[:-1] < len(hashes)]] = False
        again[1:] = np.cumsum(same)
    out[:, -1] = again[offsets[1:]] - again[offsets[:-1]]
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (np.log1p(counts) * idf).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def vote(vectors: np.ndarray, ids: np.ndarray, model: Model, k: int) -> np.ndarray:
    """Share of the votes for high quality: the cosines, from 0 up, of the ``k`` nearest but the document itself; NaN without one.

    Of those at the same cosine the lowest ids vote.
    """
    out = np.empty(len(vectors))
    for a in range(0, len(vectors), _BLOCK):
        cosine = vectors[a : a + _BLOCK] @ model.vectors.T
        cosine[ids[a : a + _BLOCK, None] == model.ids[None, :]] = -1
        near = np.argsort(-cosine, axis=1, kind="stable")[:, :k] if cosine.shape[1] <= k else np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(cosine, near, 1).min(1) - _TIE
        for i in np.flatnonzero((cosine >= edge[:, None]).sum(1) > k):  # ties with the last: the lowest ids vote
            tied = np.flatnonzero(cosine[i] >= edge[i])
            near[i] = tied[np.argsort(-np.round(cosine[i, tied], 5), kind="stable")[:k]]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0)
        whole = weight.sum(1)
        out[a : a + _BLOCK] = np.where(whole > 0, (weight * model.good[near]).sum(1) / np.where(whole > 0, whole, 1), np.nan)
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, dimensions: int = DIMENSIONS) -> Model | None:
    """Null labels, texts and ids don't count; a document with several labels is of high quality if all say so. None without a label."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    votes = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    votes = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def count(batches):
        seen, total = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            part = batch.column(0).to_pylist()
            for a, b in slices(part):
                seen += (features(part[a:b]) > 0).sum(0)
                total += b - a
        yield [np.arange(-1, FEATURES), np.append(total, seen)]

    df = map_batches(texts.select("text"), count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(FEATURES + 1)
    seen[df["place"].to_numpy() + 1] = df["n"].to_numpy()
    idf = np.log((1 + seen[0]) / (1 + seen[1:])) + 1
    idf[-1] *= REPEATED

    def sample(batches):
        for batch in batches:
            part = batch.column(2).to_pylist()
            for a, b in slices(part):
                x = _weighted(features(part[a:b]), idf)
                yield [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([v.tobytes() for v in x], pa.binary())]

    chosen = map_batches(texts.join(F.broadcast(votes), "doc_id").select("doc_id", "quality", "text"), sample, "doc_id long, quality int, x binary").orderBy("doc_id", "x").toArrow()
    if not chosen.num_rows:
        return None
    x = np.frombuffer(b"".join(chosen["x"].to_pylist()), np.float32).reshape(chosen.num_rows, FEATURES)
    basis = x.T @ np.random.default_rng(7).standard_normal((len(x), dimensions + 16)).astype(np.float32)
    for _ in range(4):
        basis = x.T @ (x @ np.linalg.qr(basis)[0])
    q = np.linalg.qr(basis)[0]
    _, sizes, turn = np.linalg.svd(x @ q, full_matrices=False)
    kept = sizes[:dimensions] > 1e-6 * sizes[0]
    axes = (q @ turn[:dimensions][kept].T) / np.sqrt(sizes[:dimensions][kept])  # so that the first ones, of the language, don't decide alone
    return Model(idf, axes.astype(np.float32), _normal(x @ axes).astype(np.float32), chosen["doc_id"].to_numpy(), chosen["quality"].to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model | None, k: int = NEIGHBOURS, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id, score, high`` for every row; nothing is shuffled.

    A null text has a null score and isn't high; a text without a character, or whose neighbours all lie at a
    cosine of 0 or less, has score 0. Without a model every score is null. Repeated rows are scored each. ids
    that aren't whole numbers raise an error; other columns, whatever they are called, aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            ids, texts = batch.column(0).fill_null(-(2**63)).to_numpy(), batch.column(1).to_pylist()
            found = np.zeros(len(texts))
            for a, b in slices(texts) if m else ():
                found[a:b] = np.nan_to_num(vote(_normal(_weighted(features(texts[a:b]), m.idf) @ m.axes), ids[a:b], m, k))
            missing = np.array([m is None or x is None for x in texts], bool)
            yield [batch.column(0), pa.array(found, mask=missing), ~missing & (found >= cutoff)]

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, high boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
