"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 4 to 8 characters of the lower-cased text that don't reach over a word's ends
(one neighbouring separator counts as a character), hashed. Their presence in a document is scaled by
log((p + a) / |p|) - log((q + a) / |q|) of the documents that have them in either class; logistic regression
is fitted to the scaled presences. The cut-off is set on rows that the fit hasn't seen, but never so low that a
text without a known n-gram would be toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import char_classes, code_points, cut, map_batches, pieces, slices

#: Labelled rows that the fit uses at most, chosen by a hash of doc_id.
SAMPLE_ROWS = 20_000
#: Features of the model: the n-grams that tell the classes apart best by the likelihood-ratio test. The fit holds
#: them for all labelled rows in the driver's memory.
FEATURES = 8_192
BITS = 22
LENGTHS = range(4, 9)
#: Characters that one numpy pass works on: it makes a dozen arrays of their length.
RUN_CHARS = 1 << 18
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


@dataclass
class Model:
    weights: np.ndarray  # by hash of the n-gram
    bias: float
    cutoff: float


def _grams(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of row and n-gram where ``table`` isn't 0; whether the row has any n-gram at all. A long text is cut between words."""
    parts = [(i, part) for i, x in enumerate(texts) for part in pieces((x or "").lower(), RUN_CHARS)]
    found, any_word = [], np.zeros(len(texts), bool)
    for a, b in slices([x for _, x in parts], RUN_CHARS):
        owner = np.array([i for i, _ in parts[a:b]])
        rows, grams, has = _grams_of([x for _, x in parts[a:b]], table)
        any_word[owner[has]] = True
        found.append(owner[rows] << BITS | grams)
    merged = np.unique(np.concatenate([*found, np.zeros(0, np.int64)])) if len(found) != 1 or len(parts) > len(texts) else found[0]
    return merged >> BITS, merged & ((1 << BITS) - 1), any_word


def _grams_of(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined = " \x00 ".join(texts)
    points = code_points(f" {joined} ")
    edges = np.cumsum([0, *(len(x) + 3 for x in texts)])
    word = char_classes()[points] > 0
    points = np.where(word, points, np.uint32(32)).astype(np.uint64)
    any_word = np.add.reduceat(word.astype(np.int64), edges[:-1]) > 0 if len(points) else np.zeros(len(texts), bool)
    n = len(points)
    total = np.zeros(n, np.uint64)
    letters = np.ones(n, bool)  # all between the ends are letters
    keys = []
    for k in range(1, LENGTHS.stop):
        if n < k:
            break
        total = total[: n - k + 1] + points[k - 1 :] * _MULTIPLIERS[k - 1]
        letters = letters[: n - k + 1] & word[k - 2 : n - 1] if k > 2 else letters[: n - k + 1]
        if k not in LENGTHS:
            continue
        bucket = ((total ^ (total >> np.uint64(31))) * _MULTIPLIERS[k] >> np.uint64(64 - BITS)).astype(np.int64)
        at = np.flatnonzero(letters & table[bucket])
        rows = np.searchsorted(edges, at, "right") - 1
        keys.append(rows << BITS | bucket[at])
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found >> BITS, found & ((1 << BITS) - 1), any_word


def _fit(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, l2: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent; x: features present, by row."""
    sizes = np.fromiter(map(len, x), np.int64, len(x))
    flat = np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(x)), sizes)
    scale = ratio[flat]
    part = 0.5 / max(1, y.sum()) * y + 0.5 / max(1, (1 - y).sum()) * (1 - y)  # both classes weigh the same
    norms = np.bincount(row, scale**2, len(x)) + 1
    step = 4 / max(1e-9, float((part * norms).sum()))
    w, bias, vw, vb, wo, bo = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0
    for i in range(rounds):
        z = np.bincount(row, vw[flat] * scale, len(x)) + vb
        slope = part * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        w = vw - step * (np.bincount(flat, slope[row] * scale, len(ratio)) + l2 * vw)
        bias = vb - step * slope.sum()
        m = i / (i + 3)
        vw, vb, wo, bo = w + m * (w - wo), bias + m * (bias - bo), w, bias
    return w, bias


def _best_cutoff(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest best range by F1."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    edge = np.append(s[1:] < s[:-1], True)
    best = np.flatnonzero((f1 >= f1[edge].max() - 1e-12) & edge)
    gaps = [s[i] - s[i + 1] if i + 1 < len(s) else 1.0 for i in best]
    i = best[int(np.argmax(gaps))]
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i] - 0.5)


def log_ratios(counts: DataFrame, n_toxic: int, n_clean: int, smoothing: float = 1.0) -> DataFrame:
    """``gram, ratio, g2`` of ``gram, clean, toxic`` (documents that have it): the log-count ratio and the likelihood-ratio statistic."""
    p, q = F.col("toxic") + F.lit(smoothing), F.col("clean") + F.lit(smoothing)
    ratio = F.log(p / F.lit(n_toxic + smoothing)) - F.log(q / F.lit(n_clean + smoothing))
    share = n_toxic / (n_toxic + n_clean)
    both = F.col("toxic") + F.col("clean")
    g2 = 2 * sum(F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * F.lit(s)))).otherwise(0.0) for c, s in (("toxic", share), ("clean", 1 - share)))
    return counts.select("gram", ratio.alias("ratio"), g2.alias("g2"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, smoothing: float = 1.0) -> Model | None:
    """Fit on at most ``sample_rows`` labelled documents; None without two classes.

    A document that has several labels is toxic if one says so; null labels and texts don't count. Of n-grams that
    tell the classes apart equally well the lesser hashes are taken; the cut-off is the middle of the widest range
    of scores that are equally good.
    """
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = cut(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(labels), "doc_id").select("toxic", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("fold"), "text"))

    def count(batches):
        totals, whole, rows_by = np.zeros((2, 1 << BITS), np.int32), np.ones(1 << BITS, bool), np.zeros(2, np.int64)
        for batch in batches:
            toxic, texts = batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_pylist()
            for a, b in slices(texts, RUN_CHARS):
                rows, grams, _ = _grams(texts[a:b], whole)
                np.add.at(totals, (toxic[a:b][rows], grams), 1)
            rows_by += np.bincount(toxic, minlength=2)
        used = np.flatnonzero(totals.any(0))
        yield [used, totals[0, used].astype(np.int64), totals[1, used].astype(np.int64)]
        yield [np.array([-1]), rows_by[:1], rows_by[1:]]

    counts = cut(map_batches(sample, count, "gram long, clean long, toxic long").groupBy("gram").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    sizes = counts.where("gram = -1").first()
    if sizes is None or not sizes.clean or not sizes.toxic:
        return None
    kept = log_ratios(counts.where("gram >= 0"), sizes.toxic, sizes.clean, smoothing).orderBy(F.desc("g2"), "gram").limit(features).toArrow()
    if not kept.num_rows:
        return None
    grams, ratios = kept["gram"].to_numpy(), kept["ratio"].to_numpy()
    place = np.full(1 << BITS, -1, np.int32)
    place[grams] = np.arange(len(grams))

    def present(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            out = []
            for a, b in slices(texts, RUN_CHARS):
                rows, found, _ = _grams(texts[a:b], place >= 0)
                out += [place[x] for x in np.split(found, np.searchsorted(rows, np.arange(1, b - a)))]
            yield [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), pa.array(out, pa.list_(pa.int32()))]

    rows = map_batches(sample, present, "toxic long, fold long, features array<int>").toArrow()
    y, fold = rows["toxic"].to_numpy().astype(float), rows["fold"].to_numpy()
    x = [np.asarray(f, np.int64) for f in rows["features"].to_numpy()]
    fit = fold > 0
    if not 0 < y[fit].sum() < fit.sum() or not 0 < y[~fit].sum() < (~fit).sum():
        fit = np.ones(len(y), bool)
    held = ~fit if not fit.all() else fit
    w, bias = _fit([f for f, k in zip(x, fit) if k], y[fit], ratios)
    cutoff = _best_cutoff(np.array([(w * ratios)[f].sum() + bias for f, k in zip(x, held) if k]), y[held])
    cutoff = max(cutoff, bias)  # a text without evidence isn't toxic
    weights = np.zeros(1 << BITS, np.float32)
    weights[grams] = w * ratios
    return Model(weights, bias, cutoff)


def _scorer(model: Model | None):
    """Of a list of texts: scores, and which are toxic."""

    def run(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        scores, toxic = np.zeros(len(texts)), np.zeros(len(texts), bool)
        if model:
            table = model.weights != 0
            for a, b in slices(texts, RUN_CHARS):
                rows, grams, has = _grams(texts[a:b], table)
                scores[a:b] = np.bincount(rows, model.weights[grams], b - a) + model.bias - model.cutoff
                toxic[a:b] = has & (scores[a:b] > 0)
        return pa.array(scores, mask=np.array([x is None or model is None for x in texts], bool)), toxic

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, ``score`` (log-odds above the cut-off, more than 0 is toxic) and ``toxic`` for every row; nothing is shuffled.

    A null text has a null score; it, and a text without a word, isn't toxic, nor is one whose score is just 0.
    Without a model every score is null and nothing is toxic. Repeated rows are scored each. The broadcast model
    has a fixed size. ids that aren't whole numbers raise an error; other columns, whatever they are called, aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scored = _scorer(shared.value)
        for batch in batches:
            yield [batch.column(0), *scored(batch.column(1).to_pylist())]

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, toxic boolean")


def clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns; by row, so one with a null id is judged as any other."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        scored = _scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(~scored(batch.column(place).to_pylist())[1])).columns

    return map_batches(docs, run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
