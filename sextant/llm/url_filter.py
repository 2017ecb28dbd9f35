"""URL filter: the ratio of two character language models.

One model is of accepted, one of rejected addresses. Each is a Markov model of variable order: the chance of
a character after the longest context is smoothed with that after the next shorter one (Witten-Bell), down to
all characters alike. An address's score is the difference of its log-likelihoods, divided by its length; it
is rejected above a threshold that is set on labelled addresses of hosts which the models haven't seen.

The models are counts of all labelled addresses, summed by Spark and exact; they grow with the input, and aren't
broadcast. A window is a character with the ``order`` ones before it. Each different window is looked up
once, by joins with the counts, which gives its share of the score; addresses then add up their windows' shares.
The shares are broadcast if they are of BROADCAST_BYTES at most, otherwise the windows of the different
addresses are shuffled. The threshold takes in all held-out addresses, counted by score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import common
from sextant.llm.common import cut, map_batches, mix, powers, small

#: Characters of the longest context; at most 7, as a window is one 64-bit number.
ORDER = 5
#: Scores are counted in steps of 1 / STEPS for the threshold, at most RANGE from 0.
STEPS, RANGE = 1000, 30
_ALPHABET = 256
_HOST = r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass
class Model:
    counts: DataFrame  # gram, context, n0, n1: by class, how often a character follows a context
    threshold: float
    order: int = ORDER


def host(url: str = "url"):
    """The host's name in lower case; "" without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def _windows(urls: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each character (the end is one): its address's row, and it with the ``order`` characters before, as one number."""
    data = [np.frombuffer(b"\x02" * order + u.lower().encode("utf-8", "surrogatepass") + b"\x03", np.uint8) for u in urls]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.concatenate([*data, np.zeros(0, np.uint8)]).astype(np.uint64)
    row = np.repeat(np.arange(len(data)), sizes)
    at = np.flatnonzero(np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= order)
    window = np.zeros(len(at), np.uint64)
    for k in range(order, -1, -1):
        window = window << np.uint64(8) | flat[at - k]
    return row[at], window.view(np.int64)


def _orders(window: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length of the context: hashes of the context, and of it and the character."""
    whole = window.view(np.uint64)
    out = []
    for k in range(order + 1):
        gram = whole & np.uint64((1 << 8 * (k + 1)) - 1)
        seed = powers(order + 3)[k + 1]
        out.append((mix((gram >> np.uint64(8)) ^ seed).view(np.int64), mix(mix(gram ^ seed) + np.uint64(1)).view(np.int64)))
    return out


def _counted(rows: DataFrame, order: int) -> DataFrame:
    """Counts of ``url, rejected``."""

    def count(batches):
        for batch in batches:
            label = batch.column(1).to_numpy()
            row, window = _windows(batch.column(0).to_pylist(), order)
            for context, gram in _orders(window, order):
                own = label[row]
                _, first, back = np.unique(gram, return_index=True, return_inverse=True)
                yield [gram[first], context[first], np.bincount(back, 1 - own).astype(np.int64), np.bincount(back, own).astype(np.int64)]

    counts = map_batches(rows.select("url", "rejected"), count, "gram long, context long, n0 long, n1 long")
    return cut(counts.groupBy("gram", "context").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def _shares(urls: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """``window, share`` of every window of the addresses: log-likelihood as rejected less that as accepted."""

    def windows(batches):
        for batch in batches:
            yield [np.unique(_windows(batch.column(0).to_pylist(), order)[1])]

    def lengths(batches):
        for batch in batches:
            window = batch.column(0).to_numpy()
            for k, (context, gram) in enumerate(_orders(window, order)):
                yield [window, np.full(len(window), k), context, gram]

    distinct = map_batches(urls, windows, "window long").distinct()
    looked = map_batches(distinct, lengths, "window long, k int, context long, gram long")
    kind = lambda c: F.sum((F.col(c) > 0).cast("long"))
    contexts = counts.groupBy("context").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), kind("n0").alias("t0"), kind("n1").alias("t1"))
    found = looked.join(counts.select("gram", "n0", "n1"), "gram", "left").join(contexts, "context", "left")
    columns = [f"{c}{i}" for i in (0, 1) for c in "nct"]
    by = found.groupBy("window").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in range(order + 1) for c in columns])

    def smooth(batches):
        for batch in batches:
            of = {name: batch.column(i + 1).fill_null(0).to_numpy().astype(float) for i, name in enumerate(names)}
            logs = []
            for i in (0, 1):
                p = np.full(batch.num_rows, 1 / _ALPHABET)
                for k in range(order + 1):
                    n, c, t = (of[f"{x}{i}_{k}"] for x in "nct")
                    p = np.where(c > 0, (n + t * p) / np.maximum(c + t, 1), p)
                logs.append(np.log(p))
            yield [batch.column(0), logs[1] - logs[0]]

    names = by.columns[1:]
    return cut(map_batches(by, smooth, "window long, share double"))


def scores(urls: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``url, score`` of each different address that isn't null: log-likelihood as rejected less that as accepted, by character."""
    urls = urls.select(F.col("url").cast("string").alias("url")).where("url is not null").distinct()
    shares = _shares(urls, counts, order)
    if 16 * shares.count() <= common.BROADCAST_BYTES:
        table = shares.orderBy("window").toArrow()
        shared = urls.sparkSession.sparkContext.broadcast((table["window"].to_numpy(), table["share"].to_numpy()))

        def add(batches):
            known, share = shared.value
            for batch in batches:
                row, window = _windows(batch.column(0).to_pylist(), order)
                found = np.bincount(row, share[np.searchsorted(known, window)], batch.num_rows) if len(row) else np.zeros(batch.num_rows)
                yield [batch.column(0), found / np.maximum(1, np.bincount(row, minlength=batch.num_rows))]

        return map_batches(urls, add, "url string, score double")

    def each(batches):
        for batch in batches:
            row, window = _windows(batch.column(0).to_pylist(), order)
            yield [batch.column(0).take(pa.array(row)), window]

    rows = map_batches(urls, each, "url string, window long").groupBy("url", "window").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(shares, "window").groupBy("url").agg((F.sum(F.col("n") * F.col("share")) / F.sum("n")).alias("score"))


def best_cutoff(score: np.ndarray, bad: np.ndarray, good: np.ndarray) -> float:
    """The middle of the widest range that is best by F1; of scores in order, how many are of either class."""
    hit, all_ = np.cumsum(bad[::-1])[::-1], np.cumsum((bad + good)[::-1])[::-1]
    f1 = 2 * hit / (all_ + bad.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    below = np.append(score[0] - 1, score[:-1])
    i = best[int(np.argmax(score[best] - below[best]))]
    return float((score[i] + below[i]) / 2)


def train(labelled: DataFrame, order: int = ORDER) -> Model | None:
    """Models of ``url, rejected``; None without both classes. Null addresses and labels don't count; repeated rows count each.

    A fifth of the hosts, by hash, is held out of the counts and sets the threshold. Without both classes there,
    or in what is left, the addresses of all hosts do both.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be between 1 and 7")
    rows = labelled.where("url is not null and rejected is not null").select(F.col("url").cast("string").alias("url"), F.col("rejected").cast("int").alias("rejected"))
    rows = rows.withColumn("held", F.pmod(F.xxhash64(host()), F.lit(5)) == 0)
    sizes = {(r.held, r.rejected): r.n for r in rows.groupBy("held", "rejected").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(any(sizes.get((h, c)) for h in (False, True)) for c in (0, 1)):
        return None
    fit, held = (rows.where("not held"), rows.where("held")) if all(sizes.get((h, c)) for h in (False, True) for c in (0, 1)) else (rows, rows)
    counts = _counted(fit, order)
    step = F.round(F.least(F.greatest(F.col("score"), F.lit(-RANGE)), F.lit(RANGE)) * STEPS).cast("int").alias("step")
    by = held.join(scores(held, counts, order), "url").groupBy(step).agg(F.sum("rejected").alias("bad"), F.sum(1 - F.col("rejected")).alias("good")).orderBy("step").toArrow()
    return Model(counts, best_cutoff(by["step"].to_numpy() / STEPS, by["bad"].to_numpy(), by["good"].to_numpy()), order)


def apply(pages: DataFrame, model: Model | None) -> DataFrame:
    """``page_id, score, rejected`` for every row.

    A null address has a null score and isn't rejected; without a model, scores are null and nothing is. An empty
    address is scored by its end alone; a score that is just the threshold isn't rejected. Repeated rows have a
    result each. ids that aren't whole numbers raise an error; other columns, whatever they are called, aren't read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    if model is None:
        return rows.select("page_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("rejected"))
    found = small(cut(scores(rows, model.counts, model.order)), F.length("url"))
    scored = rows.join(found, "url", "left")
    return scored.select("page_id", "score", F.coalesce(F.col("score") > model.threshold, F.lit(False)).alias("rejected"))


def filtered(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """``pages`` judged by models of ``labelled`` (``url, rejected``)."""
    return apply(pages, train(labelled))
