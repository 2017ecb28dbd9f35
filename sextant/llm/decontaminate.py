"""Benchmark decontamination by spaced seeds.

A mask says which places of a window of words count. A window's hash takes in the words at those places
only, so it survives substitutions at the others; with several masks, some window of a passage with a few
changed words nearly always survives, and a run of ``least`` equal words always has one. Hashes of the training
documents' windows that a filter of the benchmark's hashes lets through are joined with the benchmark's. A hit
gives an alignment of the document with the item; the two are compared word by word as far as they lie side by
side: an overlap is the run of aligned words that scores best, with 1 for an equal and -``_PENALTY`` for an
unequal word, and it counts from ``least`` equal words up.

In a stretch of words that repeats itself, only the first and the last windows of their kind are seeds, which
align such stretches by their ends; all windows between would align them at every shift.

An item of fewer than ``least`` words counts where a document has it whole, word for word; one of fewer than
``SHORT`` words only where the document is nothing else.

The filter is a bitmap whose size is bounded, whatever the benchmark's. Shuffled are the windows that pass it
and the words of the documents that hit an item, which are read a second time for that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import cut, gather, map_batches, mix, powers, slices, small, without, words

#: Windows of 10 and 11 words of which 7 count.
MASKS = ("11101001101", "11010110011", "10111010011", "11001101101", "1101011011")
#: Equal words of an overlap, at least.
LEAST = 10
#: Items of fewer words must be the whole document.
SHORT = 4
_PENALTY = 2
#: A window that recurs so many places before and after lies inside a stretch that repeats itself.
PERIOD = 16
#: Bits of the filter: FILTER_BITS for each hash of the benchmark, 2**LARGEST_BITS at most.
FILTER_BITS = 256
LARGEST_BITS = 25


def _places(masks: tuple[str, ...]) -> list[np.ndarray]:
    found = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in masks]
    if not found or any(not len(x) or set(m) - {"0", "1"} for x, m in zip(found, masks)):
        raise ValueError("a mask is a string of 0 and 1 with a 1")
    return found


def windows(hashes: np.ndarray, offsets: np.ndarray, masks: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask, the hash of each window and the place of its first word; none reaches into the next text."""
    out = []
    for number, (places, width) in enumerate(zip(_places(masks), map(len, masks))):
        n = len(hashes) - width + 1
        if n <= 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        total = np.full(n, number + 1, np.uint64)
        for p, factor in zip(places, powers(len(places) + 1)[1:]):
            total += hashes[p : p + n] * factor
        marks = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(marks, np.maximum(offsets[1:-1] - width + 1, 0), 1)
        np.add.at(marks, offsets[1:-1], -1)
        out.append((mix(total), np.flatnonzero(np.cumsum(marks)[:n] == 0)))
    return [(key[at], at) if len(at) < len(key) else (key, at) for key, at in out]


def overlap(a: np.ndarray, b: np.ndarray, penalty: int = _PENALTY) -> tuple[int, int, int]:
    """Start, end and number of equal words of the best run of two aligned sequences of hashes."""
    same = a == b
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -penalty))])
    low = np.minimum.accumulate(sums)
    end = int((sums - low).argmax())
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def _inner(key: np.ndarray, at: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``some`` windows recur within PERIOD places both before and after."""
    before, after = np.zeros(len(some), bool), np.zeros(len(some), bool)
    for d in range(1, PERIOD + 1):
        low, high = np.maximum(some - d, 0), np.minimum(some + d, max(0, len(at) - 1))
        before |= (at[low] == at[some] - d) & (key[low] == key[some])
        after |= (at[high] == at[some] + d) & (key[high] == key[some])
    return before & after


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in parts], pa.binary())


def _rows(ids: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each row's id and words."""
    sizes = np.diff(offsets)
    place = gather(np.zeros(len(sizes), np.int64), sizes)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(int(sizes.max(initial=0)) + 1)[place], out=sums[1:])
    return mix(mix(ids.view(np.uint64) + powers(2)[1]) ^ mix(sums[offsets[1:]] - sums[offsets[:-1]])).view(np.int64)


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST) -> DataFrame:
    """``doc_id, item_id, n_equal, n_words``: the best overlap of each document and benchmark item that have one.

    Texts are compared by their lower-cased words. Null and texts without a word and null ids have no overlap.
    Rows that share an id count as one document or item with several texts; repeated rows count once. Of equally
    good overlaps of an item the shortest is given; a document that overlaps with several items has a row for
    each. ids that aren't whole numbers raise an error. Other columns aren't read.
    """
    _places(masks)

    def items(batches):
        for batch in batches:
            hashes, offsets = words(batch.column(1).to_pylist())
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            cuts = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            yield [batch.column(0), _binary([short[a:b] for a, b in cuts]), _binary([hashes[a:b] for a, b in cuts]), np.diff(offsets).astype(np.int32)]

    def seeds(batches):
        for batch in batches:
            for item, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = np.frombuffer(whole, np.uint64)
                own = [len(masks) + widths.index(len(hashes))] if len(hashes) in widths else range(len(masks))
                found = windows(hashes, np.array([0, len(hashes)]), every)
                for k in own:
                    key, at = found[k]
                    some = np.arange(len(at))
                    some = some[~_inner(key, at, some)]
                    yield [key[some].view(np.int64), np.full(len(some), item), at[some].astype(np.int32)]

    def marks(batches):
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            yield [np.unique(np.concatenate([key >> np.uint64(64 - bits), key & np.uint64((1 << bits) - 1)])).astype(np.int64)]

    def scan(batches):
        table = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for s, e in slices(texts):
                hashes, offsets = words(texts[s:e])
                keys, places = [], []
                for key, at in windows(hashes, offsets, every):
                    hit = np.flatnonzero(table[(key >> np.uint64(64 - bits)).astype(np.int64)])
                    hit = hit[table[(key[hit] & np.uint64((1 << bits) - 1)).astype(np.int64)]]
                    hit = hit[~_inner(key, at, hit)]
                    keys.append(key[hit])
                    places.append(at[hit])
                at = np.concatenate(places)
                if len(at):
                    row = np.searchsorted(offsets, at, "right") - 1
                    yield [_rows(ids[s:e], hashes, offsets)[row], ids[s:e][row], np.concatenate(keys).view(np.int64), (at - offsets[row]).astype(np.int32)]

    def spell(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for s, e in slices(texts):
                hashes, offsets = words(texts[s:e])
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                yield [_rows(ids[s:e], hashes, offsets), _binary([short[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])]

    def check(batches):
        for batch in batches:
            doc, total, item, text, other, shift = batch.columns
            total, shift, out = total.to_numpy(), shift.to_numpy(), []
            for i in range(batch.num_rows):
                whole = other[i].as_buffer().size // 4
                a, b = np.frombuffer(text[i].as_buffer(), np.uint32), np.frombuffer(other[i].as_buffer(), np.uint32)
                b = b[max(0, -shift[i]) :][: len(a)]
                start, end, equal = overlap(a, b)
                if equal >= min(least, whole) and (whole >= SHORT or total[i] == whole):
                    out.append((doc[i].as_py(), item[i].as_py(), equal, end - start))
            if out:
                yield [np.array(x) for x in zip(*out)]

    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    wanted = map_batches(wanted, items, "item_id long, words binary, hashes binary, n int").where("n > 0")
    wanted = cut(wanted.select(F.xxhash64("item_id", "hashes").alias("item"), "*").dropDuplicates(["item"]))
    #: Numbers of words of the items that must be found whole; fewer than ``least``.
    widths = sorted(r.n for r in wanted.where(F.col("n") < least).select("n").distinct().collect())
    every = (*masks, *("1" * n for n in widths))
    seeded = cut(map_batches(wanted.select("item", "hashes"), seeds, "key long, item long, at int"))
    bits = min(LARGEST_BITS, max(12, (FILTER_BITS * seeded.count()).bit_length()))
    table = np.zeros(1 << bits, bool)
    table[map_batches(seeded.select("key"), marks, "bit long").distinct().toArrow()["bit"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(table)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    hits = map_batches(docs, scan, "row long, doc_id long, key long, place int")
    aligned = cut(hits.join(small(seeded), "key").select("row", "doc_id", "item", (F.col("place") - F.col("at")).alias("shift")).distinct())
    found = small(aligned.select(F.col("doc_id").alias("id")).distinct())
    spelled = map_batches(docs.join(found, "id", "left_semi"), spell, "row long, words binary").dropDuplicates(["row"])
    pairs = aligned.join(spelled.select("row", F.col("words").alias("text")), "row").join(small(wanted.select("item", "item_id", "words", "n"), F.length("words")), "item")
    start = F.greatest("shift", F.lit(0))
    side = F.least(F.col("shift") + F.col("n"), F.length("text") / 4).cast("int") - start  # words that lie side by side
    part = F.expr("substring(text, 4 * greatest(shift, 0) + 1, 4 * side)")
    pairs = pairs.withColumn("side", side).select("doc_id", (F.length("text") / 4).cast("int").alias("total"), "item_id", part.alias("text"), "words", "shift")
    checked = map_batches(pairs, check, "doc_id long, item_id long, n_equal int, n_words int")
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", (-F.col("n_words")).alias("less"))).alias("best"))
    return best.select("doc_id", "item_id", "best.n_equal", (-F.col("best.less")).alias("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST) -> DataFrame:
    """``docs`` without the documents that overlap with an item; all columns stay, and rows with a null id or text."""
    return without(docs, cut(overlaps(docs, benchmark, masks, least).select("doc_id").distinct()), "doc_id")
