"""Line dedup with a log-template tree.

A line's words lead it down a tree of fixed depth: first by their number, then by the leading words, where a
word with a digit is a variable field. In a leaf, lines join the template to which most positions are equal,
if these are a share of at least ``similar``; the others become variable fields. A template that occurs in
more than one document recurs: the document with the smallest doc_id keeps its lines, all others lose theirs.

Only hashes travel: words as 32-bit codes, once for each distinct line of a batch, to the leaf's task.

Of what the lines leave, passages of ``PASSAGE`` words or more that recur go, too, wherever they stand in
their lines: a window of so many words is a unit, exact in all its words. Windows have the least of their
shorter windows' hashes as fingerprint, so only those whose fingerprint recurs are looked at one by one.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import CHUNK_POWERS, _powers, blocks, code_points, cut, fresh, gather, map_batches, mix, powers, run_starts, slices, small, with_field, word_spans, words

#: Leading words that the tree goes by, after the number of words.
LEADING = 3
#: Least share of equal positions in a template.
SIMILAR = 0.8
#: Lines of fewer words are equal in all words or not at all.
SHORT = 3
#: Words of a passage that recurs anywhere in lines, at least; an odd number.
PASSAGE = 51
_VARIABLE = 0x5851F42D4C957F2D


def _lines(texts: list[str | None], leading: int, least: int):
    """For each line of at least ``least`` words: text's row, line number, leaf, pattern, words, place of the first."""
    split = [x.split("\n") if x is not None else [] for x in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    hashes, offsets = words([line for x in split for line in x], digits=_VARIABLE)
    sizes = np.diff(offsets)
    few = np.flatnonzero((sizes > 0) & (sizes < SHORT))
    if len(few):  # of so few words a line is a template as it is: its digits aren't variable
        lines = [line for x in split for line in x]
        hashes = hashes.copy()
        hashes[gather(offsets[few], sizes[few])] = words([lines[i] for i in few.tolist()])[0]
    row = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    fit = np.flatnonzero(sizes >= max(1, least))
    row, number, size, start = row[fit], number[fit], sizes[fit], offsets[fit]
    if not len(fit):
        return row, number, np.zeros(0, np.int64), np.zeros(0, np.int64), size, start, hashes
    place = gather(np.zeros(len(fit), np.int64), size)
    kept = gather(start, size)
    whole = np.add.reduceat(hashes[kept] * powers(int(size.max()))[place], np.cumsum(size) - size)
    leaf = size.astype(np.uint64) * np.uint64(_VARIABLE | 1)
    for k in range(leading):
        has = size > k
        leaf[has] += hashes[start[has] + k] * powers(leading + 1)[k + 1]
    return row, number, mix(leaf).view(np.int64), mix(whole + size.astype(np.uint64)).view(np.int64), size, start, hashes


def _cluster(codes: np.ndarray, similar: float) -> np.ndarray:
    """The template of each line (a row of codes; 0 is variable); lines come in order and templates generalise."""
    n, width = codes.shape
    need = int(np.ceil(similar * width - 1e-9))
    probe = min(width, width - need + 1)  # a line that is similar equals the template at one of the last ``probe`` places
    templates: list[np.ndarray] = []
    at: dict[tuple[int, int], list[int]] = defaultdict(list)
    out = np.empty(n, np.int64)
    for i in range(n):
        line = codes[i]
        keys = [(k, int(line[k])) for k in range(width - probe, width)]
        near = sorted({t for key in keys for t in at.get(key, ())})
        best = -1
        if near:
            same = (np.array([templates[t] for t in near]) == line).sum(1)
            k = int(same.argmax())
            if same[k] >= need:
                best = near[k]
        if best < 0:
            best = len(templates)
            templates.append(line.astype(np.int64))
            for key in keys:
                at[key].append(best)
        else:
            templates[best] = np.where(templates[best] == line, templates[best], -1)
        out[i] = best
    return out


def templates(docs: DataFrame, leading: int = LEADING, similar: float = SIMILAR, least: int = 1) -> DataFrame:
    """``pattern`` (hash of a line's words) and ``keeper`` (the doc_id that keeps it), of recurring templates."""

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                row, _, leaf, pattern, size, start, hashes = _lines(texts[a:b], leading, least)
                if not len(row):
                    continue
                doc = ids[a:b][row]
                order = np.lexsort((doc, pattern))
                first = order[run_starts(pattern[order])]
                last = order[np.append(run_starts(pattern[order])[1:], len(order)) - 1]
                codes = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                codes = np.where(hashes == np.uint64(_VARIABLE), np.uint32(0), codes)[gather(start[first], size[first])]
                ends = np.concatenate([[0], np.cumsum(4 * size[first])]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(codes)])
                yield [leaf[first], pattern[first], doc[first], doc[last], binary]

    def settle(batches):
        for table in blocks(batches, 0):
            leaf, pattern, low, high = (table.column(i).to_numpy() for i in range(4))
            line = table.column(4)
            order = np.lexsort((low, pattern, leaf))
            leaf, pattern, low, high = leaf[order], pattern[order], low[order], high[order]
            first = np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (pattern[1:] != pattern[:-1])))
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            leaf, pattern, where = leaf[first], pattern[first], order[first]
            starts = run_starts(leaf)
            ends = np.append(starts[1:], len(leaf))
            lone = starts[ends - starts == 1]
            lone = lone[low[lone] < high[lone]]
            out = [(pattern[lone], low[lone])]
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                if low[a:b].min() == high[a:b].max():
                    continue
                by = a + np.lexsort((pattern[a:b], low[a:b]))
                rows = [np.frombuffer(line[int(i)].as_buffer(), np.uint32) for i in where[by]]
                width = len(rows[0])
                same = np.array([len(x) == width for x in rows])  # lines of another length share the leaf by a hash collision only
                group = np.full(len(by), -1)
                group[same] = _cluster(np.array([x for x, s in zip(rows, same) if s]), similar)
                group[~same] = group.max() + 1 + np.arange((~same).sum())
                keeper, latest = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
                np.minimum.at(keeper, group, low[by])
                np.maximum.at(latest, group, high[by])
                recurs = keeper[group] < latest[group]
                out.append((pattern[by][recurs], keeper[group][recurs]))
            yield [np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])]

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    lines = map_batches(docs, scan, "leaf long, pattern long, low long, high long, words binary")
    return map_batches(lines.repartition("leaf").sortWithinPartitions("leaf"), settle, "pattern long, keeper long")


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on."""
    up, down = _powers(max(CHUNK_POWERS, 1 << int(len(hashes) + 1).bit_length()))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1] + np.uint64(n))


def _windows(texts: list[str | None], size: int):
    """For each window of ``size`` words: the text's row, the first word's place in the text, the hashes of the window and of its fingerprint."""
    hashes, offsets = words(texts)
    if len(hashes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    half = size // 2 + 1
    low = _grams(hashes, half)
    span = 1
    while 2 * span <= half:  # the least of ``span`` neighbours
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - half + span], low[half - span :])
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    at = gather(offsets[:-1], counts)
    row = np.repeat(np.arange(len(texts)), counts)
    return row, at - offsets[row], _grams(hashes, size)[at].view(np.int64), low[at].view(np.int64)


def _without_lines(text: str, drop: set[int]) -> tuple[str, int]:
    """The text without lines by number, and how many they are."""
    lines = text.split("\n")
    kept = [x for k, x in enumerate(lines) if k not in drop]
    return "\n".join(kept), len(lines) - len(kept)


def _without_passages(text: str, drop: np.ndarray, size: int) -> tuple[str, int]:
    """The text without the words of these windows, and how many lines lost words; those left without words go."""
    _, at, window, _ = _windows([text], size)
    starts, ends = word_spans(code_points(text))
    gone = np.zeros(len(starts) + 1, np.int64)
    at = at[np.isin(window, drop)]
    np.add.at(gone, at, 1)
    np.add.at(gone, at + size, -1)
    gone = np.cumsum(gone)[:-1] > 0
    out, lost, place, first = [], 0, 0, 0
    for line in text.split("\n"):
        last = int(np.searchsorted(starts, place + len(line)))
        mine = gone[first:last]
        if not mine.any():
            out.append(line)
        else:
            lost += 1
            if not mine.all():
                keep, cursor = [], place
                for a, b in zip(*(np.flatnonzero(np.diff(np.concatenate([[0], mine, [0]])) == d) + first for d in (1, -1))):
                    keep.append(text[cursor : starts[a]])
                    cursor = int(starts[b]) if b < last else place + len(line)
                out.append("".join([*keep, text[cursor : place + len(line)]]))
        place, first = place + len(line) + 1, last
    return "\n".join(out), lost


def _join(docs: DataFrame, found: DataFrame, key: str, how: str) -> DataFrame:
    """``docs`` with the columns of ``found`` (a cut frame; but the id, arrays of numbers) by id."""
    size = sum((F.coalesce(F.size(c), F.lit(0)) * 8 for c in found.columns if c != key), F.lit(0))
    return docs.join(small(found, size), docs["doc_id"].cast("long") == F.col(key), how).drop(key)


def passages(docs: DataFrame, size: int = PASSAGE) -> DataFrame:
    """``id, cuts`` (hashes of windows that go) of the documents with windows of ``size`` words that an earlier one has; ``docs`` has ``doc_id, text, gone`` (lines left out)."""

    def read(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            texts = [_without_lines(t, set(g))[0] if g else t for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            for a, b in slices(texts):
                row, _, window, low = _windows(texts[a:b], size)
                yield batch, a, ids[a:b][row], row, window, low

    def fingerprints(batches):
        for _, _, doc, row, _, low in read(batches):
            first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
            yield [low[first], doc[first]]

    def units(batches):
        for batch, a, doc, row, window, low in read(batches):
            edges, prints = np.searchsorted(row, np.arange(int(row.max(initial=-1)) + 2)), batch.column(3)
            for k in range(len(edges) - 1):
                part = slice(edges[k], edges[k + 1])
                hit = np.unique(window[part][np.isin(low[part], prints[a + k].values.to_numpy())]) if edges[k] < edges[k + 1] else np.zeros(0, np.int64)
                if len(hit):
                    yield [hit, np.full(len(hit), doc[edges[k]])]

    def later(rows: DataFrame, to: str, keep: str) -> DataFrame:
        """By document, its hashes that recur; with ``keep``, those that an earlier document keeps."""
        both = cut(rows.groupBy("hash").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").drop("high"))
        return cut(rows.join(small(both), "hash").where(keep).groupBy("doc").agg(F.collect_set("hash").alias(to)).withColumnRenamed("doc", "id"))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "gone").where("doc_id is not null and text is not null")
    prints = later(cut(map_batches(docs, fingerprints, "hash long, doc long").distinct()), "prints", "true")
    near = _join(docs, prints, "id", "inner")
    return later(cut(map_batches(near, units, "hash long, doc long").distinct()), "cuts", "doc > low")


def drop_lines(docs: DataFrame, leading: int = LEADING, similar: float = SIMILAR, least: int = 1, passage: int = PASSAGE) -> DataFrame:
    """``docs`` with recurring lines and passages taken out of ``text``, and ``n_lines`` (before) and ``n_dropped``.

    ``n_dropped`` counts the lines that went or lost a passage of ``passage`` words or more (0: passages stay).
    All rows and columns stay; columns called n_lines or n_dropped are replaced. A document all of whose lines
    recur elsewhere is left with an empty text, a null text stays null, with no lines. Rows with a null doc_id
    are left as they are and count for no template. Rows that share a doc_id are one document: what recurs only
    among them stays. Empty lines and those of fewer than ``least`` words stay. A line that is equally near to
    two templates joins the older. ids that aren't whole numbers raise an error; other columns may have any name.
    """
    docs = docs.drop("n_lines", "n_dropped")
    found = cut(templates(docs, leading, similar, least))

    def patterns(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                row, number, _, pattern, _, _, _ = _lines(texts[a:b], leading, least)
                yield [pattern, ids[a:b][row], number.astype(np.int32)]

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    lines = map_batches(named, patterns, "pattern long, id long, line int")
    gone = lines.join(small(found), "pattern").where("id > keeper")
    gone = cut(gone.groupBy("id").agg(F.collect_set("line").alias("gone")))
    owner, lost, cuts = fresh(docs, "_gone_id"), fresh(docs, "gone"), fresh(docs, "cuts")
    joined = _join(docs, gone.select(F.col("id").alias(owner), F.col("gone").alias(lost)), owner, "left")
    if passage:
        again = _join(named, gone.withColumnRenamed("id", owner), owner, "left")
        joined = _join(joined, passages(again, passage).select(F.col("id").alias(owner), F.col("cuts").alias(cuts)), owner, "left")
    else:
        joined = joined.withColumn(cuts, F.lit(None).cast("array<long>"))
    place = docs.columns.index("text")

    def strip(batches):
        for batch in batches:
            texts, drops = batch.column(place).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()
            windows = batch.column(batch.num_columns - 1)
            counts, lost = [], []
            for i, (text, drop) in enumerate(zip(texts, drops)):
                counts.append(0 if text is None else text.count("\n") + 1)
                lost.append(0)
                if text is not None and drop:
                    texts[i], lost[i] = _without_lines(text, set(drop))
                if text is not None and windows[i].is_valid:
                    texts[i], more = _without_passages(texts[i], windows[i].values.to_numpy(), passage)
                    lost[i] += more
            columns = list(batch.columns)[:-2]
            columns[place] = pa.array(texts, pa.string())
            yield [*columns, pa.array(counts, pa.int32()), pa.array(lost, pa.int32())]

    return map_batches(joined, strip, with_field(with_field(docs.schema, "n_lines", "int"), "n_dropped", "int"))
