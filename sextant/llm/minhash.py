"""MinHash near-dedup by an inverted join of signature coordinates.

A signature has one 64-bit minimum for each of ``COORDINATES`` hash functions over a text's shingles of words.
Signatures are posted under each pair of coordinate and value. Two signatures match if they agree in at least
``least`` coordinates, which is counted over the posting lists with two savings that lose no pair:

* prefix: a value that no other signature has goes, and a signature with fewer than ``least`` values left; of
  the m left, in an order by rarity that is the same everywhere, only the m - least + 1 rarest are merged,
  since a pair with ``least`` common values has one of them in both prefixes;
* skip: the longer lists behind the prefix aren't merged; the coordinates that they stand for are compared
  directly, and a list whose signatures a task has already linked is skipped.

In a list, each signature is compared with those that aren't linked yet, so that a list of n copies costs n
comparisons and gives n - 1 links, not all pairs; the groups are those of all matching pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import blocks, cut, map_batches, mix, powers, run_starts, slices, without, words

COORDINATES = 64
#: Coordinates in which two signatures agree at least to match (an estimated Jaccard similarity of 0.56).
LEAST = 36
#: Words in a shingle; a shorter text is one shingle.
SHINGLE = 3


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(texts: list[str | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, one after another, and how many each has."""
    hashes, offsets = words(texts)
    sizes = np.diff(offsets)
    factors = powers(width)
    found = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width if len(found) else 0):
        found += hashes[k : len(hashes) - width + 1 + k] * factors[k]
    counts = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(hashes)) + width <= offsets[owner + 1] if len(hashes) else np.zeros(0, bool)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    inside[offsets[short]] = True
    full = np.zeros(len(hashes), np.uint64)
    full[: len(found)] = found
    for i in short:
        full[offsets[i]] = (hashes[offsets[i] : offsets[i + 1]] * factors[: sizes[i]]).sum(dtype=np.uint64)
    return mix(full[inside]), counts


def signatures(texts: list[str | None], coordinates: int = COORDINATES, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a word, and for each its posting keys: coordinate-value pairs, the coordinate in the low 6 bits."""
    if not 1 <= coordinates <= 64:
        raise ValueError("coordinates must be between 1 and 64")
    found, counts = shingle_hashes(texts, width)
    rows = np.flatnonzero(counts)
    out = np.empty((len(rows), coordinates), np.uint64)
    if len(rows):
        starts = (np.cumsum(counts) - counts)[rows]
        for k, factor in enumerate(_multipliers(coordinates)):
            least = np.minimum.reduceat(found * factor, starts)
            out[:, k] = mix(least + factor) & np.uint64(2**64 - 64) | np.uint64(k)
    return rows, out


def _codes(keys: np.ndarray) -> np.ndarray:
    """32 bits of a posting key's value, never 0."""
    return (keys >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class _Links:
    """Linked nodes of a task, and the links that joined two of its groups."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        r = x
        while (p := parent.get(r, r)) != r:
            r = p
        while (p := parent.get(x, x)) != r:
            parent[x], x = r, p
        return r

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def _merge_list(nodes: np.ndarray, codes: np.ndarray, least: int, found: _Links) -> None:
    """Link the nodes of a posting list that match, comparing each only with those not linked yet."""
    values = nodes.tolist()
    if len({found.root(x) for x in values}) == 1:
        return
    centre, queue, left = 0, [], np.arange(1, len(values))
    while len(left):
        same = ((codes[left] == codes[centre]) & (codes[centre] != 0)).sum(1) >= least
        near, left = left[same].tolist(), left[~same]
        for i in near:
            found.link(values[centre], values[i])
        queue += near
        if queue:
            centre = queue.pop()
        elif len(left):
            centre, left = int(left[0]), left[1:]


def matching(docs: DataFrame, least: int = LEAST, coordinates: int = COORDINATES, width: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``doc_id, node`` of all documents with a word (node: hash of the signature), and links between nodes.

    The links join exactly the nodes that chains of matching pairs join.
    """
    if not 1 <= least <= coordinates:
        raise ValueError("least must be between 1 and coordinates")

    def sign(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                rows, keys = signatures(texts[a:b], coordinates, width)
                if not len(rows):
                    continue
                node = mix((keys * _multipliers(coordinates)).sum(1, dtype=np.uint64)).view(np.int64)
                ends = (np.arange(len(rows) + 1) * 8 * coordinates).astype(np.int32)
                yield [ids[a:b][rows], node, pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(keys))])]

    def post(batches):
        for batch in batches:
            node, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            column = batch.column(1).take(pa.array(first))
            keys = np.frombuffer(b"".join(column.to_pylist()), np.int64)
            yield [keys, np.repeat(node, coordinates)]

    def shared(batches):
        for table in blocks(batches, 0):
            key, node = table.column(0).to_numpy(), table.column(1).to_numpy()
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node = key[new], node[new]
            starts = run_starts(key)
            counts = np.diff(np.append(starts, len(key)))
            many = np.repeat(counts > 1, counts)
            yield [node[many], key[many], np.repeat(counts, counts)[many]]

    def prefix(batches):
        for table in blocks(batches, 0):
            node, key, count = (table.column(i).to_numpy() for i in range(3))
            starts = run_starts(node)
            sizes = np.diff(np.append(starts, len(node)))
            keep = np.repeat(sizes >= least, sizes)
            node, key, count = node[keep], key[keep], count[keep]
            if not len(node):
                continue
            order = np.lexsort((key, count, node))
            node, key = node[order], key[order]
            starts = run_starts(node)
            sizes = np.diff(np.append(starts, len(node)))
            row = np.repeat(np.arange(len(starts)), sizes)
            codes = np.zeros((len(starts), coordinates), np.uint32)
            codes[row, key & 63] = _codes(key.view(np.uint64))
            taken = np.arange(len(node)) - starts[row] < (sizes - least + 1)[row]
            for part in np.array_split(np.flatnonzero(taken), max(1, int(taken.sum()) // 50_000)):
                flat = np.ascontiguousarray(codes[row[part]])
                ends = (np.arange(len(part) + 1) * 4 * coordinates).astype(np.int32)
                yield [key[part], node[part], pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(flat)])]

    def merge(batches) -> Iterator[list]:
        found = _Links()
        for table in blocks(batches, 0, 1 << 14):
            key, node = table.column(0).to_numpy(), table.column(1).to_numpy()
            starts = run_starts(key)
            sizes = np.diff(np.append(starts, len(key)))
            listed = np.repeat(sizes > 1, sizes)
            if not listed.any():
                continue
            codes = np.frombuffer(b"".join(table.column(2).filter(pa.array(listed)).to_pylist()), np.uint32).reshape(-1, coordinates)
            node, sizes = node[listed], sizes[sizes > 1]
            starts = np.cumsum(sizes) - sizes
            two = starts[sizes == 2]
            a, b = codes[two], codes[two + 1]
            match = ((a == b) & (a != 0)).sum(1) >= least
            for x, y in zip(node[two[match]].tolist(), node[two[match] + 1].tolist()):
                found.link(x, y)
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                _merge_list(node[s : s + n], codes[s : s + n], least, found)
        if found.links:
            links = np.array(found.links, np.int64)
            yield [links[:, 0], links[:, 1]]

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    signed = cut(map_batches(docs, sign, "doc_id long, node long, keys binary"))
    posts = map_batches(signed.select("node", "keys"), post, "key long, node long")
    lists = map_batches(posts.repartition("key").sortWithinPartitions("key", "node"), shared, "node long, key long, n long")
    rare = map_batches(lists.repartition("node").sortWithinPartitions("node"), prefix, "key long, node long, codes binary")
    links = map_batches(rare.repartition("key").sortWithinPartitions("key"), merge, "a long, b long")
    return signed.select("doc_id", "node"), cut(links)


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that ``a, b`` links join it with. Alternates large and small stars, each round written out."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now


def near_duplicates(docs: DataFrame, least: int = LEAST, coordinates: int = COORDINATES, width: int = SHINGLE) -> DataFrame:
    """``doc_id, kept_doc_id``: the documents that go and the one of their group that stays (the smallest doc_id).

    Documents of one group are joined by chains of matching pairs. Null and empty texts, those without a word
    and rows with a null doc_id are in no group. Rows that share a doc_id are one document: they stay or go
    together. Other columns aren't read.
    """
    nodes, links = matching(docs, least, coordinates, width)
    labels = components(links)
    members = nodes.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    groups = members.groupBy("label").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("last")).where("last > kept_doc_id").drop("last")
    return members.join(groups, "label").where("doc_id > kept_doc_id").groupBy("doc_id").agg(F.min("kept_doc_id").alias("kept_doc_id"))


def keep_one(docs: DataFrame, least: int = LEAST, coordinates: int = COORDINATES, width: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` names; all columns stay."""
    return without(docs, cut(near_duplicates(docs, least, coordinates, width)), "doc_id")
