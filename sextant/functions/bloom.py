"""Bloom filters of arrays, as binary columns: four bytes for the number of hashes, then the bits."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED, FALSE_POSITIVES = 42, 0.01
#: Elements that are looked up at once, about.
SLICE = 1 << 18
_MASK = 2**64 - 1


def _hash(x) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(x.encode() if isinstance(x, str) else int(x).to_bytes(8, "little", signed=True), SEED)
    return h & _MASK, (h >> 64) | 1


def _hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each value; every different one is hashed once."""
    which, different = pd.factorize(values)
    found = np.array([_hash(x) for x in different], np.uint64).reshape(-1, 2)
    return found[which, 0], found[which, 1]


def _sizes(n: np.ndarray, false_positives: float) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and hashes of filters of ``n`` different values."""
    n = np.maximum(1, n)
    bits = np.maximum(8, np.ceil(-n * math.log(false_positives) / math.log(2) ** 2))
    return -(-bits.astype(np.int64) // 8), np.maximum(1, np.rint(bits / n * math.log(2))).astype(np.int64)


def make_all(lists: list, false_positives: float = FALSE_POSITIVES) -> list[bytes | None]:
    """A filter for each list, sized for its different values, nulls left out; None of None."""
    rows = [np.array([v for v in x if v is not None and v == v], object) if x is not None else np.zeros(0, object) for x in lists]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    which, different = pd.factorize(np.concatenate([*rows, np.zeros(0, object)]))
    pairs = np.unique(row.astype(np.int64) << 32 | which)
    row, which = pairs >> 32, pairs & 0xFFFFFFFF
    size, hashes = _sizes(np.bincount(row, minlength=len(rows)), false_positives)
    a, b = _hashes(different) if len(different) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    starts = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(hashes.max(initial=0))):
        use = hashes[row] > i
        r, w = row[use], which[use]
        place = (a[w] + np.uint64(i) * b[w]) % (size[r] * 8).astype(np.uint64)
        np.bitwise_or.at(data, starts[r] + (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return [None if x is None else struct.pack("<I", int(h)) + data[s : s + n].tobytes() for x, h, s, n in zip(lists, hashes, starts.tolist(), size.tolist())]


def make(values, false_positives: float = FALSE_POSITIVES) -> bytes:
    return make_all([list(values)], false_positives)[0]


def contains_all(filters: list, values: list) -> list[bool | None]:
    """Whether each filter may have the value beside it; None where either is missing."""
    there = np.array([f is not None and v is not None and v == v for f, v in zip(filters, values)], bool)
    at = np.flatnonzero(there)
    out: list[bool | None] = [None] * len(there)
    if len(at):
        parts = [filters[i] for i in at]
        sizes = np.array([len(f) for f in parts])
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(parts), np.uint8)
        hashes = np.ascontiguousarray(flat[starts[:, None] + np.arange(4)]).view("<u4")[:, 0]
        a, b = _hashes(np.array([values[i] for i in at], object))
        good = np.ones(len(at), bool)
        for i in range(int(hashes.max())):
            place = (a + np.uint64(i) * b) % ((sizes - 4) * 8).astype(np.uint64)
            bit = flat[starts + 4 + (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1
            good &= (bit > 0) | (hashes <= i)
        for i, g in zip(at.tolist(), good.tolist()):
            out[i] = g
    return out


def contains(filter_: bytes, x) -> bool:
    return bool(contains_all([filter_], [x])[0])


def array_to_bloom(values: Column) -> Column:
    """The filter of an array of integers of any width or of strings; null of null."""

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(make_all(list(s)), dtype=object)

    return run(values)


def elem_in_bloom(element: Column, bloom: Column) -> Column:
    """Whether the filter may have the element: never false for one that it was made of; null of null."""

    @F.pandas_udf(T.BooleanType())
    def run(x: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(contains_all(list(b), list(x)), dtype=object)

    return run(element, bloom)


def elems_in_bloom(elements: Column, bloom: Column) -> Column:
    """Of each element of an array whether the filter may have it, in order: the filter is sent once, not with each element."""

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def run(lists: pa.Array, filters: pa.Array) -> pa.Array:
        found = [_among(f, w) for f, w in _rows(lists, filters)]
        good, there = (np.concatenate([*x, np.zeros(0, bool)]) for x in (zip(*found) if found else ((), ())))
        ends = np.cumsum([0, *pc.fill_null(lists.value_lengths(), 0).to_pylist()]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(good, mask=~there), mask=pc.is_null(lists))

    return run(elements, bloom)


def _rows(lists: pa.Array, filters: pa.Array):
    """Each row's filter, and its elements' two hashes and whether they are there; in slices, of which every different element is hashed once."""
    lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    ends, a = np.concatenate([[0], np.cumsum(lengths)]), 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
        part = lists.slice(a, b - a)
        flat = part.flatten().dictionary_encode()
        there = pc.is_valid(flat.indices).to_numpy(zero_copy_only=False)
        which = pc.fill_null(flat.indices, 0).to_numpy(zero_copy_only=False)
        hashed = np.array([_hash(x) if x is not None and x == x else (0, 1) for x in flat.dictionary.to_pylist()] or [(0, 1)], np.uint64)
        for i in range(b - a):
            own = slice(ends[a + i] - ends[a], ends[a + i + 1] - ends[a])
            w = hashed[which[own]]
            yield filters[a + i].as_py(), (w[:, 0], w[:, 1], there[own])
        a = b


def _among(filter_: bytes | None, w: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each element whether the filter may have it, and whether that can be said."""
    a, b, there = w
    if filter_ is None:
        return np.zeros(len(a), bool), np.zeros(len(a), bool)
    hashes, bits = struct.unpack("<I", filter_[:4])[0], np.frombuffer(filter_, np.uint8, offset=4)
    good = np.ones(len(a), bool)
    for i in range(hashes):
        place = (a + np.uint64(i) * b) % np.uint64(len(bits) * 8)
        good &= (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1) > 0
    return good, there
