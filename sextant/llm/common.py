"""Helpers shared by the operators: durable cuts, Arrow maps, tokens and hashes in numpy."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sextant.session import ship

#: Characters that one numpy pass works on; longer texts are cut at separators and joined again.
CHUNK_CHARS = 1 << 20
#: Powers that are kept; more are computed where a piece is longer.
CHUNK_POWERS = 1 << 21
#: Bytes up to which a side of a join is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A temporary one is made only in local mode; elsewhere, without one, ValueError."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sextant-")
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so a lost executor costs no earlier stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows in an Arrow batch where the session leaves the default, as texts can be long."""
    if int(spark.conf.get(ARROW_ROWS, "10000")) == 10000:
        spark.conf.set(ARROW_ROWS, "1000")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with just these columns, renamed: ``only(df, doc_id="long", text="string")`` casts, extra columns go."""
    return df.select(*[df[name].cast(kind).alias(name) for name, kind in columns.items()])


#: What modules keep in a worker from task to task: by module, a function that drops it.
KEPT: dict[str, Callable[[], None]] = {}


def forget(module: str) -> None:
    """Drop what other modules' tasks left in this worker."""
    for name, drop in KEPT.items():
        if name != module:
            drop()


def give_back() -> None:
    """Return freed memory to the machine: workers live on from one query's tasks to the next's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterable[list]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow where ``make`` yields lists of arrays in the order of ``schema``."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(make.__module__)
        target = to_arrow_schema(schema)
        try:
            for arrays in make(batches):
                yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) and a.type == f.type else pa.array(a, f.type) for a, f in zip(arrays, target)], schema=target)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def with_field(schema: T.StructType, name: str, kind: str) -> T.StructType:
    """``schema`` with one more nullable field."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])


def slices(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows of about ``limit`` characters; a longer text is a run of its own."""
    a = size = 0
    for b, text in enumerate(texts):
        n = len(text or "") + 1
        if size and size + n > limit:
            yield a, b
            a, size = b, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """``df`` (a cut frame), marked for broadcast if its rows, of 32 bytes and ``size`` each, are of BROADCAST_BYTES at most."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size if size is not None else F.lit(0)).alias("more")).first()
    return F.broadcast(df) if 32 * found.n + (found.more or 0) <= BROADCAST_BYTES else df


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key isn't in ``ids`` (a cut frame); rows with a null key stay."""
    gone = fresh(df, "_gone")
    ids = small(ids.select(F.col(key).alias(gone)))
    return df.join(ids, df[key] == F.col(gone), "left_anti")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.cache
def char_classes() -> np.ndarray:
    """By code point: 0 separates words, 1 belongs to one, 2 is a word of its own (scripts without spaces)."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum() or s == "_" or unicodedata.category(s)[0] == "M":
            table[c] = 1
    for a, b in ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        table[a:b] = 2 * (table[a:b] > 0)
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, back, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of these code points."""
    kind = np.zeros(len(points) + 2, np.uint8)
    kind[1:-1] = char_classes()[points]
    inner, word = kind[1:-1], kind[1:-1] > 0
    lone = inner == 2
    before, after = kind[:-2], kind[2:]
    starts = np.flatnonzero(word & ((before == 0) | lone | (before == 2)))
    ends = np.flatnonzero(word & ((after == 0) | lone | (after == 2))) + 1
    return starts, ends


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal spans have equal hashes wherever they stand."""
    up, down = _powers(max(CHUNK_POWERS, 1 << int(len(points) + 1).bit_length()))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def pieces(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut where no word is broken if there is such a place."""
    a = 0
    while len(text) - a > size:
        b = a + size
        while b < len(text) and char_classes()[ord(text[b])] == 1:
            b += 1
        yield text[a:b]
        a = b
    yield text[a:]


@functools.cache
def digit_classes() -> np.ndarray:
    return np.fromiter((chr(c).isdigit() for c in range(0x110000)), bool, 0x110000)


def words(texts: list[str | None], digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of the texts, one after another, and each text's offsets among them.

    With ``digits``, every word that has a digit gets that hash.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    run: list[str] = []
    owner: list[int] = []

    def flush() -> None:
        joined = "\x00".join(run)
        points = code_points(joined)
        starts, ends = word_spans(points)
        found = span_hashes(points, starts, ends)
        if digits is not None:
            sums = np.zeros(len(points) + 1, np.int32)
            np.cumsum(digit_classes()[points], out=sums[1:])
            found[sums[ends] > sums[starts]] = np.uint64(digits)
        hashes.append(found)
        at = np.cumsum([0, *(len(x) + 1 for x in run)])
        np.add.at(counts, np.array(owner, np.int64), np.diff(np.searchsorted(starts, at)))
        run.clear()
        owner.clear()

    size = 0
    for i, text in enumerate(texts):
        for part in pieces((text or "").lower()):
            if run and size + len(part) > CHUNK_CHARS:
                flush()
                size = 0
            run.append(part)
            owner.append(i)
            size += len(part) + 1
    if run:
        flush()
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), offsets


def blocks(batches: Iterator[pa.RecordBatch], key: int, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """The batches of a partition that is sorted by column ``key``, in tables that have each key's rows whole."""
    held: list[pa.RecordBatch] = []
    size, want = 0, rows
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < want:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        edges = np.flatnonzero(keys[1:] != keys[:-1])
        if len(edges):
            end = int(edges[-1]) + 1
            yield table.slice(0, end)
            rest = table.slice(end)
            held, size, want = rest.to_batches(), rest.num_rows, max(rows, 2 * rest.num_rows)
        else:
            want = 2 * size
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def shared_groups(keys: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of the runs of equal keys."""
    starts = run_starts(keys).tolist()
    return list(zip(starts, [*starts[1:], len(keys)]))


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd constant modulo 2**64."""
    return _powers(max(CHUNK_POWERS, 1 << int(n).bit_length()))[0][:n]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that lay the runs [start, start + length) end to end."""
    total = int(lengths.sum())
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(total)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
