"""WARC archives compressed by Zstandard with a dictionary of their own.

A file starts with a skippable frame that holds the dictionary, which is built from all the records of that
file; then each record is a frame of its own, so that one can be read by its offset alone. A task closes a
file when its records reach ``roll`` bytes, which bounds what it holds in memory and what a dictionary is
built from, at any size of the input.

Files have random names and count only if the index names them: a task that is run again leaves files that
nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import cut, map_batches, shared_dir

#: Magic number of the dictionary's frame.
SKIPPABLE = 0x184D2A5D
#: Bytes of records in a file, about.
ROLL = 16 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record(page_id: int | None, url: str | None, html: str | None, date: str) -> bytes:
    """A resource record. Nulls and addresses with control characters are kept in fields of their own."""
    body = (html or "").encode()
    fields = [("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {url}')}>"), ("WARC-Date", date)]
    if url is not None:
        plain = url.isprintable() and url == url.strip()
        fields += [("WARC-Target-URI", url if plain else json.dumps(url)), *([] if plain else [("X-Quoted-URI", "1")])]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if html is None:
        fields.append(("X-Null-Block", "1"))
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    fields += [("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Built from all the records; where they are too few or too short for that, the records themselves."""
    try:
        return zstandard.train_dictionary(max(256, min(size, sum(map(len, records)) // 10)), records, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:size].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes], level: int = LEVEL, size: int = DICTIONARY_BYTES) -> tuple[bytes, list[int], list[int]]:
    """The file's bytes, and each record's offset and length in it."""
    shared = dictionary(records, size)
    data = shared.as_bytes()
    out = bytearray(struct.pack("<II", SKIPPABLE, len(data)) + data)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
    offsets, lengths = [], []
    for r in records:
        frame = compressor.compress(r)
        offsets.append(len(out))
        lengths.append(len(frame))
        out += frame
    return bytes(out), offsets, lengths


def unpack(data: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """A decompressor with the file's dictionary, and where the records start."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])), 8 + size


def parse(stream) -> list[tuple[dict[str, str], bytes]]:
    """Fields and body of each record of an uncompressed stream."""
    out = []
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("no WARC record")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line[:-2].decode().partition(": ")
            fields[k] = v
        body = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        out.append((fields, body))
    return out


def write(pages: DataFrame, folder: str, roll: int = ROLL, level: int = LEVEL, size: int = DICTIONARY_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive all rows below ``folder``, and return the index: ``page_id, path, offset, length``.

    Every row is a record, repeated ones too; a null page_id, url or html is kept as such. No rows make no
    file. Other columns aren't archived. The index is written out, so reading it doesn't write again.
    """
    target, root = fs.FileSystem.from_uri(folder)
    target.create_dir(root, recursive=True)

    def run(batches):
        store, top = fs.FileSystem.from_uri(folder)
        held: list[bytes] = []
        ids: list[int | None] = []

        def close() -> list:
            data, offsets, lengths = pack(held, level, size)
            path = f"{top}/{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(path, compression=None) as f:
                f.write(data)
            rows = [pa.array(ids, pa.int64()), pa.array([path.rsplit("/", 1)[1]] * len(ids)), offsets, lengths]
            held.clear()
            ids.clear()
            return rows

        total = 0
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page_id, url, html, date))
                ids.append(page_id)
                total += len(held[-1])
                if total >= roll:
                    yield close()
                    total = 0
        if held:
            yield close()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cut(map_batches(rows, run, "page_id long, path string, offset long, length long"))


def read(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, html`` of all records of the files that ``index`` (a cut frame) names; a task reads a file or a few."""
    paths = index.select("path").distinct()
    paths = paths.repartition(max(1, min(paths.count(), 8 * spark.sparkContext.defaultParallelism)))  # names are few bytes: left alone they'd be one task's

    def run(batches):
        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{top}/{path}", compression=None) as f:
                    data = f.read()
                reader, start = unpack(data)
                rows = parse(io.BufferedReader(reader.stream_reader(io.BytesIO(data[start:]), read_across_frames=True)))
                for a in range(0, len(rows), 1000):
                    part = rows[a : a + 1000]
                    ids = [int(f["X-Page-ID"]) if "X-Page-ID" in f else None for f, _ in part]
                    urls = [json.loads(f["WARC-Target-URI"]) if "X-Quoted-URI" in f else f.get("WARC-Target-URI") for f, _ in part]
                    yield [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array([None if "X-Null-Block" in f else b.decode() for f, b in part], pa.string())]

    return map_batches(paths, run, "page_id long, url string, html string")


def read_one(folder: str, path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index; only its frame and the dictionary are read."""
    store, top = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{top}/{path}") as f:
        size = struct.unpack("<II", f.read(8))[1]
        reader, _ = unpack(struct.pack("<II", SKIPPABLE, size) + f.read(size))
        f.seek(offset)
        return parse(io.BytesIO(reader.decompress(f.read(length))))[0]


def archived(pages: DataFrame) -> DataFrame:
    """``page_id, url, digest, n_bytes`` of all pages as they come back from an archive in the shared folder."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    back = read(spark, write(pages, folder if "://" in folder else f"file://{folder}"), folder if "://" in folder else f"file://{folder}")
    return back.select("page_id", "url", F.md5("html").alias("digest"), F.octet_length("html").alias("n_bytes"))
