"""Media columns: content-addressed payloads in tar shards, with header-only range reads.

A payload is stored as a gray-scale PNG of 8-bit samples, 576 to a row, under its SHA-256 as member name. Rows carry
digest, shard, offset and length of the member; width, height and depth come from a range read of the first 33 bytes.

Each task writes shards of its own, under new names, with each content once; where several shards hold the same content,
the index says which copy counts (the first in order of shard name and offset). Shards of failed tasks are not in the index, so
that a lost executor leaves unused files at worst. Texts are never shuffled, only index rows are.

Null and empty texts are one row of samples of 255. Rows that repeat a text or an id share the content and have rows of their own. Very long
texts are one payload like others. An empty table gives no shards and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, scratch, shared_file, small_batches, stored, table, text_of

ROW = 576
PAD = b"\xff"
LEVEL = 6
SHARD_BYTES = 256 << 20
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
FEATURE_BLOCKS = 64


def payload(text: bytes) -> bytes:
    """The text, filled up with bytes 255 (which UTF-8 never has) to a positive multiple of a row."""
    return text + PAD * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes) -> bytes:
    rows = np.zeros((len(samples) // ROW, ROW + 1), np.uint8)  # a filter byte of 0 before each row
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> bytes:
    width, height, _ = read_header(data)
    at, parts = 8, []
    while at < len(data):
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + length])
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter that isn't written here")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Average hash: a bit for each of 64 equal stretches, set where its mean is above the whole's, then mean and deviation."""
    data = np.frombuffer(samples, np.uint8)
    bounds = np.arange(FEATURE_BLOCKS + 1) * len(data) // FEATURE_BLOCKS
    sums = np.add.reduceat(data, bounds[:-1], dtype=np.int64)
    total = int(sums.sum())
    bits = sums * len(data) > total * np.diff(bounds)
    mean, squares = total / len(data), int(np.square(data, dtype=np.int64).sum())
    return f"{int(np.packbits(bits).view('>u8')[0]):016x}:{mean:.4f}:{max(0.0, squares / len(data) - mean * mean) ** 0.5:.4f}"


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards; their index, stored: doc_id, n_bytes, digest, file (URI), offset, length."""
    folder = scratch(docs.sparkSession, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = None, {}
        try:
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    samples = payload(text)
                    digest = hashlib.sha256(samples).digest()
                    if digest not in seen:
                        if out is None:
                            uri, at = f"{folder}/{uuid.uuid4().hex}.tar", 0
                            files, where = shared_file(uri)
                            files.create_dir(where.rsplit("/", 1)[0], recursive=True)
                            out = files.open_output_stream(where)
                        data, info = encode_png(samples), tarfile.TarInfo(f"{digest.hex()}.png")
                        info.size = len(data)
                        out.write(info.tobuf(tarfile.USTAR_FORMAT))
                        out.write(data + bytes(-len(data) % 512))
                        seen[digest] = (uri, at + 512, len(data))
                        at += 512 + len(data) + -len(data) % 512
                    rows.append((doc, len(text), digest, *seen[digest]))
                    if out is not None and at >= shard_bytes:
                        out.write(bytes(1024))
                        out.close()
                        out, seen = None, {}
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)
        finally:
            if out is not None:
                out.write(bytes(1024))
                out.close()

    names, types = ["doc_id", "n_bytes", "digest", "file", "offset", "length"], [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(write, "doc_id long, n_bytes long, digest binary, file string, offset long, length long"), "media-index")


def contents(index: DataFrame) -> DataFrame:
    """One row for each content: digest, rows (how many have it), file, offset, length of the copy that counts."""
    where = F.min(F.struct("file", "offset", "length")).alias("at")
    return index.groupBy("digest").agg(F.count("*").alias("rows"), where).select("digest", "rows", "at.*")


def _range_reads(places: DataFrame, read, schema: str) -> DataFrame:
    """Apply read(file, offset, length) to each place, in order of file and offset."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            columns = batch.to_pydict()
            found = []
            for uri, offset, length in zip(columns["file"], columns["offset"], columns["length"], strict=True):
                if uri != name:
                    if file is not None:
                        file.close()
                    files, where = shared_file(uri)
                    name, file = uri, files.open_input_file(where)
                found.append(read(file, offset, length))
            more = dict(zip(names, zip(*found, strict=True), strict=True)) if found else {n: [] for n in names}
            yield pa.RecordBatch.from_pydict({"digest": columns["digest"], "rows": pa.array(columns["rows"], pa.int64())} | {n: pa.array(list(v), pa.string() if "string" in kind else pa.int64()) for (n, v), kind in zip(more.items(), schema.split(", "), strict=True)})
        if file is not None:
            file.close()

    n = max(1, places.sparkSession.sparkContext.defaultParallelism * 2)
    ordered = places.select("digest", "rows", "file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, f"digest binary, rows long, {schema}")


def metadata(places: DataFrame) -> DataFrame:
    """digest, rows, width, height, bit_depth, from range reads of nothing but headers."""
    return _range_reads(places, lambda file, offset, length: read_header(file.read_at(HEADER_BYTES, offset)), "width long, height long, bit_depth long")


def features(places: DataFrame) -> DataFrame:
    """digest, rows and what the stored bytes, read back, show."""

    def read(file, offset: int, length: int) -> tuple:
        width, height, _ = read_header(file.read_at(HEADER_BYTES, offset))
        data = file.read_at(length, offset)
        samples = decode_png(data)
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), length, hashlib.sha256(data).hexdigest(), feature(samples), width, height

    return _range_reads(places, read, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_media(table(spark, sf_dir, "documents"))
    found = stored(features(stored(contents(index), "contents")), "media-features")
    rows = index.select("doc_id", "n_bytes", "digest")
    out = join_groups(rows, found, ["digest"], "rows", rows.count())
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
