"""Token files: frequency-ranked ids in byte-aligned variable-length coding, with the control bytes apart.

A shard is a run of blocks; numbers are little-endian. A block has

    b"TKB1", then as 32-bit: documents d, ids n, ranks r, bytes of data b
    ids in order of how often the block has them, most frequent first (r of 32 bits)
    document ids (d of 64 bits, signed), ids of each document (d of 32 bits)
    control bytes, one for four ids: two bits each, the bytes of the rank less one
    the ranks' bytes (b), lowest first, without leading zero bytes but for one at least

so that the most frequent 256 ids take one byte and two bits. Decoding looks up the lengths of four ranks for each
control byte in a table, and gathers. Every block carries its own ranks: a shard is written in one pass.

Documents are dealt to tasks by ranges of their ids, of about as many rows each; a task encodes its range in order and writes it as one shard,
under a name of its own, and a manifest of what the successful tasks wrote says which files count: a lost executor leaves an unused file at worst.

Null texts count as empty: a document of its end id alone. Rows that repeat an id stand side by side, in order of
text. Null ids come first, as the least id. Very long texts are encoded in blocks. An empty table gives no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, shared_file, small_batches, stored, table, text_of
from .tokens import encoder, tokenizer_path

END_ID = 2
MAGIC = b"TKB1"
BLOCK_IDS = 1 << 21
SHARD_ROWS = 8192
NULL_ID = -(1 << 63)

#: For each control byte the bytes of its four ranks.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def encode_block(docs: list[int], lists: list[np.ndarray]) -> bytes:
    ids = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
    seen, times = np.unique(ids, return_counts=True)
    order = np.lexsort((seen, -times))
    rank_of = np.empty(len(seen), np.int64)
    rank_of[order] = np.arange(len(seen))
    ranks = rank_of[np.searchsorted(seen, ids)].astype("<u4")
    n_bytes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = n_bytes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < n_bytes[:, None]]
    head = MAGIC + struct.pack("<4I", len(docs), len(ids), len(seen), len(data))
    return b"".join((head, seen[order].astype("<u4").tobytes(), np.array(docs, "<i8").tobytes(), np.array([len(x) for x in lists], "<u4").tobytes(), control.tobytes(), data.tobytes()))


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts, ranks = ends - lengths, np.zeros(n, np.uint32)
    for k in range(int(lengths.max(initial=0))):
        at = np.flatnonzero(lengths > k) if k else slice(None)
        ranks[at] |= data[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def read_blocks(file) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, ids per document, and all ids (32-bit) of each block of an open shard."""
    while head := file.read(20):
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        d, n, r, b = struct.unpack("<4I", head[4:])
        take = lambda count, kind: np.frombuffer(file.read(count * np.dtype(kind).itemsize), kind)
        by_rank, docs, sizes, control, data = take(r, "<u4"), take(d, "<i8"), take(d, "<u4"), take(-(-n // 4), np.uint8), take(b, np.uint8)
        yield docs, sizes, by_rank[decode_ranks(control, data, n)]


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards; their manifest: shard (in order of document id), file (URI), docs, ids."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    shards, folder = max(1, -(-docs.count() // shard_rows)), scratch(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uri = encoder(path), f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
        out, ids, lists, size, total, n_docs = None, [], [], 0, 0, 0

        def block() -> tuple[int, int]:
            out.write(encode_block(ids, lists))
            return total + size, n_docs + len(ids)

        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    files, where = shared_file(uri)
                    files.create_dir(where.rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(where)
                for doc, own in zip(batch.column(0).to_pylist(), encode.encode_all(batch.column(1).to_pylist()), strict=True):
                    ids.append(doc)
                    lists.append(np.append(own.astype(np.uint32), np.uint32(end_id)))
                    size += len(lists[-1])
                    if size >= BLOCK_IDS:
                        total, n_docs = block()
                        ids, lists, size = [], [], 0
            if ids:
                total, n_docs = block()
        finally:
            if out is not None:
                out.close()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [uri], "docs": [n_docs], "ids": [total]})

    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    dealt = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(write, "shard int, file string, docs long, ids long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, where = shared_file(uri)
                with files.open_input_stream(where, buffer_size=1 << 20) as file:
                    for docs, sizes, ids in read_blocks(file):
                        ends = np.cumsum(sizes, dtype=np.int64)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - sizes, ends, strict=True)]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, mask=docs == NULL_ID), "start": start + ends - sizes, "n_tokens": sizes.astype(np.int64), "ids_crc32": np.array(crcs, np.int64)})
                        start += int(ends[-1])

    shards = manifest.count()
    # One row for each shard.
    placed = manifest.select("file", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("start"))
    return placed.repartition(max(1, shards)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents")))
