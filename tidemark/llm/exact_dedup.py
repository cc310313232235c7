"""Exact deduplication by two-pass Bloom filtering.

Pass one adds the SHA-256 of every text to a counting Bloom filter whose counters stop at two (two bit maps: seen,
and seen again). A text whose counters all reached two may be repeated; any other text is unique. Pass two
tests every row against the second bit map: rows of unique texts pass straight through, and only the others are
shuffled by their digest to find the groups.

A filter has 16 bits for each row up to max_bits (16 MB at the default), so what is broadcast has a fixed bound. With more rows
than that, digests are dealt to slices by eight of their bits (without a shuffle), and each slice has a filter of its own, of
which one at a time is in memory. With more than SLICES * max_bits / 16 rows (2.1 billion) filters fill up: more rows of unique
texts are shuffled in vain, but results stay the same. deduplicate() tests its rows with a filter of the repeated digests alone.

Null texts count as empty. Texts are equal when identical. Of equal texts the row with the largest id stays; of rows that
repeat both id and text, one. Very long texts are hashed whole. An empty table gives no rows. Extra columns, of any type and name, are ignored by
digests(), and carried along by deduplicate().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_groups, scratch, stored, table, text_of

BITS_PER_ROW = 16
MAX_BITS = 1 << 27
CHUNK = 1 << 16
#: Most slices that digests are dealt to: one for each value of a byte.
SLICES = 256


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (SHA-256 of the text) and a row number, stored: texts are read once."""
    return stored(docs.select(F.col(id_col), F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


def _positions(shas: pd.Series, bits: int) -> np.ndarray:
    """Four positions for each digest: its four 64-bit words."""
    return (np.frombuffer(b"".join(shas), "<u8").reshape(-1, 4) & np.uint64(bits - 1)).astype(np.int64)


def _merge(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    once, twice = pairs[0]
    for a, b in pairs[1:]:
        once, twice = once | a, twice | b | (once & a)
    return once, twice


def counting_filter(rows: DataFrame, bits: int, times: int) -> bytes:
    """The bit map of counters that reached times (1 or 2), as bytes. rows have a column digest."""
    schema = "chunk int, salt int, once binary, twice binary"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            if len(batch):
                at, n = np.unique(np.sort(_positions(batch["digest"], bits), axis=1).ravel(), return_counts=True)
                twice[at[once[at] | (n > 1)]] = True
                once[at] = True
        once, twice, salt = np.packbits(once).reshape(-1, CHUNK // 8), np.packbits(twice).reshape(-1, CHUNK // 8), TaskContext.get().partitionId() % 64
        for k in np.flatnonzero(once.any(axis=1)):
            yield pd.DataFrame({"chunk": [k], "salt": [salt], "once": [zlib.compress(once[k].tobytes(), 1)], "twice": [zlib.compress(twice[k].tobytes(), 1)]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        unpack = lambda x: np.frombuffer(zlib.decompress(x), np.uint8)
        once, twice = _merge([(unpack(a), unpack(b)) for a, b in zip(group["once"], group["twice"], strict=True)])
        return pd.DataFrame({"chunk": group["chunk"][:1], "salt": [0], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})

    chunks = rows.select("digest").mapInPandas(count, schema).groupBy("chunk", "salt").applyInPandas(merge, schema).groupBy("chunk").applyInPandas(merge, schema)
    out = np.zeros((bits // CHUNK, CHUNK // 8), np.uint8)
    for chunk, reached in chunks.select("chunk", "once" if times == 1 else "twice").toLocalIterator():
        out[chunk] = np.frombuffer(zlib.decompress(reached), np.uint8)
    return out.tobytes()


def filter_bits(n: int, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, max(CHUNK, 1 << max(0, n * BITS_PER_ROW - 1).bit_length()))


def tester(spark: SparkSession, bitmap: bytes):
    """A column function that tests digests against a filter, and the broadcast that it reads."""
    shared = spark.sparkContext.broadcast(bitmap)
    bits = len(bitmap) * 8

    @F.pandas_udf("boolean")
    def test(shas: pd.Series) -> pd.Series:
        if not len(shas):
            return pd.Series([], dtype=bool)
        bitmap, at = np.frombuffer(shared.value, np.uint8), _positions(shas, bits)
        return pd.Series((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1))

    return test, shared


def _tested(spark: SparkSession, rows: DataFrame, total: int, max_bits: int) -> DataFrame:
    """rows with again: whether the digest may be repeated (stored, while rows are deleted)."""
    slices = min(SLICES, 1 << (max(1, -(-total * BITS_PER_ROW // max_bits)) - 1).bit_length())
    parts = [rows]
    if slices > 1:
        # The last byte of the first word takes no part in positions: these are of its low bits.
        part = F.conv(F.hex(F.substring("digest", 8, 1)), 16, 10).cast("int").bitwiseAND(slices - 1)
        dealt = stored(rows.withColumn("slice", part), "slices", by="slice")
        parts = [dealt.where(F.col("slice") == k).drop("slice") for k in range(slices)]
    path = scratch(spark, "tested")
    for part in parts:
        test, shared = tester(spark, counting_filter(part, filter_bits(-(-total // slices), max_bits), 2))
        out = part.withColumn("again", test("digest"))
        out.write.mode("append").parquet(path)
        shared.destroy()
    drop(rows, *([dealt] if slices > 1 else []))
    return spark.read.schema(out.schema).parquet(path)


def _groups(spark: SparkSession, rows: DataFrame, id_col: str, max_bits: int):
    """The tested rows, the groups of the repeated ones (both stored) and the number of all rows."""
    total = rows.count()
    tested = _tested(spark, rows, total, max_bits)
    groups = tested.where("again").groupBy("digest").agg(F.max(F.struct(id_col, "row")).alias("last"), F.count("*").alias("group_size"))
    return tested, stored(groups.where("group_size > 1"), "groups"), total


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    spark, rows = docs.sparkSession, digests(docs, id_col, text_col)
    tested, groups, total = _groups(spark, rows, id_col, max_bits)
    again = join_groups(tested.where("again"), groups, ["digest"], "group_size", total).select(id_col, F.col(f"last.{id_col}").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"), "digest")
    # Rows that the filter let through for no reason have no group.
    alone = tested.where("not again").unionByName(tested.where("again").join(groups.select("digest"), "digest", "left_anti"))
    alone = alone.select(id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return again.unionByName(alone).select(id_col, "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """docs without the rows that exact_groups() doesn't keep. Texts that can't be repeated are not shuffled."""
    spark, columns, rows = docs.sparkSession, docs.columns, digests(docs, id_col, text_col)
    tested, groups, _ = _groups(spark, rows, id_col, max_bits)
    drop(tested)
    test, _ = tester(spark, counting_filter(groups, filter_bits(groups.count(), max_bits), 1))
    all_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.unhex(F.sha2(text_of(text_col), 256)).alias("digest")).withColumn("id", F.col(f"doc.{id_col}"))
    again = all_rows.where(test("digest"))
    # One row of each repeated text: its largest id; among rows that repeat that too, the first in order of all columns as text (maps have no order).
    keep = groups.select("digest", F.col(f"last.{id_col}").alias("id"))
    one = again.join(keep, (again["digest"] == keep["digest"]) & again["id"].eqNullSafe(keep["id"]), "left_semi").groupBy("digest", "id").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    single = again.join(groups.select("digest"), "digest", "left_anti")
    return all_rows.where(~test("digest")).select("doc.*").unionByName(single.select("doc.*")).unionByName(one.select("doc.*"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
