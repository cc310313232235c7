"""Ranked lexical search: every document against a set of items, by blocked products of sparse matrices in 64-bit integers.

The items are one matrix, items by terms, of how often an item has a term. The documents are another, terms by documents, cut
into blocks of documents, which hold for each of the items' terms the documents with it and how often they have it. A block's
impacts are weight * ((1e9 * tf) div (1000 * tf + 8 * m)); the product is formed row by row (Gustavson): an item's row is the sum of the block's
rows of its terms, each times its multiplicity. Of each row a block gives its k best, which a task merges with those of its
other blocks; tasks' lists are reduced by windows, first in salted groups, then by item.

Documents are read once: they become blocks, stored, with term counts of the whole corpus (a pass over the blocks' row bounds
alone adds up document frequencies). Weights need those, so that the product is a second pass, over blocks. What tasks get is the items' matrix. Items come
in groups of at most GROUP_TERMS terms, one after another, so that it is bounded however many items there are.

Words are told apart by 64-bit hashes of their bytes (see words.py). Null and empty texts have no terms: such documents and items are in
no result. Documents that repeat an id, and items that do, are ranked one by one; ranks of equal scores and ids are arbitrary among those. Null
ids come first among equal scores. Very long texts are read whole, in pieces cut at white space. An empty table on either side gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, small_batches, stored, table, text_of
from .words import Numbers, Words, blocks, trim

BEST = 10
#: Documents in a block, and terms (with repeats) of the items that are searched for at once.
BLOCK_DOCS = 1 << 13
BLOCK_ENTRIES = 1 << 21
GROUP_TERMS = 1 << 18
SALTS = 64
NULL_ID = -(1 << 63)

#: Bytes outside terms: ASCII but for digits and letters.
BETWEEN = np.array([b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])


class Matrix:
    """Items by terms: of each item the terms' numbers and how often it has them."""

    def __init__(self, texts: list[bytes]):
        self.numbers, hashes, self.rows = Numbers(), [], []
        for text in texts:
            words = Words([text], between=BETWEEN)
            counts = Counter(words.hashes.tolist())
            hashes.append(np.array(list(counts), np.uint64))
            self.rows.append(np.array(list(counts.values()), np.int64))
        every = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        order = self.numbers.add(every)
        self.n_terms = len(every)
        self.rows = [(order[np.searchsorted(every, h)], times) for h, times in zip(hashes, self.rows, strict=True)]


def item_groups(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[list, Matrix]]:
    """The items in groups of at most GROUP_TERMS words (a longer item alone): their ids, and their matrix."""
    rows, ids, texts, size = items.select(F.col(id_col).cast("long"), text_of(text_col).cast("binary")).toLocalIterator(), [], [], 0
    for item, text in rows:
        text = bytes(text)
        if texts and size + len(text) // 2 > GROUP_TERMS:
            yield ids, Matrix(texts)
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += len(text) // 2 + 1
    if texts:
        yield ids, Matrix(texts)


def document_blocks(docs: DataFrame, matrix: Matrix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of terms by documents, stored: n_docs and n_words of documents with a term at all; of those that share one with the items, docs (ids) and sizes
    (words of each), terms (rows that aren't empty), bounds (where each row starts), places (in docs) and times.
    """
    numbers = matrix.numbers
    schema = "n_docs long, n_words long, docs binary, sizes binary, terms binary, bounds binary, places binary, times binary"

    def one(ids: list, sizes: list, terms: list, places: list, times: list) -> pa.RecordBatch:
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        terms, places, times = (np.concatenate(x) for x in (terms, places, times))
        used, at = np.unique(places, return_inverse=True)
        order = np.lexsort((at, terms))
        rows, first = np.unique(terms[order], return_index=True)
        raw = [ids[used].astype("<i8"), sizes[used].astype("<i8"), rows.astype("<i4"), np.append(first, len(order)).astype("<i8"), at[order].astype("<i4"), times[order].astype("<i4")]
        return pa.RecordBatch.from_arrays([pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), *(pa.array([x.tobytes()], pa.binary()) for x in raw)], names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [[], [], [], [], []], 0, 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words, terms, places = np.zeros(len(texts), np.int64), [], []
            for at, some in blocks(texts):
                found = Words(some, between=BETWEEN)
                counts = np.diff(found.first)
                np.add.at(words, at, counts)
                term = numbers.find(found.hashes)
                known = term >= 0
                terms.append(term[known].astype(np.int64))
                places.append(np.repeat(np.array(at, np.int64), counts)[known])
            key, times = np.unique(np.concatenate([*terms, np.zeros(0, np.int64)]) * len(texts) + np.concatenate([*places, np.zeros(0, np.int64)]), return_counts=True)
            for into, x in zip(held, (batch.column(0).to_numpy(zero_copy_only=False), words, key // max(len(texts), 1), n + key % max(len(texts), 1), times), strict=True):
                into.append(x)
            n, size = n + len(texts), size + len(key)
            del texts, terms, places, key, times
            if n >= BLOCK_DOCS or size >= BLOCK_ENTRIES:
                yield one(*held)
                held, n, size = [[], [], [], [], []], 0, 0
                trim()
        if n:
            yield one(*held)
            trim()

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, schema), "blocks")


def document_counts(found: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term, from the blocks' row bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, bounds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[np.frombuffer(terms, "<i4")] += np.diff(np.frombuffer(bounds, "<i8"))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": used.astype(np.int64), "n": total[used]})

    out = np.zeros(n_terms, np.int64)
    for term, n in found.select("terms", "bounds").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # a row for each of a group's terms
        out[term] = n
    return out


def weights(counts: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in counts.tolist()], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest positive scores, of equal ones those with the smallest ids first."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= least]
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def ranked(found: DataFrame, ids: list, matrix: Matrix, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score: each item's k best documents. found: see document_blocks."""
    row = found.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, n_words = row[0] or 0, row[1] or 0
    weight, rows = weights(document_counts(found, matrix.n_terms), n_docs), matrix.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(rows)
        for batch in batches:
            for raw in zip(*(batch.column(j).to_pylist() for j in range(6)), strict=True):
                docs, sizes, terms, bounds, places, times = (np.frombuffer(x, kind) for x, kind in zip(raw, ("<i8", "<i8", "<i4", "<i8", "<i4", "<i4"), strict=True))
                if 75 * int(sizes.max(initial=0)) * n_docs < 1 << 63:
                    m = 25 + 75 * sizes * n_docs // n_words
                else:
                    m = np.array([25 + 75 * s * n_docs // n_words for s in sizes.tolist()], np.int64)
                tf = times.astype(np.int64)
                impact = np.repeat(weight[terms], np.diff(bounds)) * (1_000_000_000 * tf // (1000 * tf + 8 * m[places]))
                row_of = np.full(matrix.n_terms, -1, np.int64)
                row_of[terms] = np.arange(len(terms))
                for i, (own, often) in enumerate(rows):
                    total = np.zeros(len(docs), np.int64)
                    for r, c in zip(row_of[own].tolist(), often.tolist(), strict=True):
                        if r >= 0:
                            a, b = bounds[r], bounds[r + 1]
                            total[places[a:b]] += c * impact[a:b]  # a row has each document once
                    at = best(total, docs, k)
                    scores, names = np.concatenate((tops[i][0], total[at])), np.concatenate((tops[i][1], docs[at]))
                    at = best(scores, names, k)
                    tops[i] = scores[at], names[at]
        counts = [len(s) for s, _ in tops]
        place, names = np.repeat(np.arange(len(rows)), counts), np.concatenate([n for _, n in tops])
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(names, mask=names == NULL_ID), pa.array(np.concatenate([s for s, _ in tops]))], names=["place", "doc_id", "score"])

    some = found.select("docs", "sizes", "terms", "bounds", "places", "times").mapInArrow(run, "place int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    salted = some.withColumn("salt", F.spark_partition_id() % SALTS).withColumn("rank", F.row_number().over(Window.partitionBy("place", "salt").orderBy(*order))).where(F.col("rank") <= k)
    out = salted.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("rank") <= k)
    names = F.array(*[F.lit(i).cast("long") for i in ids])
    return out.select(F.element_at(names, F.col("place") + 1).alias("item_id"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """Each item's k best documents, stored."""
    out = None
    for ids, matrix in item_groups(items):
        found = document_blocks(docs, matrix)
        one = stored(ranked(found, ids, matrix, k), "ranked")
        drop(found)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH words AS (SELECT doc_id, r, unnest({_TERMS}) AS term FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)),
sizes AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY r),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
own AS (SELECT item_id, i, unnest({_TERMS}) AS term FROM (SELECT item_id, text, row_number() OVER () AS i FROM benchmark)),
wanted AS (SELECT i, any_value(item_id) AS item_id, term, count(*) AS times FROM own GROUP BY i, term),
entries AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM totals) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM entries GROUP BY term),
impacts AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) AS impact FROM entries JOIN sizes USING (r) JOIN weights USING (term), totals),
scores AS (SELECT i, any_value(item_id) AS item_id, r, CAST(sum(times * impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY i, r),
ranks AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores JOIN sizes USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranks WHERE rank <= 10
"""
