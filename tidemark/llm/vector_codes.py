"""Vector code compression: each of eight parts of a vector becomes the number of its nearest codebook entry, in exact integers.

Components become floor(SCALE * x). A part's nearest entry is found by segment means: for any cut into blocks, the squared
distance is at least the sum over blocks of size * (difference of block means)^2, plus (difference of residual norms)^2, where the residual is
what the means leave. From one block to finer ones, entries whose bound is above the distance to the entry with the lowest bound are
dropped, by floating point with a margin below; what survives gets its exact distance in 64-bit integers. So the pruning never changes a result.

Each round is one pass over the stored integer vectors: a task adds up its parts by entry, Spark adds up the tasks' sums by
key, and the driver gets parts * entries * (length + 1) numbers. Vectors never leave their partition; only errors are
shuffled, by label, and a hot label's rows stay where they are (join_groups).

Dropped: null vectors and those with a null or non-finite component. The codebook starts from the kept rows with the smallest ids (null
ids last, ties in order of the vector); with fewer than ENTRIES of them it has fewer entries. Rows that repeat an id, or a vector, each count. All
kept vectors must have one length, a multiple of PARTS, and components within limit(); otherwise the job fails with a message that says so, as
a wrong code would be worse. An empty table gives no rows. Extra columns are ignored. Null labels are one label.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_groups, stored, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows that a task looks at at once.
ROWS = 1 << 13


def limit(length: int) -> int:
    """Largest absolute value of an integer component: sums of squared differences fit in 64 bits."""
    return math.isqrt((1 << 63) // max(length, 1)) // 2 - 1


def integers(batch: pa.Array, length: int) -> np.ndarray:
    """The vectors of a list column as rows of floor(SCALE * x)."""
    sizes = np.diff(batch.offsets.to_numpy())
    if (sizes != length).any():
        raise ValueError(f"vectors differ in length: {length} and {sizes[sizes != length][0]}")
    scaled = np.floor(SCALE * batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (np.abs(scaled) > limit(length)).any():
        raise ValueError(f"a component is above {limit(length) // SCALE} in absolute value: distances would not fit in 64 bits")
    return scaled.astype(np.int64).reshape(len(sizes), length)


class Bounds:
    """The entries of one part's codebook, with their block means and residual norms at each level."""

    def __init__(self, entries: np.ndarray):
        self.entries, n = entries, entries.shape[1]
        counts = [1]
        while counts[-1] * 2 <= n // 2:
            counts.append(counts[-1] * 2)
        self.cuts = [np.array([k * n // c for k in range(c)]) for c in counts] if n else []
        self.levels = [self._of(entries, cut) for cut in self.cuts]

    @staticmethod
    def _of(rows: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block means times the root of the block's size, and residual norms."""
        sizes = np.diff(np.append(cut, rows.shape[1]))
        means = np.add.reduceat(rows, cut, axis=1) / np.sqrt(sizes)
        rest = rows - np.repeat(means / np.sqrt(sizes), sizes, axis=1)
        return means, np.sqrt((rest * rest).sum(axis=1))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row (of ties the first) and its squared distance."""
        n, k = len(rows), len(self.entries)
        row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
        exact = lambda r, e: ((rows[r] - self.entries[e]) ** 2).sum(axis=1)
        most = None
        for cut, (means, rests) in zip(self.cuts, self.levels, strict=True):
            own, rest = self._of(rows, cut)
            low = ((own[row] - means[entry]) ** 2).sum(axis=1) + (rest[row] - rests[entry]) ** 2
            low -= 1e-6 * (low + (own[row] ** 2).sum(axis=1) + (means[entry] ** 2).sum(axis=1) + rest[row] ** 2 + rests[entry] ** 2) + 1
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            lowest = np.minimum.reduceat(low, first)
            at = np.flatnonzero(low == np.repeat(lowest, np.diff(np.append(first, len(row)))))
            at = at[np.append(True, row[at][1:] != row[at][:-1])]
            seen = exact(row[at], entry[at])
            most = seen if most is None else np.minimum(most, seen)
            keep = low <= most[row]
            row, entry = row[keep], entry[keep]
        far = exact(row, entry)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(far, first)
        at = np.flatnonzero(far == np.repeat(least, np.diff(np.append(first, len(row)))))
        at = at[np.append(True, row[at][1:] != row[at][:-1])]
        return entry[at], least


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, vector and label of the rows whose vector is all finite numbers."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vector"), F.col(label_col).alias("label"))


def first_vectors(rows: DataFrame, n: int) -> list:
    """The n rows with the smallest ids: the ids alone are ordered first, then only rows up to the last of them."""
    order = F.col("vec_id").asc_nulls_last()
    ids = [r[0] for r in rows.select("vec_id").orderBy(order).limit(n).collect()]
    if not ids:
        return []
    near = rows if ids[-1] is None else rows.where(F.col("vec_id") <= ids[-1])
    return near.select("vec_id", "vector").orderBy(order, "vector").limit(n).collect()


def _parts(data: pa.Array, length: int) -> np.ndarray:
    raw = data.cast(pa.binary())
    return np.frombuffer(b"".join(raw.to_pylist()), "<i4").reshape(len(raw), PARTS, length // PARTS).astype(np.int64)


def _sums(rows: DataFrame, books: list[np.ndarray], length: int) -> np.ndarray:
    """By part, entry and component: the sum over the parts nearest to the entry, and (in the last place) their number."""
    width, entries = length // PARTS, len(books[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, total = [Bounds(b) for b in books], np.zeros((PARTS, entries, width + 1), np.int64)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                parts = _parts(batch.column(0).slice(a, ROWS), length)
                for p in range(PARTS):
                    nearest, _ = bounds[p].nearest(parts[:, p])
                    np.add.at(total[p], nearest, np.concatenate((parts[:, p], np.ones((len(parts), 1), np.int64)), axis=1))
        used = np.flatnonzero(np.repeat(total[:, :, -1].ravel() > 0, width + 1))
        yield pa.RecordBatch.from_pydict({"key": used.astype(np.int64), "value": total.ravel()[used]})

    found = rows.select("data").mapInArrow(add, "key long, value long").groupBy("key").agg(F.sum("value").alias("value"))
    out = np.zeros(PARTS * entries * (width + 1), np.int64)
    for key, value in found.collect():  # one row at most for each part, entry and place
        out[key] = value
    return out.reshape(PARTS, entries, width + 1)


def compressed(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """rows (see kept_vectors) as vec_id, label, code and error, stored; and the codebooks, one array of entries for each part."""
    start = first_vectors(rows, entries)
    length = len(start[0]["vector"]) if start else 0
    if length % PARTS:
        raise ValueError(f"vectors of {length} components can't be cut into {PARTS} equal parts")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = integers(batch.column(1), length).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in data], pa.binary()), batch.column(2)], names=["vec_id", "data", "label"])

    kind = dict(rows.dtypes)["label"]
    own = stored(rows.select("vec_id", "vector", "label").mapInArrow(whole, f"vec_id long, data binary, label {kind}"), "vectors")
    first = integers(pa.array([r["vector"] for r in start], pa.list_(pa.float32())), length)
    books = list(first.reshape(len(start), PARTS, length // PARTS).transpose(1, 0, 2))
    for _ in range(rounds if start and length else 0):
        sums = _sums(own, books, length)
        counts = sums[:, :, -1:]
        books = [np.where(c > 0, s[:, :-1] // np.maximum(c, 1), b) for s, c, b in zip(sums, counts, books, strict=True)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [Bounds(b) for b in books]
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                some = batch.slice(a, ROWS)
                parts, codes, errors = _parts(some.column(1), length), [], np.zeros(len(some), np.int64)
                for p in range(PARTS):
                    nearest, far = bounds[p].nearest(parts[:, p])
                    codes.append(nearest.astype(np.uint8))
                    errors += far
                names = [c.tobytes().hex() for c in np.stack(codes, axis=1)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(names, pa.string()), pa.array(errors)], names=["vec_id", "label", "code", "error"])

    out = stored(own.mapInArrow(assign, f"vec_id long, label {kind}, code string, error long"), "codes")
    drop(own)
    return out, books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(kept_vectors(table(spark, sf_dir, "embeddings")))
    # A label's key is a string, so that nulls meet.
    rows = codes.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    groups = stored(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    found = join_groups(rows, groups, ["key"], "n", codes.count())
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Each round: the squared distance of every part to every entry, the nearest, and the entries' new components."""
    steps = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS (SELECT r, p, list_slice(v, CAST(p * len(v) / 8 AS BIGINT) + 1, CAST((p + 1) * len(v) / 8 AS BIGINT)) AS x FROM kept, range(8) AS t(p))",
        "book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 16)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"near{k} AS MATERIALIZED (SELECT r, p, arg_min(e, far * 16 + e) AS e, min(far) AS far FROM (SELECT r, parts.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM parts JOIN book{k} USING (p)) GROUP BY r, p)"
        )
        if k < ROUNDS:
            steps.append(
                f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM near{k} JOIN parts USING (r, p), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))"
            )
    last = ROUNDS
    return (
        "WITH " + ", ".join(steps) + f", codes AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM near{last} GROUP BY r), "
        f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS d FROM book{last}) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT d FROM digest) AS codebooks_sha256 FROM codes JOIN kept USING (r)"
    )


OP12_SQL = _sql()
