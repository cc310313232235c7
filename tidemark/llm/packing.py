"""Best-fit packing of token sequences by a configuration linear program.

Every document becomes its ids and an end id; only documents above the capacity are cut, into pieces of the
capacity and a shorter last one. The histogram of lengths (at most as many rows as the capacity) is all that the driver sees.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest sequences that hold
every length as often as it occurs. It is solved in fractions by multiplicative weights (see solve()): weights of lengths grow with what of them is not held yet; a knapsack
dynamic program prices configurations, and those of the greatest price are used for a fraction. Weights give a lower bound too, so that the gap is known. The solution is
rounded, and what is left goes through the program again. Each pass places at least one sequence; if PASSES are not enough, the rest
is packed by best-fit decreasing. The plan's size depends on the capacity, not on the number of documents. share_of_program() tells how many pieces the program places.

Pieces then find their places by rank among the pieces of their length: ranks come from counts per partition
and length, so that no length, however common, is dealt to one task.

Null texts count as empty, and an empty document is its end id alone. Rows that repeat an id are packed as rows of their own. Very long texts
are encoded in blocks and cut. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table, text_of
from .tokens import encoder, tokenizer_path

CAPACITY = 4096
END_ID = 1
#: Of the linear program: knapsacks that look for full sequences, for the whole histogram and for what rounding leaves of it, and configurations from each.
KNAPSACKS, CONFIGURATIONS = (24, 8), 4096
#: The share of a length's count that one step of a configuration covers; how fast weights fall; what a free token costs; how weights grow with length,
#: as long pieces have fewer partners.
STEP, SHARPNESS, WASTE, GROWTH = 0.25, 3.0, 3.0, 1.5
#: Counts below this are none. Times that what is left goes through the program again, at most; what is left then goes to best fit.
TINY, PASSES = 1e-9, 60


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int, waste: float = WASTE) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each capacity with any number of each length, where a token left free costs waste; the last length's index (-1: a free token)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    ls, vs = lengths[order], values[order]
    fits = np.searchsorted(ls, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1] - waste / capacity
        if n := fits[c]:
            total = best[c - ls[:n]] + vs[:n]
            k = int(total.argmax())
            if total[k] > best[c]:
                best[c], choice[c] = total[k], order[k]
    return best, choice


def _read(best: np.ndarray, lengths: np.ndarray, values: np.ndarray, most: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """The best configuration with a length in it, with at most so many of each; lengths are in order."""
    found, room = {first: 1}, capacity - int(lengths[first])
    while n := int(np.searchsorted(lengths, room, side="right")):
        total = best[room - lengths[:n]] + values[:n]
        total[most[:n] < 1] = -np.inf
        for k, t in found.items():
            if k < n and most[k] < t + 1:
                total[k] = -np.inf
        k = int(total.argmax())
        if total[k] == -np.inf:
            break
        found[k] = found.get(k, 0) + 1
        room -= int(lengths[k])
    return found


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, knapsacks: int) -> tuple[dict[tuple, float], float]:
    """A fractional solution of the program: uses of configurations (tuples of (index, times)) that hold exactly counts; and a lower bound of any solution's sum.

    A length's weight falls as it is covered. A knapsack over the weighted lengths prices all configurations, and for each length the best one with it is read, those of the
    greatest price first. One is used until it has covered STEP of the counts of one of its lengths, or until one is covered. The first knapsacks use full sequences only, so that what
    has no partners now may find them under later weights. Any weights over the best price they allow are a solution of the dual program, which bounds the sum from below.
    """
    n, size = counts.astype(float), lengths / capacity
    most, left = counts.astype(np.int64), counts.astype(float)
    used, bound, turn = defaultdict(float), 0.0, 0
    while len(open_ := np.flatnonzero(left > TINY)):
        if turn == 0 or turn == knapsacks:
            prices = size * np.exp(SHARPNESS * left / n)
            for y in (size, prices):
                bound = max(bound, float((n * y).sum() / knapsack(lengths, y, capacity, 0.0)[0][capacity]))
        own, lacking, limits = lengths[open_], left[open_], most[open_]
        steps = STEP * n[open_]
        values = np.exp(SHARPNESS * (lacking / n[open_] - 1)) * size[open_] ** GROWTH
        best = knapsack(own, values, capacity)[0]
        with_each = values + best[capacity - own]
        any_ = turn >= knapsacks
        moved = False
        for k in np.lexsort((-own, -np.round(with_each, 2)))[: None if any_ else CONFIGURATIONS]:
            if lacking[k] <= TINY:
                continue
            found = _read(best, own, values, np.where(lacking > TINY, limits, 0), int(k), capacity)
            at, times = np.array(list(found)), np.array(list(found.values()))
            if not any_ and int((own[at] * times).sum()) < capacity:
                continue
            step = float((lacking[at] / times).min())
            step = step if any_ else min(step, float((steps[at] / times).min()))
            used[tuple(sorted(zip(open_[at].tolist(), times.tolist(), strict=True)))] += step
            lacking[at] -= step * times
            moved = True
        left[open_] = lacking
        turn = turn + 1 if moved else max(turn + 1, knapsacks)
    return used, bound


def _rounded(used: dict[tuple, float], lengths: np.ndarray, left: np.ndarray, capacity: int, full: bool) -> Iterator[tuple[int, tuple]]:
    """Whole uses, the most used configurations first, then those with the largest length: all rounded down, then one more of each for its fraction, as far as left
    (changed) has the pieces. full: only of full sequences.
    """
    order = sorted(((f, x) for f, x in used.items() if not full or sum(int(lengths[k]) * t for k, t in f) == capacity), key=lambda p: (-round(p[1], 6), -p[0][-1][0], p[0]))
    for share in (lambda x: int(x + TINY), lambda x: int(x % 1 > TINY)):
        for found, x in order:
            uses = min([share(x), *(int(left[k]) // t for k, t in found)])
            if uses > 0:
                for k, t in found:
                    left[k] -= t * uses
                yield uses, found


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> Iterator[tuple[int, dict[int, int]]]:
    """Best-fit decreasing over a histogram (changed to zeros): configurations by index and how often each is used.

    The largest length is followed, again and again, by the largest that still fits.
    """
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    while left.any():
        found: dict[int, int] = {}
        room, at = capacity, 0
        while room > 0:
            at = max(at, int(np.searchsorted(-falling, -room)))
            open_ = np.flatnonzero(left[order[at:]] > 0)
            if not len(open_):
                break
            at += int(open_[0])
            k = int(order[at])
            times = min(room // int(lengths[k]), int(left[k]))
            found[k] = times
            room -= times * int(lengths[k])
            at += 1
        uses = min(int(left[k]) // t for k, t in found.items())
        for k, t in found.items():
            left[k] -= t * uses
        yield uses, found


def share_of_program(histogram: dict[int, int], capacity: int = CAPACITY) -> float:
    """The share of pieces that configurations of the linear program hold."""
    placed = sum(uses * sum(found.values()) for uses, found, own in steps_of_plan(histogram, capacity) if own)
    return placed / max(1, sum(histogram.values()))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Configurations (length: times) and how often each is used; together they hold exactly the histogram."""
    return [(uses, found) for uses, found, _ in steps_of_plan(histogram, capacity)]


def steps_of_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int], bool]]:
    """plan(), and whether each configuration is one of the linear program's (else the rest's, by best fit)."""
    out: list[tuple[int, dict[int, int], bool]] = []
    items = sorted((length, n) for length, n in histogram.items() if n > 0)
    if not items:
        return out
    lengths, left = np.array([x for x, _ in items]), np.array([n for _, n in items])
    full = True
    for turn in range(PASSES):
        open_ = np.flatnonzero(left > 0)
        if not len(open_):
            break
        rest = left[open_]
        used, _ = solve(lengths[open_], rest, capacity, KNAPSACKS[turn > 0])
        found = list(_rounded(used, lengths[open_], rest, capacity, full))
        out += [(uses, {int(lengths[open_[k]]): t for k, t in one}, True) for uses, one in found]
        left[open_] = rest
        full = full and bool(found)  # once none is full, any will do
    out += [(uses, {int(lengths[k]): t for k, t in found.items()}, False) for uses, found in best_fit(lengths, left, capacity)]
    return out


def slots(configurations: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """For each configuration and length: the rank of the first piece there, sequence and offset of that, times per sequence."""
    rows, sequence, ranks = [], 0, Counter()
    for uses, found in configurations:
        offset = 0
        for length, times in sorted(found.items(), reverse=True):
            rows.append((length, ranks[length], sequence, offset, times))
            ranks[length] += uses * times
            offset += length * times
        sequence += uses
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset", "times"], dtype="int64").sort_values(["length", "first"], ignore_index=True)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and nth: the partition, and which of its length in there. To be stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), encode.encode_all(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id)).tobytes()
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    length = len(piece) // 4
                    for column, value in zip(rows, (doc, k, at // 4, length, zlib.crc32(piece), part, seen[length]), strict=True):
                        column.append(value)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    rows = stored(pieces(docs, path or tokenizer_path(), capacity, **options), "pieces")
    counts = stored(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())  # at most capacity rows
    places = slots(plan(histogram, capacity))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = rows.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    shared = spark.sparkContext.broadcast({c: places[c].to_numpy() for c in places})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, length, rank = shared.value, length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted((s["length"] << 48) + s["first"], (length << 48) + rank, side="right") - 1
        nth = rank - s["first"][at]
        return pd.DataFrame({"sequence_id": s["sequence"][at] + nth // s["times"][at], "offset": s["offset"][at] + nth % s["times"][at] * length})

    out = ranked.withColumn("place", place("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
