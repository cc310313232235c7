"""Language-model scoring by logistic context mixing.

A text becomes its lower-cased (A-Z) words with one blank between them and a line end behind. Each byte is coded by a Huffman code of
the training bytes, and each bit of that code is predicted from four contexts: the last byte and the last three bytes (both reach
over word bounds), the word so far, and the word so far with the whole word before. All of these follow from a word, the word before,
and what ends it, so that the distinct ones of these units, with their training counts, hold all that the corpus has to say.
Counts of both bits are exact for every context that occurs, and no two contexts share a count (but for equal 64-bit hashes): those of
the bytes are in tables that hold the contexts seen, those of words and pairs of words in partitioned tables (words by their first
three bytes, units by the word before). A unit goes to its part once, in a blob of its block's, with the documents that hold it, and what
is summed for these there is all that comes back. Of counts only those that words share are sent: a context that one word alone has follows from its count. All grow with the corpus. The predictions' logits are added with weights that a gate chooses by how much each
context has been seen, and an adaptive map from gate and logit to probability refines the sum; half of each is the result.

Weights and map are learned from all training documents: every training unit is predicted from counts that leave that one
occurrence out, and counts as often as it occurs. Each task learns by online gradient descent over its units; weights are averaged by what each
gate has seen, and the map's counts added up. They don't change while a text is scored, so that a unit is scored once for all texts.

The base score is that of an add-one unigram model over all training tokens. Counts of the KNOWN_WORDS most frequent words at most
are broadcast; all other words are looked up by a shuffle join with the table of counts, so that the base score is exact.

Null texts count as empty: one token, the end. Without training documents all counts are 0. Rows that repeat an id have scores of
their own. A null id counts as the text "null" in choosing training documents. Very long texts are read whole, in blocks cut at white space. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, freed_shuffles, shared_file, small_batches, stored, table, text_of
from .words import _VALUES, Numbers, Words, _powers, blocks, mix, trim

KNOWN_WORDS = 500_000
PREDICTORS = 4
MIX_BATCH, MIX_RATE = 2048, 0.02
CHUNK_UNITS, BLOCK_BYTES = 30_000, 1 << 22
#: Units of a chunk, and words of a part, whose bits are spread out at once, however many a chunk has.
PIECE_UNITS = 6000
#: Units are dealt to so many parts (of small tables), or to one for so many bytes of text: about those of the small tables' parts, so that tasks don't grow.
PARTS, PART_BYTES = 12, 8 << 20
MAP_STEPS = 33
HELD_OUT = (7, 2)
_TOP = 7.9  # the largest logit
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = 0x202020
NO_HASHES = np.zeros(0, np.uint64)


def stream(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different values in order, where any one of each stands, of each place which it has, and how often each is there."""
    order = np.argsort(x)
    x = x[order]
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    at, heads = np.empty(len(x), np.int64), np.flatnonzero(new)
    at[order] = np.cumsum(new) - 1
    return x[heads], order[heads], at, np.diff(heads, append=len(x))


class Units:
    """The different words of some texts, each with the word before and the byte behind it.

    A word's bits have no other context. texts: pieces of texts in order; last: whether the text ends there; prior: hash and last bytes
    of the word before the first piece (0: none). data holds the units end to end; the last unit is an empty text's line end.
    """

    def __init__(self, texts: list[bytes], last: list[bool], prior: tuple[int, int] = (0, _BLANKS)):
        w = Words(texts)
        n, sizes = len(w), np.diff(w.first)
        source = np.frombuffer(w.buffer + b"\n", np.uint8)
        end = w.ends - 1
        before = np.append(np.uint64(prior[0]), np.maximum(w.hashes, np.uint64(1)))
        tail = np.append(np.int32(prior[1]), np.where(w.starts < end, source[end - 1], 32).astype(np.int32) << 16 | source[end].astype(np.int32) << 8 | 32)
        full = sizes > 0
        new, inside = [], prior[0] != 0  # first words of texts; whether the text has had a word
        for k, has in enumerate(full):
            if has and not inside:
                new.append(w.first[k])
            inside = (inside or has) and not last[k]
        #: The word before the next piece.
        self.prior = (int(before[n]), int(tail[n])) if inside else (0, _BLANKS)
        before[new] = 0
        tail[new] = _BLANKS
        before, tail = before[:n], tail[:n]
        final = np.zeros(n, np.uint64)
        final[(w.first[1:] - 1)[full & np.array(last, bool)]] = 1
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        key = mix(w.hashes + mix(before + np.uint64(3)) + final * _GOLD)
        own, first, self.unit, self.times = distinct(key)
        #: Hashes of the unit, of the word before (0: none) and of the word with its end, and the three bytes before.
        self.key = np.append(own, np.uint64(1))
        self.before, self.tail = np.append(before[first], np.uint64(0)), np.append(tail[first], np.int32(_BLANKS))
        self.word = np.append(mix(w.hashes[first] + final[first] * _GOLD), np.uint64(1))
        self.length = np.append((w.ends - w.starts)[first], 0) + 1
        self.start = np.cumsum(self.length) - self.length
        at = np.repeat(np.append(w.starts[first], 0) - self.start, self.length) + np.arange(self.length.sum())
        self.data = source[at]
        self.data[self.start + self.length - 1] = np.where(np.append(final[first], 1) == 1, 10, 32)
        #: Pieces without words that end a text: their texts are empty, or end in white space behind a cut.
        self.empty = np.flatnonzero(~full & np.array(last, bool))
        self.times = np.append(self.times, len(self.empty))

    def rows(self, counted: bool) -> pa.RecordBatch:
        used = len(self.key) - (len(self.empty) == 0)
        offsets = np.append(self.start, len(self.data)).astype(np.int32)[: used + 1]
        spelled = pa.Array.from_buffers(pa.binary(), used, [None, pa.py_buffer(offsets), pa.py_buffer(self.data.tobytes())])
        columns = [*(x[:used].view(np.int64) for x in (self.key, self.before, self.word)), self.tail[:used], spelled, self.times[:used] * counted]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["key", "before", "word", "tail", "spelled", "c"])


def units(texts: list[bytes]) -> Iterator[tuple[list[int], Units]]:
    """Units of blocks of the texts, with the number of the text that each piece comes from."""
    parts = list(blocks(texts, BLOCK_BYTES))
    order = [k for at, _ in parts for k in at]
    ends = [k + 1 == len(order) or order[k + 1] != order[k] for k in range(len(order))]
    done, prior = 0, (0, _BLANKS)
    for at, some in parts:
        u = Units(some, ends[done : done + len(at)], prior)
        yield at, u
        done, prior = done + len(at), u.prior


def spelled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of binary values end to end, and their lengths."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8), np.array([len(v) for v in values], np.int64)


# --- codes and contexts


class Code:
    """Huffman code of bytes from their counts: for each byte the nodes passed and the bits taken, end to end."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, k, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            children.append((x, y))
            heapq.heappush(heap, (a + b, 256 + len(children), 255 + len(children)))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256 + len(children))]
        for node in range(len(children) - 1, -1, -1):
            for bit, child in enumerate(children[node]):
                paths[child] = [*paths[256 + node], (node, bit)]
        self.length = np.array([len(p) for p in paths[:256]], np.int32)
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        flat = [x for p in paths[:256] for x in p]
        self.node, self.bit = np.array([n for n, _ in flat], np.uint32) * np.uint32(0x9E3779B1), np.array([b for _, b in flat], np.uint8)

    def bits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each bit: the byte's place, the node, and the bit."""
        length = self.length[data]
        ends = np.cumsum(length, dtype=np.int32)
        at = np.repeat(np.arange(len(data), dtype=np.int32), length)
        entry = np.repeat(self.start[data] - (ends - length), length) + np.arange(len(at), dtype=np.int32)
        return at, self.node[entry], self.bit[entry]


def prefixes(data: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each byte a hash of what stands before it in its word, and of the word's group."""
    n, start = len(data), np.cumsum(length) - length
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
    so_far = (sums[:n] - np.repeat(sums[start], length)) * np.repeat(down[start], length)
    place = (np.arange(n) - np.repeat(start, length)).astype(np.uint64)
    return mix(so_far + place * _GOLD) + np.repeat(mix(group + np.uint64(3)), length)


def three(data: np.ndarray, length: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """For each byte the three bytes before it. tail: those before each word."""
    start = np.cumsum(length) - length
    place = np.arange(len(data)) - np.repeat(start, length)
    padded = np.concatenate([np.zeros(3, np.int64), data.astype(np.int64)])
    first, n = np.repeat(tail.astype(np.int64), length), len(data)
    one = np.where(place > 0, padded[2 : n + 2], first & 255)
    two = np.where(place > 1, padded[1 : n + 1], np.where(place == 1, first & 255, first >> 8 & 255))
    far = np.where(place > 2, padded[:n], np.where(place == 2, first & 255, np.where(place == 1, first >> 8 & 255, first >> 16)))
    return far << 16 | two << 8 | one


def spread(starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of runs that begin at starts, end to end."""
    return np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class BitCounts:
    """How often each bit of each byte was 0 and 1 in the byte's context, with that byte's bits before it.

    context: a 64-bit hash per byte. All bytes of a context must be given, each so many times. Bits are those of the different bytes of each context;
    those of the bytes given are looked up.
    """

    def __init__(self, context: np.ndarray, data: np.ndarray, times: np.ndarray, code: Code):
        #: Of each byte given, which of the different ones it is.
        _, first, self.entry, _ = distinct(mix(context + data.astype(np.uint64) * _GOLD))
        counts, byte = np.bincount(self.entry, times), data[first]
        at, node, bit = code.bits(byte)
        _, self.place = np.unique(mix(context[first][at] + (node.astype(np.uint64) + np.uint64(1)) * _GOLD), return_inverse=True)
        self.seen, self.ones = np.bincount(self.place, counts[at]), np.bincount(self.place, counts[at] * bit)
        self.length = code.length[byte].astype(np.int64)
        self.start = np.cumsum(self.length) - self.length

    def of(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.place[spread(self.start[entry], self.length[entry])]
        return self.seen[place] - self.ones[place], self.ones[place]


def bit_counts(context: np.ndarray, data: np.ndarray, times: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """BitCounts of all bytes given."""
    if not len(data):
        return np.zeros(0), np.zeros(0)
    counts = BitCounts(context, data, times, code)
    return counts.of(counts.entry)


class Short:
    """Counts of bits in contexts of up to three bytes, for the contexts and bytes that occur. keys: 256 * context + byte, distinct."""

    def __init__(self, keys: np.ndarray, times: np.ndarray, code: Code):
        order = np.argsort(keys)
        self.keys = keys[order].astype(np.int64)
        byte = (self.keys & 255).astype(np.uint8)
        zero, one = bit_counts(mix((self.keys >> 8).astype(np.uint64)), byte, times[order], code)
        self.zero, self.one = zero.astype(np.uint32), one.astype(np.uint32)
        self.length = code.length[byte].astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        #: Cells of each bit, and those without one occurrence of the byte.
        self.full, self.less = to_cells(zero, one), without_one(zero, one, code.bits(byte)[2])

    def bits_of(self, entry: np.ndarray) -> np.ndarray:
        return spread(self.start[entry], self.length[entry])

    def places(self, context: np.ndarray, data: np.ndarray) -> np.ndarray:
        return self.bits_of(np.searchsorted(self.keys, context << 8 | data))

    def counts(self, context: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.places(context, data)
        return self.zero[own].astype(np.float64), self.one[own].astype(np.float64)


# --- what is gathered from the corpus


def is_training(id_col: str = "doc_id") -> Column:
    n, held = HELD_OUT
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % n != held


def token_counts(training: DataFrame) -> DataFrame:
    """kind (0: word, by its hash; 1: byte of the stream), h, c of the texts, stored. training: a column text (binary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting, by_byte = [], 0, np.zeros(256, np.int64)

        def merged() -> pa.RecordBatch:
            values, place = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([c for _, c in found]), len(values)).astype(np.int64)
            return pa.RecordBatch.from_pydict({"kind": np.zeros(len(values), np.int32), "h": values.view(np.int64), "c": counts})

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for _, some in blocks(texts):
                found.append(np.unique(Words(some).hashes, return_counts=True))
                waiting += len(found[-1][0])
            for text in texts:
                by_byte += np.bincount(np.frombuffer(stream(text), np.uint8), minlength=256)
            if waiting > 3_000_000:
                yield merged()
                found, waiting = [], 0
        if waiting:
            yield merged()
        used = np.flatnonzero(by_byte)
        yield pa.RecordBatch.from_pydict({"kind": np.ones(len(used), np.int32), "h": used.astype(np.int64), "c": by_byte[used]})

    return stored(training.mapInArrow(count, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c")), "counts")


def to_cells(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """High 13 bits: the logit times 256, and 4096; low two bits: 0 nothing seen, 1 one bit alone, 2 both, 3 both and often."""
    logit = np.clip(np.log((one + 0.15) / (zero + 0.15)), -_TOP, _TOP)
    both = np.minimum(zero, one) > 0
    seen = (zero + one > 0).astype(np.uint16) + both + (both & (zero + one > 30))
    return (np.round(logit * 256) + 4096).astype(np.uint16) << np.uint16(2) | seen


def without_one(zero: np.ndarray, one: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Cells of the counts less the occurrence that is predicted."""
    return to_cells(np.maximum(zero - (bit == 0), 0), np.maximum(one - bit, 0))


def all_units(rows: DataFrame) -> DataFrame:
    """key, before, word, tail, spelled, c of the distinct units of all rows; c: their number in training rows. Stored. This and word_cells are the plain form of
    joined_units and word_counts, rows in place of blobs, for comparison in tests.

    rows: columns text (binary) and held_out.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for counted in (True, False):
                for _, u in units([t for t, h in zip(texts, held, strict=True) if h != counted]):
                    yield u.rows(counted)

    out = rows.select("text", "held_out").mapInArrow(found, "key long, before long, word long, tail int, spelled binary, c long")
    return stored(out.groupBy("key", "before", "word", "tail", "spelled").agg(F.sum("c").alias("c")), "units")


def short_keys(data: np.ndarray, length: np.ndarray, tail: np.ndarray, times: np.ndarray, own: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of Short of the bytes at places (in their words) that own chooses, and how often each is met."""
    place = np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length)
    some = own(place)
    keys, at = np.unique((three(data, length, tail)[some] << 8) | data[some], return_inverse=True)
    return keys, np.bincount(at, np.repeat(times, length)[some], len(keys)).astype(np.int64)


def short_rows(kind: int, keys: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": np.full(len(keys), kind, np.int32), "k": keys, "c": c})


def short_tables(all_: DataFrame, code: Code) -> tuple[Short, Short, Short]:
    """Of the last byte, the last three bytes, and words' first bytes (up to two before the one that is predicted)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, length = spelled(batch.column(0))
            if not len(data):
                continue
            times = batch.column(2).to_numpy()
            for kind, tail, own in ((0, batch.column(1).to_numpy(), lambda place: place >= 0), (1, np.full(len(length), _BLANKS), lambda place: place < 3)):
                yield short_rows(kind, *short_keys(data, length, tail, times, own))

    return to_shorts(all_.select("spelled", "tail", "c").mapInArrow(found, "kind int, k long, c long"), code)


def to_shorts(counted: DataFrame, code: Code) -> tuple[Short, Short, Short]:
    rows = counted.groupBy("kind", "k").agg(F.sum("c").alias("c")).toPandas()
    kind, keys, c = (rows[x].to_numpy() for x in ("kind", "k", "c"))
    last, at = np.unique(keys[kind == 0] & 0xFFFF, return_inverse=True)
    return (Short(last, np.bincount(at, c[kind == 0], len(last)), code), *(Short(keys[kind == k], c[kind == k], code) for k in (0, 1)))


def in_groups(batches: Iterator[pa.RecordBatch], group: int, width: int | None = None) -> Iterator[pa.Table]:
    """Sorted rows in tables of CHUNK_UNITS or more that hold whole groups: equal values, or equal first bytes, of a column."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def value(batch: pa.RecordBatch, k: int):
        return batch.column(group)[k].as_py()[:width] if width else batch.column(group)[k].as_py()

    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= CHUNK_UNITS:
            ended = value(waiting[-1], waiting[-1].num_rows - 1)
            a, b = 0, batch.num_rows
            while a < b:  # the first row of another group; rows of one group stand together
                m = (a + b) // 2
                a, b = (m + 1, b) if value(batch, m) == ended else (a, m)
            if a < batch.num_rows:
                yield pa.Table.from_batches([*waiting, batch.slice(0, a)])
                waiting, size, batch = [], 0, batch.slice(a)
        waiting.append(batch)
        size += batch.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting)


def word_cells(all_: DataFrame, code: Code, start: Short) -> DataFrame:
    """word, cells: for each bit of a word the cell of the word so far, then all of these without the one occurrence."""
    shared = all_.sparkSession.sparkContext.broadcast((code, start))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, start = shared.value
        for rows in in_groups(batches, 1, 3):
            data, length = spelled(rows.column(1))
            zero, one = bit_counts(prefixes(data, length, np.zeros(len(length), np.uint64)), data, np.repeat(rows.column(2).to_numpy(), length), code)
            at, _, bit = code.bits(data)
            place = np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length)
            # Contexts of less than three bytes are shared by groups.
            early = place < 3
            own = early[at]
            zero[own], one[own] = start.counts(three(data, length, np.full(len(length), _BLANKS))[early], data[early])
            bits = np.add.reduceat(code.length[data].astype(np.int64), np.cumsum(length) - length)
            ends = np.cumsum(bits)
            full, less = to_cells(zero, one), without_one(zero, one, bit)
            cells = [full[e - n : e].tobytes() + less[e - n : e].tobytes() for e, n in zip(ends.tolist(), bits.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"word": rows.column(0).combine_chunks(), "cells": pa.array(cells, pa.binary())})

    words = all_.groupBy("word", "spelled").agg(F.sum("c").alias("c"))
    return words.repartition(F.expr("substring(spelled, 1, 3)")).sortWithinPartitions("spelled").select("word", "spelled", "c").mapInArrow(found, "word long, cells binary")


# --- the mix


class Mixer:
    def __init__(self):
        self.weights = np.full((4**PREDICTORS, PREDICTORS + 1), 0.35)
        self.weights[:, -1] = 0
        centers = np.linspace(-_TOP, _TOP, MAP_STEPS)
        self.map = np.tile(1 / (1 + np.exp(-centers)), (4**PREDICTORS, 1))

    def logits(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        w = self.weights.astype(np.float32)
        total = w[:, PREDICTORS][gate] * np.float32(0.3)
        for k, x in enumerate(inputs):
            total += w[:, k][gate] * x
        return np.clip(total, np.float32(-_TOP), np.float32(_TOP), out=total)

    def probabilities(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Of a one."""
        logit = self.logits(inputs, gate)
        place = (logit + np.float32(_TOP)) * np.float32((MAP_STEPS - 1) / (2 * _TOP))
        left = np.minimum(place.astype(np.int32), MAP_STEPS - 2)
        flat, at = self.map.reshape(-1).astype(np.float32), gate * np.int32(MAP_STEPS) + left
        low = flat[at]
        refined = low + (flat[at + 1] - low) * (place - left)
        p = np.float32(0.5) / (np.float32(1) + np.exp(-logit)) + np.float32(0.5) * refined
        return np.clip(p, np.float32(1e-4), np.float32(1 - 1e-4), out=p)

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, times: np.ndarray, rate: float = MIX_RATE) -> np.ndarray:
        """Online, in small batches and the order of the bits, each so many times. How much each gate has seen."""
        size, columns = len(self.weights), self.weights.T.copy()
        for a in range(0, len(bit), MIX_BATCH):
            own, g = slice(a, a + MIX_BATCH), gate[a : a + MIX_BATCH]
            x = [*(i[own] for i in inputs), np.full(len(g), 0.3, np.float32)]
            total = sum(w.take(g) * v for w, v in zip(columns, x, strict=True))
            error = (bit[own] - 1 / (1 + np.exp(-np.clip(total, -_TOP, _TOP)))) * times[own]
            step = rate * np.sqrt(np.bincount(g, minlength=size)) / np.maximum(1e-9, np.bincount(g, times[own], size))
            for k, v in enumerate(x):
                columns[k] += step * np.bincount(g, error * v, size)
        self.weights = columns.T.copy()
        return np.bincount(gate, times, size)

    def places(self, inputs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the map: how often it was met, and how often the bit was a one."""
        near = np.round((self.logits(inputs, gate) + _TOP) * ((MAP_STEPS - 1) / (2 * _TOP))).astype(np.int64)
        place = gate * MAP_STEPS + near
        return tuple(np.bincount(place, v, self.map.size).reshape(self.map.shape) for v in (times, times * bit))


def to_inputs(cells: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Logits of each predictor, and the gate."""
    gate = np.zeros(len(cells[0]), np.int32)
    for cell in cells:
        gate = gate << np.int32(2) | (cell & np.uint16(3))
    return [(cell >> np.uint16(2)).astype(np.float32) * np.float32(1 / 256) - np.float32(16) for cell in cells], gate


# --- units dealt to parts by the word before


def packed(**arrays: np.ndarray | bytes | int) -> bytes:
    """The arrays (no negative numbers) in as few bytes as they need: of each all low bytes stand together, then all next ones, and are compressed alone."""
    codec, out = pa.Codec("zstd", 1), []
    for name, x in arrays.items():
        kind, raw = None, x
        if isinstance(x, np.ndarray):
            fit = np.ascontiguousarray(x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8))
            kind, raw = fit.dtype.str, fit.view(np.uint8).reshape(-1, fit.itemsize).T.tobytes()
        out.append((name, kind, len(raw), codec.compress(raw, asbytes=True)) if isinstance(raw, bytes) else (name, kind, -1, raw))
    return pickle.dumps(out, 5)


def unpacked(data: bytes) -> dict:
    codec, out = pa.Codec("zstd"), {}
    for name, kind, size, x in pickle.loads(data):
        raw = codec.decompress(x, size, asbytes=True) if size >= 0 else x
        if kind is not None:
            width = np.dtype(kind).itemsize
            raw = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)
        out[name] = raw
    return out


def steps(sorted_: np.ndarray) -> np.ndarray:
    """Numbers in order as differences."""
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


def binaries(data: bytes, length: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def ranked(words: pa.Array) -> tuple[np.ndarray, bytes, np.ndarray]:
    """For each word its rank among the distinct ones in order; those, end to end, and their lengths."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    distinct = coded.dictionary.take(order)
    return rank[coded.indices.to_numpy()], b"".join(distinct.to_pylist()), pc.binary_length(distinct).to_numpy().astype(np.int64)


def batch_of(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["part", "data"])


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Sorted rows (part, data) by part."""
    part, found = None, []
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if found and k != part:
                yield part, found
                found = []
            part = k
            found.append(data)
    if found:
        yield part, found


def first_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first three bytes of each word as a number; 0 behind its end."""
    return sum(np.where(length > k, data[np.minimum(start + k, len(data) - 1)], 0).astype(np.uint64) << np.uint64(8 * k) for k in range(3))


def ranks_in(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each value its place in the sorted distinct ones, from 1; 0 without one."""
    if not len(sorted_):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at + 1, 0)


def frequent_before(words: DataFrame, total: int, ends: int, parts: int) -> np.ndarray:
    """Hashes of words that stand before more units than half a part should have, in order (0: none, as in front of a text). There are fewer than 2 * parts.

    words: h, c of all training words; total: their tokens with ends.
    """
    least = total // (2 * parts)
    found = [r["h"] for r in words.where(F.col("c") > least).select("h").collect()] + [0] * (ends > least)
    return np.unique(np.array(found, np.int64).view(np.uint64))


def early_keys(rank: np.ndarray, data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each byte a number of the frequent word before, the bytes before it in its word, and itself. rank: of each word; data: at most its first three bytes."""
    start = np.cumsum(length) - length
    place = np.arange(len(data)) - np.repeat(start, length)
    padded = np.concatenate([np.zeros(2, np.int64), data.astype(np.int64)])
    before = np.where(place > 0, padded[1:-1], 0) | np.where(place > 1, padded[:-2] << 8, 0)
    return np.repeat(rank.astype(np.int64), length) << 26 | place << 24 | before << 8 | data


def to_parts(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (part, data), each part in one task."""
    return rows.repartitionById(parts, "part").sortWithinPartitions("part")


def dealt_units(rows: DataFrame, parts: int, hot: np.ndarray = NO_HASHES) -> DataFrame:
    """part, data: of each block of texts the distinct units of each part, with the documents that hold them. A word before is in one part;
    what stands behind a frequent one (hot, its hashes in order) is dealt by its first three bytes as well.

    rows: row, text (binary) and held_out. All of a block's columns go as one value, as rows of units would take ten times their room.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts, trained = batch.column(0).to_numpy(), batch.column(1).to_pylist(), ~np.array(batch.column(2).to_pylist(), bool)
            for at, u in units(texts):
                n, at = len(u.key), np.array(at)
                pairs, times = np.unique(np.append(u.unit, np.full(len(u.empty), n - 1)) * len(texts) + np.append(at[u.owner], at[u.empty]), return_counts=True)
                unit, doc = np.divmod(pairs, len(texts))
                n_docs, c = np.bincount(unit, minlength=n), np.bincount(unit, times * trained[doc], n).astype(np.int64)
                _, first, word, _ = distinct(u.word)
                by = np.where(ranks_in(hot, u.before) > 0, mix(u.before + mix(first_bytes(u.data, u.start, u.length) + np.uint64(5))), u.before)
                part = (by % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((word, u.before, part))
                order = order[n_docs[order] > 0]
                bounds, out = np.searchsorted(part[order], np.arange(parts + 1)), []
                begins = np.cumsum(n_docs) - n_docs
                for k in np.flatnonzero(np.diff(bounds)):
                    own = order[bounds[k] : bounds[k + 1]]
                    words, wi = np.unique(word[own], return_inverse=True)
                    words = first[words]
                    heads = np.flatnonzero(np.append(True, u.before[own[1:]] != u.before[own[:-1]]))
                    posts = spread(begins[own], n_docs[own])
                    docs, di = np.unique(doc[posts], return_inverse=True)
                    out.append((int(k), packed(
                        spelled=u.data[spread(u.start[words], u.length[words])].tobytes(), length=u.length[words], before=u.before[own[heads]], tail=u.tail[own[heads]], n=np.diff(heads, append=len(own)),
                        wi=wi, c=c[own], n_docs=n_docs[own], rows=steps(row[docs]), docs=di, times=times[posts],
                    )))
                yield batch_of(out)

    return rows.select("row", "text", "held_out").mapInArrow(found, "part int, data binary")


def joined_blocks(blobs: list[bytes]) -> dict:
    """Blocks of one part put together: its words in order, units by word before and word, and their documents."""
    got = [unpacked(b) for b in blobs]
    cat = lambda name, kind=np.int64: np.concatenate([g[name].astype(kind) for g in got])
    rank, spelled_, length = ranked(binaries(b"".join(g["spelled"] for g in got), cat("length")))
    words_before = np.cumsum([0, *(len(g["length"]) for g in got)])
    wi = rank[np.concatenate([g["wi"].astype(np.int64) + k for g, k in zip(got, words_before, strict=False)])]
    before, first, bi, _ = distinct(cat("before", np.uint64))
    unit, at = np.unique(np.repeat(bi, cat("n")) * len(length) + wi, return_inverse=True)
    n_docs, c = cat("n_docs"), np.bincount(at, cat("c")).astype(np.int64)
    # Of documents there may be many more than units: their numbers here, in few bytes, stand for their rows.
    row = np.concatenate([np.cumsum(g["rows"].astype(np.int64)) for g in got])
    docs = np.concatenate([g["docs"].astype(np.int32) + np.int32(k) for g, k in zip(got, np.cumsum([0, *(len(g["rows"]) for g in got)]), strict=False)])
    times, tail = cat("times", np.int32), cat("tail")[first]
    del got, bi, wi
    order = np.argsort(np.repeat(at.astype(np.int32), n_docs), kind="stable")
    docs, times = docs[order], times[order]
    group, word = np.divmod(unit, len(length))
    return {"spelled": spelled_, "length": length, "before": before, "tail": tail, "group": group, "wi": word, "c": c, "n_docs": np.bincount(at, n_docs).astype(np.int64), "row": row, "docs": docs, "times": times}


def joined_units(dealt: DataFrame, parts: int, hot: np.ndarray = NO_HASHES) -> DataFrame:
    """kind, part, data: of each part its units in chunks of whole words before (kind 0), its words for each group by first bytes (kind 1; part is the group),
    its counts of short contexts (kind 2), and of the first three bytes behind frequent words (kind 3). Stored."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in by_part(batches):
            u = joined_blocks(blobs)
            length, c = u["length"], np.bincount(u["wi"], u["c"], len(u["length"])).astype(np.int64)
            data, start = np.frombuffer(u["spelled"], np.uint8), np.cumsum(u["length"]) - u["length"]
            group, out = (mix(first_bytes(data, start, length)) % np.uint64(parts)).astype(np.int64), []
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                out.append((1, int(g), packed(part=part, wi=steps(own), length=length[own], spelled=data[spread(start[own], length[own])].tobytes(), c=c[own])))
            # Behind the third byte a word's contexts are its own.
            blank = np.full(len(length), _BLANKS)
            keys = [(0, *short_keys(data, length, blank, c, lambda place: place >= 3)), (1, *short_keys(data, length, blank, c, lambda place: place < 3))]
            rank, early = ranks_in(hot, u["before"]), []
            for a in range(0, len(u["wi"]), 8 * CHUNK_UNITS):
                own = slice(a, a + 8 * CHUNK_UNITS)
                wi, group = u["wi"][own], u["group"][own]
                some = np.minimum(length[wi], 3)
                begun = data[spread(start[wi], some)]
                keys.append((0, *short_keys(begun, some, u["tail"][group], u["c"][own], lambda place: place >= 0)))
                k = np.repeat(rank[group] > 0, some)
                if k.any():
                    found_, at = np.unique(early_keys(rank[group], begun, some)[k], return_inverse=True)
                    early.append((found_, np.bincount(at, np.repeat(u["c"][own], some)[k]).astype(np.int64)))
            out.extend((2, part, packed(kind=np.array([kind]), keys=steps(k), c=n)) for kind, k, n in keys)
            out.extend((3, part, packed(keys=steps(k), c=n)) for k, n in early)
            ends, posts = np.cumsum(u["n_docs"]), np.append(0, np.cumsum(u["n_docs"]))
            heads = np.flatnonzero(np.append(True, np.diff(u["group"]) > 0))
            a = 0
            while a < len(ends):
                k = np.searchsorted(heads, a + CHUNK_UNITS)
                b = int(heads[k]) if k < len(heads) else len(ends)
                own, docs = slice(a, b), slice(posts[a], posts[b])
                rows, di = np.unique(u["row"][u["docs"][docs]], return_inverse=True)
                groups, gi = np.unique(u["group"][own], return_inverse=True)
                out.append((0, part, packed(tail=u["tail"][groups], rank=rank[groups], n=np.bincount(gi), wi=u["wi"][own], c=u["c"][own], n_docs=u["n_docs"][own], rows=steps(rows), docs=di, times=u["times"][docs])))
                a = b
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *batch_of([x[1:] for x in out]).columns], names=["kind", "part", "data"])
            del u, out
            trim()

    return stored(to_parts(dealt, parts).mapInArrow(found, "kind int, part int, data binary"), "units")


def shared_bytes(data: np.ndarray, start: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each word (in order) how many first bytes it has at most in common with a neighbour; -1 without one.

    same: whether a word and the one before are to be compared. None of those is another's beginning.
    """
    common = np.full(len(start) + 1, -1)
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        common[open_] = k
        open_ = open_[data[start[open_] + k] == data[start[open_ - 1] + k]]
        k += 1
    return np.maximum(common[:-1], common[1:])


def own_cells(own: np.ndarray, other: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Cells of how often a bit was as it is here, and the other way."""
    return to_cells(np.where(bit == 1, other, own), np.where(bit == 1, own, other))


def lone_cells(c: np.ndarray, bits: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Cells of bits in contexts that one word alone has, c times. bits: how many each word has."""
    zero = np.zeros(len(c))
    cells = np.stack([to_cells(c, zero), to_cells(zero, c)], axis=1).reshape(-1)
    return cells[np.repeat(2 * np.arange(len(c)), bits) + bit]


def word_counts(joined: DataFrame, code: Code, parts: int) -> DataFrame:
    """part, data: of each part its words with counts of the bits of bytes behind the third that other words share. Stored in a folder for each part."""
    shared = joined.sparkSession.sparkContext.broadcast(code)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for _, blobs in by_part(batches):
            got = [unpacked(b) for b in blobs]
            sizes = [len(g["wi"]) for g in got]
            rank, spelled_, length = ranked(binaries(b"".join(g["spelled"] for g in got), np.concatenate([g["length"].astype(np.int64) for g in got])))
            c = np.bincount(rank, np.concatenate([g["c"] for g in got]), len(length)).astype(np.int64)
            data, start = np.frombuffer(spelled_, np.uint8), np.cumsum(length) - length
            depth = shared_bytes(data, start, np.arange(len(length)) > 0)
            place = np.arange(len(data)) - np.repeat(start, length)
            own = (place >= 3) & (place <= np.repeat(depth, length))
            zero, one = bit_counts(prefixes(data, length, np.zeros(len(length), np.uint64))[own], data[own], np.repeat(c, length)[own], code)
            bit, bits = code.bits(data[own])[2], np.bincount(np.repeat(np.arange(len(length)), length)[own], code.length[data[own]], len(length)).astype(np.int64)
            mine, other = np.where(bit == 1, one, zero).astype(np.int64), np.where(bit == 1, zero, one).astype(np.int64)
            at, out = np.cumsum(bits) - bits, []
            for g, w in zip(got, np.split(rank, np.cumsum(sizes)[:-1]), strict=True):
                some = spread(at[w], bits[w])
                out.append((int(g["part"]), packed(wi=g["wi"], length=g["length"], spelled=g["spelled"], c=c[w], depth=np.maximum(depth[w], 2), mine=mine[some], other=other[some])))
            yield batch_of(out)

    groups = to_parts(joined.where("kind = 1").select("part", "data"), parts)
    return stored(to_parts(groups.mapInArrow(found, "part int, data binary"), parts), "words", "part")


def early_counts(joined: DataFrame, parts: int) -> DataFrame:
    """part, k, c: of all parts together the counts of the first three bytes behind frequent words, to each part in whose units their contexts are. Stored in a folder for each part."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = unpacked(data)
                yield pa.RecordBatch.from_pydict({"part": np.full(len(g["keys"]), part, np.int32), "k": np.cumsum(g["keys"].astype(np.int64)), "c": g["c"].astype(np.int64)})

    rows = stored(joined.where("kind = 3").select("part", "data").mapInArrow(found, "part int, k long, c long"), "early")
    context = F.shiftright("k", 8).alias("context")
    sums = rows.groupBy("k").agg(F.sum("c").alias("c")).select("k", "c", context)
    out = stored(rows.select("part", context).distinct().join(sums, "context").select("part", "k", "c").repartitionById(parts, "part"), "early_sums", "part")
    drop(rows)
    return out


class PartWords:
    """A part's words in order: bytes, starts, lengths, and cells of the word so far for each bit (learning: without one occurrence)."""

    def __init__(self, blobs: list[bytes], code: Code, first: Short, far: Short, learning: bool):
        got = [unpacked(b) for b in blobs]
        cat = lambda name: np.concatenate([g.pop(name) for g in got])
        order = np.argsort(np.concatenate([np.cumsum(g.pop("wi").astype(np.int64)) for g in got]))
        length, c, depth = cat("length").astype(np.int64), cat("c").astype(np.int64)[order], cat("depth").astype(np.int64)
        begins = np.cumsum(length) - length
        data = np.frombuffer(b"".join(g.pop("spelled") for g in got), np.uint8)
        mine, other = cat("mine"), cat("other")
        # Bits whose counts were sent along, in the blobs' order.
        sent = np.empty(len(length), np.int64)
        for a in range(0, len(length), PIECE_UNITS):
            w = slice(a, a + PIECE_UNITS)
            n = length[w]
            some = data[begins[a] : begins[a] + n.sum()]
            place = np.arange(len(some)) - np.repeat(np.cumsum(n) - n, n)
            sent[w] = np.add.reduceat(np.where((place >= 3) & (place <= np.repeat(depth[w], n)), code.length[some], 0).astype(np.int64), np.cumsum(n) - n)
        sent_start, sent, depth = (np.cumsum(sent) - sent)[order], sent[order], depth[order]
        self.length, begins = length[order], begins[order]
        self.start = np.cumsum(self.length) - self.length
        self.data, self.bits = np.empty(len(data), np.uint8), np.empty(len(c), np.int64)
        for a in range(0, len(c), PIECE_UNITS):
            w = slice(a, a + PIECE_UNITS)
            n = self.length[w]
            some = data[spread(begins[w], n)]
            self.data[self.start[a] : self.start[a] + len(some)] = some
            self.bits[w] = np.add.reduceat(code.length[some].astype(np.int64), np.cumsum(n) - n)
        self.bit_start = np.cumsum(self.bits) - self.bits
        self.cells = np.empty(int(self.bits.sum()), np.uint16)
        #: Entries of the last three bytes, right behind a word's third byte.
        self.far = np.empty(len(data), np.int32)
        for a in range(0, len(c), PIECE_UNITS):
            w = slice(a, a + PIECE_UNITS)
            n = self.length[w]
            at = slice(self.start[a], self.start[a] + n.sum())
            some, before = self.data[at], three(self.data[at], n, np.full(len(n), _BLANKS))
            _, _, bit = code.bits(some)
            place, by_byte = np.arange(len(some)) - np.repeat(np.cumsum(n) - n, n), code.length[some]
            cells = lone_cells(np.maximum(c[w] - learning, 0), self.bits[w], bit)
            known = first.places(before[place < 3], some[place < 3])
            cells[np.repeat(place < 3, by_byte)] = (first.less if learning else first.full)[known]
            middle = np.repeat((place >= 3) & (place <= np.repeat(depth[w], n)), by_byte)
            own = spread(sent_start[w], sent[w])
            cells[middle] = own_cells(np.maximum(mine[own].astype(np.int64) - learning, 0), other[own].astype(np.int64), bit[middle])
            self.cells[self.bit_start[a] : self.bit_start[a] + len(cells)] = cells
            self.far[at] = np.searchsorted(far.keys, before << 8 | some)


class Chunk:
    """Units of whole words before, with the cells of the four contexts of each bit.

    What is kept has a few numbers for each byte; of its bits, some five times as many, part() makes those of some units.
    """

    def __init__(self, packed_: bytes, words: PartWords, code: Code, last: Short, far: Short, learning: bool, early: tuple[np.ndarray, np.ndarray] | None = None):
        """early: keys and counts of the first three bytes behind frequent words, in order."""
        self.words, self.code, self.tables, self.learning = words, code, (last, far), learning
        g = unpacked(packed_)
        self.got, self.c = g, g["c"].astype(np.int64)
        self.wi, n = g["wi"].astype(np.int64), g["n"].astype(np.int64)
        self.bits, self.length = words.bits[self.wi], words.length[self.wi]
        length = self.length
        at = spread(words.start[self.wi], length)
        data, start = words.data[at], np.cumsum(length) - length
        place = np.arange(len(data)) - np.repeat(start, length)
        tail, begun, n_early = np.repeat(g["tail"].astype(np.int64), n), np.flatnonzero(place < 3), np.minimum(length, 3)
        entry = words.far[at]
        entry[begun] = np.searchsorted(far.keys, three(data[begun], n_early, tail) << 8 | data[begun])
        before = np.append(data[:1], data[:-1]).astype(np.int64)
        before[start] = tail & 255
        #: Of each byte: its entries in the tables of one and three bytes, and in the counts (-1: none but the unit's own).
        self.data, self.start = data, start
        self.entries = (np.searchsorted(last.keys, before << 8 | data).astype(np.int32), entry)
        # The word so far with the word before: mostly no other unit has it.
        group = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        depth = shared_bytes(data, start, np.append(False, group[1:] == group[:-1]))
        rank = np.repeat(g["rank"].astype(np.int64), n)
        frequent = rank[np.repeat(np.arange(len(length)), n_early)] > 0
        own = place <= np.repeat(depth, length)
        # The first bytes behind a frequent word have others in other parts.
        own[begun[frequent]] = False
        keys, c = (x[:0] for x in early or (NO_HASHES.view(np.int64),) * 2)
        if frequent.any():
            some = np.isin(early[0] >> 26, g["rank"][g["rank"] > 0])
            keys, c = early[0][some], early[1][some]
        self.pair = np.full(len(data), -1, np.int32)
        if own.any() or len(keys):
            context = np.append(prefixes(data, length, group)[own], mix((keys >> 8).astype(np.uint64) + np.uint64(7)))
            self.counts = BitCounts(context, np.append(data[own], (keys & 255).astype(np.uint8)), np.append(np.repeat(self.c, length)[own], c), code)
            found = self.counts.entry[np.count_nonzero(own) :]
            self.pair[own] = self.counts.entry[: np.count_nonzero(own)]
            if len(keys):
                self.pair[begun[frequent]] = found[np.searchsorted(keys, early_keys(rank, data[begun], n_early)[frequent])]

    def part(self, units_: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Cells of the four contexts, and the bits, of some of the units, in the order given."""
        length, bits = self.length[units_], self.bits[units_]
        at = spread(self.start[units_], length)
        data = self.data[at]
        _, _, bit = self.code.bits(data)
        kind = "less" if self.learning else "full"
        cells = [getattr(t, kind)[t.bits_of(x[at])] for t, x in zip(self.tables, self.entries, strict=True)]
        cells.append(self.words.cells[spread(self.words.bit_start[self.wi[units_]], bits)])
        pair = lone_cells(np.maximum(self.c[units_] - self.learning, 0), bits, bit)
        entry = self.pair[at]
        own = entry >= 0
        if own.any():
            at = np.repeat(own, self.code.length[data])
            zero, one = self.counts.of(entry[own])
            pair[at] = without_one(zero, one, bit[at]) if self.learning else to_cells(zero, one)
        return [*cells, pair], bit

    def pieces(self, units_: np.ndarray) -> Iterator[np.ndarray]:
        """The units in pieces of PIECE_UNITS at most."""
        return (units_[a : a + PIECE_UNITS] for a in range(0, len(units_), PIECE_UNITS))

    @property
    def cells(self) -> list[np.ndarray]:
        return self.part(np.arange(len(self.c)))[0]


def part_folders(table_: DataFrame) -> dict[int, str]:
    return {int(f.rsplit("/", 2)[1].split("=")[1]): f.rsplit("/", 1)[0] for f in table_.inputFiles()}


def part_table(folder: str, columns: list[str]) -> pa.Table:
    fs, path = shared_file(folder)
    return pq.read_table(path, columns=columns, filesystem=fs, partitioning=None)


def part_early(folder: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Keys and counts of the first three bytes behind frequent words, in order."""
    if folder is None:
        return None
    keys, c = (x.to_numpy() for x in part_table(folder, ["k", "c"]).columns)
    order = np.argsort(keys)
    return keys[order], c[order]


def document_scores(rows: DataFrame, byte_counts: np.ndarray, size: int, counts: DataFrame, total: int) -> DataFrame:
    """row, score (log10 probability of the text), bytes of its stream. Stored. rows, which must be stored, are deleted when they are dealt.

    rows: row, text (binary) and held_out; size: bytes of all texts; counts: h, c of training words; total: their tokens with ends.
    """
    spark, code = rows.sparkSession, Code(byte_counts)
    parts = max(min(PARTS, 1 + (size >> 18)), -(-size // PART_BYTES))
    hot = frequent_before(counts, total, int(byte_counts[10]), parts)
    with freed_shuffles(spark):
        joined = joined_units(dealt_units(rows, parts, hot), parts, hot)
        drop(rows)  # the disk's fullest moment follows
        last, far, start = to_shorts(counted_keys(joined), code)
        words = word_counts(joined, code, parts)
        early = early_counts(joined, parts) if len(hot) else None
    folders, early_folders = part_folders(words), part_folders(early) if len(hot) else {}
    shared, units_ = spark.sparkContext.broadcast((code, last, far, start, folders, early_folders)), joined.where("kind = 0").select("part", "data")

    def chunks(batches: Iterator[pa.RecordBatch], learning: bool) -> Iterator[Chunk]:
        code, last, far, start, folders, early_folders = shared.value
        part = words = early = None
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != part:
                    words = early = None
                    part, words, early = k, PartWords(part_table(folders[k], ["data"]).column(0).to_pylist(), code, start, far, learning), part_early(early_folders.get(k))
                yield Chunk(data.as_py(), words, code, last, far, learning, early)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, random = Mixer(), np.random.default_rng(5)
        seen, met, ones = np.zeros(len(mixer.weights)), np.zeros_like(mixer.map), np.zeros_like(mixer.map)
        for u in chunks(batches, True):
            use = np.flatnonzero(u.c > 0)
            random.shuffle(use)
            for own in u.pieces(use):
                cells, bit = u.part(own)
                found = (*to_inputs(cells), bit, np.repeat(u.c[own], u.bits[own]).astype(np.float64))
                seen += mixer.learn(*found)
                more = mixer.places(*found)
                met += more[0]
                ones += more[1]
        if seen.any():
            yield pa.RecordBatch.from_pydict({"data": pa.array([zlib.compress(pickle.dumps((mixer.weights, seen, met, ones)), 1)], pa.binary())})
        trim()

    tasks = stored(units_.mapInArrow(learned, "data binary"), "learned")
    mixer = averaged(pickle.loads(zlib.decompress(r["data"])) for r in tasks.toLocalIterator())
    fitted = spark.sparkContext.broadcast(mixer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, waiting, size = fitted.value, [], 0

        def summed() -> pa.RecordBatch:
            row, at = np.unique(np.concatenate([w[0] for w in waiting]), return_inverse=True)
            return pa.RecordBatch.from_pydict({"row": row} | {k: np.bincount(at, np.concatenate([w[j] for w in waiting])).astype(t) for j, (k, t) in enumerate((("score", np.float64), ("bytes", np.int64)), 1)})

        for u in chunks(batches, False):
            g, value = u.got, np.empty(len(u.c))
            for own in u.pieces(np.arange(len(u.c))):
                cells, bit = u.part(own)
                p = mixer.probabilities(*to_inputs(cells))
                value[own] = np.add.reduceat(np.log10(np.where(bit == 1, p, np.float32(1) - p)), np.cumsum(u.bits[own]) - u.bits[own], dtype=np.float64)
            row = np.cumsum(g["rows"].astype(np.int64))
            waiting.append((row, *(np.bincount(g["docs"], np.repeat(v, g["n_docs"]) * g["times"], len(row)) for v in (value, u.length))))
            size += len(row)
            if size > 1_000_000:
                yield summed()
                waiting, size = [], 0
        if waiting:
            yield summed()
        trim()

    with freed_shuffles(spark):
        out = stored(units_.mapInArrow(score, "row long, score double, bytes long").groupBy("row").agg(F.sum("score").alias("score"), F.sum("bytes").alias("bytes")), "row_scores")
    drop(joined, words, tasks, *([early] if len(hot) else []))
    return out


def counted_keys(joined: DataFrame) -> DataFrame:
    """kind, k, c as short_tables counts them."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                g = unpacked(data)
                yield short_rows(int(g["kind"][0]), np.cumsum(g["keys"].astype(np.int64)), g["c"].astype(np.int64))

    return joined.where("kind = 2").select("data").mapInArrow(found, "kind int, k long, c long")


def averaged(parts: Iterator[tuple[np.ndarray, ...]]) -> Mixer:
    """Of what tasks have learned: weights by what each gate has seen; the map from the counts of all."""
    out = Mixer()
    weights, total, met, ones = np.zeros_like(out.weights), np.zeros(len(out.weights)), np.zeros_like(out.map), np.zeros_like(out.map)
    for own, seen, a, b in parts:
        weights += own * seen[:, None]
        total += seen
        met += a
        ones += b
    some = total > 0
    out.weights[some] = weights[some] / total[some, None]
    out.map = (out.map * 16 + ones) / (16 + met)
    return out


# --- scores of a table


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Column | None = None, known_words: int = KNOWN_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    learn = is_training(id_col) if training is None else training
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"), (~learn).alias("held_out"))
    # Stored, as a row's number must be the same in each reading.
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text"), "texts")
    with freed_shuffles(spark):
        counts = token_counts(rows.where("not held_out").select("text"))
    words = counts.where("kind = 0").select("h", "c")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    by_byte = np.zeros(256, np.int64)
    for h, c in counts.where("kind = 1").select("h", "c").collect():
        by_byte[h] = c
    ends = int(by_byte[10])  # one in each stream
    total, distinct = total + ends, distinct + (ends > 0)
    # The least count at which no more than known_words words have as much.
    room, least = known_words, 1
    for c, n in sorted(words.groupBy("c").agg(F.count("*")).collect(), reverse=True):
        if n > room:
            least = c + 1
            break
        room -= n
    top = words.where(F.col("c") >= least).toPandas()
    order = np.argsort(top["h"].to_numpy().view(np.uint64))
    base = {"h": top["h"].to_numpy().view(np.uint64)[order], "c": top["c"].to_numpy()[order], "ends": ends, "unit": total + distinct + 1}
    shared = spark.sparkContext.broadcast(base)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        numbers = Numbers()
        numbers.add(base["h"])
        value = np.log10((base["c"] + 1) / base["unit"])
        for batch in batches:
            texts = batch.column(3).to_pylist()
            n = len(texts)
            tokens, known, at_base = np.ones(n, np.int64), np.full(n, int(base["ends"] > 0)), np.full(n, math.log10((base["ends"] + 1) / base["unit"]))
            rare: list[list] = [[] for _ in texts]
            for at, some in blocks(texts):
                w = Words(some)
                found = numbers.find(w.hashes)
                for k, a, b in zip(at, w.first[:-1], w.first[1:], strict=True):
                    own = found[a:b]
                    hit = own >= 0
                    tokens[k] += b - a
                    known[k] += int(hit.sum())
                    at_base[k] += float(value[own[hit]].sum())
                    rare[k].extend(w.hashes[a:b][~hit].view(np.int64).tolist())
            columns = [*batch.columns[:3], *map(pa.array, (tokens, known, at_base)), pa.array(rare, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "tokens", "known", "at_base", "rare"])

    first = stored(rows.mapInArrow(score, "row long, doc_id long, held_out boolean, tokens long, known long, at_base double, rare array<long>"), "scores")
    shared.destroy()  # its rows are written
    unit = float(base["unit"])
    # Words that weren't broadcast: their counts are below least, so that none is frequent.
    rare = first.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times"))
    seen = rare.join(words.where(F.col("c") < least), "h", "left")
    sums = seen.groupBy("row").agg(F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(unit))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    own = document_scores(rows, by_byte, size, words, total)
    out = first.drop("rare").join(sums, "row", "left").join(own, "row")
    return out.select(
        "doc_id", "held_out", F.col("tokens").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("at_base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
