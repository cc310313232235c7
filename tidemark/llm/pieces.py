"""SentencePiece encoding by backtracking, and decoding with the library.

The library joins, of all neighbours whose concatenation is a piece, those with the best score first (the leftmost of equals). What
it ends with is the one row of pieces of which any two neighbours, taken alone and joined in that way again, come out as they
are: a join across a bound of the row would also happen with the two alone. So a text is read from left to right with an
Aho-Corasick automaton over the pieces: the longest match that goes with the piece before is taken, else the next shorter one;
where none is left, that position is marked as failed in a bit field and the piece before is given up. Each position fails once, as the
row up to it is the same whenever it is reached. Verdicts on neighbours are kept in a bounded table.

A text falls into words, each with a row of its own, where two bytes stand side by side that do so in no piece. (No piece of such a model holds a
space mark behind another character, which is checked when it is loaded.) The new words of a batch go step by step side by side in numpy.
A worker keeps the rows of at most KEPT_WORDS words, which are emptied when full (a batch's own words are held while it lasts).

Null texts count as empty: the end id alone, decoded to the empty text. Characters without a piece become their bytes' pieces. A very
long text is read whole, a very long word one piece after another. Repeated and null ids are kept as they come. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_of
from .tokens import room
from .words import Numbers, mix, span_hashes, trim

MODEL = "piece_bpe_32k.model"
MARK = "▁"
KEPT_WORDS = 1 << 20
KEPT_PAIRS = 1 << 20
#: Bytes of text in a block, words that go side by side, and the length above which a word goes alone.
BLOCK, SIDE_BY_SIDE, LONG = 1 << 20, 1 << 16, 512

_START = re.compile(rb"(?<! ) ")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Automaton:
    """Aho-Corasick automaton over strings with numbers (not 0); it gives the longest match at each place."""

    def __init__(self, numbers: dict[str, int]):
        #: The node that a node's character leads to, by node << 32 | character; node 0 is the root.
        self.children: dict[int, int] = {}
        depth, number = [0], [0]
        for word, n in numbers.items():
            node = 0
            for c in word:
                key = node << 32 | ord(c)
                if (node_ := self.children.get(key)) is None:
                    node_ = self.children[key] = len(depth)
                    depth.append(depth[node] + 1)
                    number.append(0)
                node = node_
            number[node] = n
        # A node's fail is the longest other node that its string ends with; its match and next are nodes of matches that end with it.
        self.fail, self.match, self.next = [0] * len(depth), [0] * len(depth), [0] * len(depth)
        for key, node in sorted(self.children.items(), key=lambda kv: depth[kv[1]]):
            if depth[node] > 1:
                back, c = self.fail[key >> 32], key & 0xFFFFFFFF
                while (to := self.children.get(back << 32 | c)) is None and back:
                    back = self.fail[back]
                self.fail[node] = to or 0
            self.next[node] = self.match[self.fail[node]]
            self.match[node] = node if number[node] else self.next[node]
        self.depth, self.number = depth, number
        self.arrays = [np.array(x, np.int64) for x in (self.fail, self.match, self.next, depth, number)]
        keys = mix(np.fromiter(self.children, np.uint64, len(self.children)))
        self.found, self.to = Numbers(), np.array([*self.children.values(), -1], np.int64)
        self.found.add(keys)

    def longest(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For many words of characters: the number of the longest match at each place, 0 without one. Words go side by side."""
        fail, match, following, depth, number = self.arrays
        out = np.zeros(len(codes) + 1, np.int64)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        nodes = np.zeros(len(sizes), np.int64)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            m = int(np.searchsorted(-sizes, -k))
            at = starts[:m] + k
            chars, now = codes[at].astype(np.uint64), nodes[:m].copy()
            to = self.to[self.found.find(mix(now.astype(np.uint64) << np.uint64(32) | chars))]
            open_ = np.flatnonzero((to < 0) & (now > 0))
            while len(open_):
                now[open_] = fail[now[open_]]
                to[open_] = self.to[self.found.find(mix(now[open_].astype(np.uint64) << np.uint64(32) | chars[open_]))]
                open_ = open_[(to[open_] < 0) & (now[open_] > 0)]
            nodes[:m] = np.maximum(to, 0)
            hits, places = match[nodes[:m]], at
            while True:
                some = np.flatnonzero(hits)
                if not len(some):
                    break
                hits, places = hits[some], places[some]
                out[places + 1 - depth[hits]] = number[hits]  # ends ascend: the longest stays
                hits = following[hits]
        return out

    def longest_one(self, text: str) -> list[int]:
        out, node, get = [0] * len(text), 0, self.children.get
        for at, c in enumerate(map(ord, text)):
            while (to := get(node << 32 | c)) is None and node:
                node = self.fail[node]
            node = to or 0
            hit = self.match[node]
            while hit:
                out[at + 1 - self.depth[hit]] = self.number[hit]
                hit = self.next[hit]
        return out


class PieceEncoder:
    """encode_all(texts) gives the ids of the library for each, without an end id. The library's file gives pieces, scores and the normal form.

    A character without a piece has the number size + code point here, and 0 stands for the start of a word.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_file=path)
        self.library, self.end_id, self.size, unknown = own, own.eos_id(), own.vocab_size(), own.unk_id()
        self.pieces = [own.id_to_piece(i) for i in range(self.size)]
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i))}
        if 0 in self.id_of.values() or any(MARK in p.lstrip(MARK) or "\0" in p for p in self.id_of):
            raise ValueError("a piece has number 0, or holds a zero or a space mark behind another character: words can't be encoded one by one")
        self.score = {p: own.get_score(i) for p, i in self.id_of.items()}
        as_bytes = {p: i for i, p in enumerate(self.pieces) if own.is_byte(i)}
        self.byte_ids = [as_bytes.get(f"<0x{b:02X}>", unknown) for b in range(256)]
        #: Whether two bytes stand side by side in any piece.
        self.inside = np.zeros(1 << 16, bool)
        self.lengths = np.ones(self.size, np.int64)
        #: For each piece the longest piece that it starts with, or its first character.
        self.shorter = np.zeros(self.size, np.int64)
        self.automaton = Automaton(self.id_of)
        for p, i in self.id_of.items():
            self.lengths[i], raw = len(p), p.replace(MARK, " ").encode()
            self.inside[[a << 8 | b for a, b in itertools.pairwise(raw)]] = True
            if len(p) > 1:
                self.shorter[i] = next((k for n in range(len(p) - 1, 0, -1) if (k := self.id_of.get(p[:n]))), self.size + ord(p[0]))
        self.pairs, self.verdicts = Numbers(), np.zeros(1 << 16, bool)
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.ids, self.starts, self.counts, self.used = Numbers(), np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def string(self, piece: int) -> str:
        return self.pieces[piece] if piece < self.size else chr(piece - self.size)

    def joined(self, text: str, bound: int) -> bool:
        """Whether text, joined by scores, ends as its two parts [0, bound) and [bound, ...); with bound 0, as one piece."""
        parts, bounds, score = list(text), list(range(len(text))), self.score
        scores = [score.get(a + b) for a, b in zip(parts, parts[1:])]
        while known := [s for s in scores if s is not None]:
            at = scores.index(max(known))
            if bound and bounds[at + 1] == bound:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del bounds[at + 1], scores[at]
            if at:
                scores[at - 1] = score.get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = score.get(parts[at] + parts[at + 1])
        return len(parts) == (2 if bound else 1)

    def go(self, before: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Whether each piece can stand behind the one before (behind 0, whether it is what its own text becomes)."""
        keys = mix(before.astype(np.uint64) << np.uint64(32) | pieces.astype(np.uint64))
        found = self.pairs.find(keys)
        if (found < 0).any():
            if self.pairs.n > KEPT_PAIRS:
                self.pairs, found[:] = Numbers(), -1
            missing = np.flatnonzero(found < 0)
            new, first, place = np.unique(keys[missing], return_index=True, return_inverse=True)
            texts = [("" if a == 0 else self.string(a), self.string(b)) for a, b in zip(before[missing[first]].tolist(), pieces[missing[first]].tolist(), strict=True)]
            numbers = self.pairs.add(new)
            if self.pairs.n > len(self.verdicts):
                self.verdicts = np.concatenate((self.verdicts, np.zeros(self.pairs.n, bool)))
            self.verdicts[numbers] = [self.joined(a + b, len(a)) for a, b in texts]
            found[missing] = numbers[place]
        return self.verdicts[found]

    def split(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all words, and how many each has. They go one step at a time: a piece more, a shorter one tried, or one given up."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n, sizes = len(codes), np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        longest = self.automaton.longest(codes, starts, sizes)
        longest[:-1] = np.where(longest[:-1] == 0, self.size + codes, longest[:-1])
        shorter, lengths = (lambda p: np.where(p < self.size, self.shorter[np.minimum(p, self.size - 1)], 0)), (lambda p: np.where(p < self.size, self.lengths[np.minimum(p, self.size - 1)], 1))
        failed = np.zeros(n // 8 + 1, np.uint8)
        # The pieces taken stand where they start; where each one's predecessor starts, stands beside it.
        taken, came = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        at, last, ends = starts.copy(), np.full(len(words), -1), starts + sizes
        piece = longest[at]
        rest = np.flatnonzero(at < ends)
        while len(rest):
            here, one, before = at[rest], piece[rest], last[rest]
            to = here + lengths(one)
            fits = (one != 0) & (failed[to >> 3] >> (to & 7).astype(np.uint8) & 1 == 0)
            fits[fits] = self.go(np.where(before[fits] < 0, 0, taken[before[fits]]), one[fits])
            step, to, here_ = rest[fits], to[fits], here[fits]
            taken[here_], came[here_] = one[fits], before[fits]
            last[step], at[step], piece[step] = here_, to, longest[to]
            less = rest[~fits]
            next_ = np.where(one[~fits] == 0, 0, shorter(one[~fits]))
            piece[less] = next_
            dead = less[next_ == 0]
            if len(dead):
                np.bitwise_or.at(failed, at[dead] >> 3, np.uint8(1) << (at[dead] & 7).astype(np.uint8))
                back = last[dead]
                at[dead], last[dead] = back, came[back]
                piece[dead] = shorter(taken[back])
            rest = rest[at[rest] < ends[rest]]
        # Pieces of the rows that hold: walk over them, from start to start.
        held, at = np.zeros(n + 1, bool), starts[sizes > 0]
        ends = ends[sizes > 0]
        while len(at):
            held[at] = True
            at = at + lengths(taken[at])
            at, ends = at[at < ends], ends[at < ends]
        held = np.flatnonzero(held)
        return taken[held], np.diff(np.searchsorted(held, np.append(starts, n)))

    def split_long(self, text: str) -> list[int]:
        """The same for one long word, whose steps have no others to be taken with."""
        n, failed = len(text), bytearray(len(text) // 8 + 1)
        pieces: list[int] = []
        known: dict[tuple[int, int], bool] = {}
        size, shorter, lengths = self.size, self.shorter.tolist(), self.lengths.tolist()
        longest = self.automaton.longest_one(text)
        at, piece = 0, -1
        while at < n:
            if piece < 0:
                piece = longest[at] or size + ord(text[at])
            before = pieces[-1] if pieces else 0
            while piece:
                end = at + (lengths[piece] if piece < size else 1)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if (fits := known.get((before, piece))) is None:
                        if len(known) >= KEPT_PAIRS:
                            known.clear()
                        a = self.string(before) if before else ""
                        fits = known[before, piece] = self.joined(a + self.string(piece), len(a))
                    if fits:
                        break
                piece = shorter[piece] if piece < size else 0
            if piece:
                pieces.append(piece)
                at, piece = end, -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = pieces.pop()
                at, piece = at - (lengths[last] if last < size else 1), shorter[last] if last < size else 0
        return pieces

    def learned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        parts = [self.split(some) for some in itertools.batched((w for w in words if len(w) <= LONG), SIDE_BY_SIDE)]
        parts += [(np.array(row, np.int64), np.array([len(row)])) for row in map(self.split_long, (w for w in words if len(w) > LONG))]
        pieces, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        if (odd := np.flatnonzero(pieces >= self.size)).size:  # characters that become their bytes
            rows = [[self.byte_ids[b] for b in chr(p).encode()] for p in (pieces[odd] - self.size).tolist()]
            more = np.array([len(r) for r in rows])
            width = np.ones(len(pieces), np.int64)
            width[odd] = more
            counts = np.add.reduceat(width, np.cumsum(counts) - counts)
            first = np.cumsum(width) - width
            out = np.empty(int(width.sum()), np.int64)
            out[first] = pieces
            out[np.repeat(first[odd] - (np.cumsum(more) - more), more) + np.arange(more.sum())] = np.concatenate(rows)
            pieces = out
        order = np.argsort([len(w) > LONG for w in words], kind="stable")
        back = np.argsort(order, kind="stable")
        starts = np.cumsum(counts) - counts
        counts, starts = counts[back], starts[back]
        return pieces[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(pieces))], counts

    def _learn(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, found: np.ndarray) -> None:
        missing = np.flatnonzero(found < 0)
        new, first, place = np.unique(hashes[missing], return_index=True, return_inverse=True)
        flat, counts = self.learned([buffer[a:b].decode().replace(" ", MARK) for a, b in zip(starts[missing[first]].tolist(), ends[missing[first]].tolist(), strict=True)])
        numbers = self.numbers.add(new)
        found[missing] = numbers[place]
        self.ids = room(self.ids, self.used + len(flat))
        self.starts, self.counts = room(self.starts, self.numbers.n), room(self.counts, self.numbers.n)
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[numbers], self.counts[numbers] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(flat)

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        """texts in their normal form, with blanks for space marks."""
        if self.numbers.n > KEPT_WORDS or self.used > 8 * KEPT_WORDS:
            self._clear()
        buffer = b"".join(texts)
        data = np.frombuffer(buffer, np.uint8)
        bounds = np.cumsum([0, *map(len, texts)])
        opens = np.ones(len(data), bool)
        opens[1:] = ~self.inside[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]] & (data[1:] & 0xC0 != 0x80)
        opens[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes = span_hashes(data, starts, ends)
        found = self.numbers.find(hashes)
        if (found < 0).any():
            self._learn(buffer, starts, ends, hashes, found)
        counts = self.counts[found]
        upto = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.starts[found] - upto[:-1], counts) + np.arange(upto[-1])]
        return [ids[a:b] for a, b in itertools.pairwise(upto[np.searchsorted(starts, bounds)].tolist())]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        at, some, size = [], [], 0
        for k, text in enumerate([*self.library.normalize(texts), None]):
            for piece in [None] if text is None else _cut(text.replace(MARK, " ").encode()):
                if some and (piece is None or size + len(piece) > BLOCK):
                    for j, ids in zip(at, self._block(some), strict=True):
                        out[j].append(ids)
                    at, some, size = [], [], 0
                if piece:
                    at.append(k)
                    some.append(piece)
                    size += len(piece)
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


def _cut(text: bytes) -> Iterator[bytes]:
    """Parts of about BLOCK bytes, that start where a word does."""
    start = 0
    while len(text) - start > 2 * BLOCK and (at := _START.search(text, start + BLOCK)):
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


@cache
def encoder(path: str) -> PieceEncoder:
    """One for each Python worker."""
    return PieceEncoder(path)


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (the end id last) and decoded, the text that the library makes of them."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            rows = [np.append(ids, np.int32(own.end_id)) for ids in own.encode_all(batch.column(1).to_pylist())]
            texts = [own.library.decode(r.tolist()) for r in rows]
            bounds = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(bounds, np.concatenate(rows) if rows else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
            del rows, texts, ids
            trim()

    small_batches(docs.sparkSession, 200)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoded(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
