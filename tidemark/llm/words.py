"""Words of many texts at once in numpy: bounds, 64-bit hashes, and a table from hashes to numbers.

A word's hash is that of its bytes (a polynomial modulo 2**64 over a table of mixed values, with the length
mixed in). Among ten million different words the chance of any collision is below one in a hundred thousand.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SPACES = b"\t\n\v\f\r "
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors)
    return _POWERS["up"], _POWERS["down"]


def trim() -> None:
    """Give freed memory back to the system: idle Python workers share an executor's memory with those at work."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of the bytes."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


class Words:
    """Of consecutive texts: the bytes, where each word starts and ends, its hash, and the first word of each text."""

    def __init__(self, texts: list[bytes], marks: bool = False, between: np.ndarray = SPACE):
        """between: for each byte whether it is outside words; a line feed must be."""
        self.buffer = b"\n".join(texts).lower()
        data = np.frombuffer(self.buffer, np.uint8)
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = between[data]
        word = ~space[1:-1]
        if marks:  # a full stop or comma between a letter or digit and a blank is a word of its own
            stop = np.zeros(len(data) + 2, bool)
            at = np.flatnonzero((data == 46) | (data == 44))
            left = data[np.maximum(at - 1, 0)]
            stop[1 + at[space[at + 2] & (at > 0) & ((left >= 97) & (left <= 122) | (left >= 48) & (left <= 57))]] = True
            self.starts = np.flatnonzero(word & (space[:-2] | stop[1:-1]))
            self.ends = np.flatnonzero(word & (space[2:] | stop[2:])) + 1
        else:
            self.starts = np.flatnonzero(word & space[:-2])
            self.ends = np.flatnonzero(word & space[2:]) + 1
        self.hashes = span_hashes(data, self.starts, self.ends)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, k: int) -> bytes:
        return self.buffer[self.starts[k] : self.ends[k]]


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts in blocks of about size bytes, each with its place in the list; longer ones are cut at white space."""
    at, out, total = [], [], 0
    for k, text in enumerate(texts):
        for piece in cut(text, size) if len(text) > 2 * size else (text,):
            if out and total + len(piece) > size:
                yield at, out
                at, out, total = [], [], 0
            at.append(k)
            out.append(piece)
            total += len(piece)
    if out:
        yield at, out


def cut(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    start = 0
    while len(text) - start > 2 * size:
        end = max(text.rfind(s, start, start + size) for s in (SPACES[k : k + 1] for k in range(6)))
        if end <= start:
            end = min((e for e in (text.find(SPACES[k : k + 1], start + size) for k in range(6)) if e >= 0), default=len(text))
        yield text[start:end]
        start = end
    yield text[start:]


class Numbers:
    """A table from hashes to consecutive numbers, open-addressed; full: it is emptied."""

    def __init__(self, bits: int = 16):
        self.keys, self.values, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers, -1 for those that aren't there. A hash of 0 counts as 1."""
        mask, out = np.uint64(len(self.keys) - 1), np.full(len(hashes), -1, np.int32)
        hashes = np.maximum(hashes, np.uint64(1))
        open_, at = np.arange(len(hashes)), (hashes & mask).astype(np.int64)
        while len(open_):
            key = self.keys[at]
            hit = key == hashes[open_]
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (key != 0)
            open_, at = open_[more], (at[more] + 1) & int(mask)
        return out

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Number those, which must be distinct and new; their numbers."""
        while (self.n + len(hashes)) * 2 > len(self.keys):
            self._grow()
        numbers = np.arange(self.n, self.n + len(hashes), dtype=np.int32)
        self._put(np.maximum(hashes, np.uint64(1)), numbers)
        self.n += len(hashes)
        return numbers

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            mine = free & (self.keys[at] == hashes)
            self.values[at[mine]] = numbers[mine]
            hashes, numbers, at = hashes[~mine], numbers[~mine], (at[~mine] + 1) & mask

    def _grow(self) -> None:
        used = self.keys != 0
        keys, values = self.keys[used], self.values[used]
        self.keys, self.values = np.zeros(len(self.keys) * 2, np.uint64), np.zeros(len(self.values) * 2, np.int32)
        self._put(keys, values)
