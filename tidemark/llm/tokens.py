"""Tokenization by the tokenizers library, with whole words kept between texts.

word_bpe_49k.json splits at white space before anything else that it does, so that a text's ids are those of its
words, one after the other. Each word is encoded by the library once while it stays in a bounded store; words of
letters go straight to the library's BPE model, any other word through the whole tokenizer, and a text
that may hold an added token goes there as it is.
Texts are lower-cased first (ASCII only; the tokenizer does the rest), and a mark that ends a word is split off.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

from .words import Numbers, Words, blocks

TOKENIZER = "word_bpe_49k.json"
KEPT_WORDS = 1_500_000

_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as it is, the others from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """encode_all(texts in UTF-8) gives the ids of each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.dtype = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.ids, self.starts, self.counts = Numbers(), np.zeros(1 << 16, self.dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0

    def _word(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        if _LETTERS.fullmatch(text):
            return [t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: Words, found: np.ndarray) -> None:
        missing = np.flatnonzero(found < 0)
        new, first, place = np.unique(words.hashes[missing], return_index=True, return_inverse=True)
        lists = [self._word(words.word(k)) for k in missing[first]]
        numbers = self.numbers.add(new)
        found[missing] = numbers[place]
        counts = np.array([len(x) for x in lists], np.int32)
        flat = np.array([i for x in lists for i in x], self.dtype)
        self.ids = room(self.ids, self.used + len(flat))
        self.starts, self.counts = room(self.starts, self.numbers.n), room(self.counts, self.numbers.n)
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[numbers] = self.used + np.cumsum(counts) - counts
        self.counts[numbers] = counts
        self.used += len(flat)

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.numbers.n > KEPT_WORDS:
            self._clear()
        words = Words(texts, marks=True)
        found = self.numbers.find(words.hashes)
        if (found < 0).any():
            self._learn(words, found)
        counts = self.counts[found].astype(np.int64)
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.starts[found] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[words.first]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        whole = {k for k, t in enumerate(texts) if b"<|" in t}
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for at, some in blocks([b"" if k in whole else t for k, t in enumerate(texts)]):
            for k, ids in zip(at, self._block(some), strict=True):
                out[k].append(ids)
        for k in whole:
            out[k] = [np.array(self.tokenizer.encode(texts[k].decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype)]
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def room(array: np.ndarray, n: int) -> np.ndarray:
    return array if n <= len(array) else np.concatenate((array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)))


@cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)
