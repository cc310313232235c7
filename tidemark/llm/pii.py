"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans that these miss.

The base spans follow four patterns, leftmost and non-overlapping for each kind; matches that fail the kind's condition are
dropped. The field labels the tokens around digits, at-signs and bracketed "at" or "dot" (everywhere
else no candidate exists, so that "outside" is certain). Tokens end at white space, at marks that no kind has in it (commas, quotes, colons,
equals signs, slashes, ...), at brackets but for those around "at", "dot", a dot or a short number, and at base spans. In a token above MAX_CHARS each digit or sign opens one of MAX_CHARS, behind the one before, so that
no part of a text is left out. A candidate is a run of at most
MAX_TOKENS tokens and MAX_CHARS characters without such a mark or a base span, its marks at the ends taken off, and is scored as a whole: by the shape of its groups of digits, separators, checks
like Luhn's, and the word before it. Segments exclude one another; dynamic programming over token bounds sums all
segmentations forwards and backwards, and the best one chooses boundaries and kinds together. A segment of it becomes a span
if its probability is at least MIN_PROBABILITY.

The field is trained on the driver by its conditional likelihood, on EXAMPLES labelled lines that a seeded generator
makes (national and spaced phone numbers, grouped cards, defanged addresses, spelled e-mail; dates, prices, versions, keys
and other numbers as opposites): documents have no such labels.

Null texts count as empty, and have no spans. Spans count code points, their end is exclusive. Each row stands for
itself, so that ties and repeated rows have results of their own. Very long texts are searched whole. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_of

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_CHARS = 7, 80
FEATURES = 1 << 12
EXAMPLES, EPOCHS, RATE, DECAY = 900, 4, 0.3, 1e-5
MIN_PROBABILITY = 0.9
SEED = 11

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind by start, then kind in order of KINDS."""
    found: list[tuple[int, int, int]] = []
    # Each at-sign has one possible match: from the first local character before it that no match has taken.
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            free = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


# --- candidates and their features


_TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.IGNORECASE)
_TOKEN = re.compile(r"""(?:[\[({](?:at|dot|\.|[0-9]{1,4})[\])}]|[^\s,"'`:;=|<>{}\[\]()/?&#~\\])+""", re.IGNORECASE)
_MARK = re.compile(r"""[,"'`:;=|<>{}/?&#~\\]""")
_BEGIN = re.compile(r"[\w+(\[]")
_WORD_AT = re.compile(r"\s*[\[({]\s*(at|dot|\.)\s*[\])}]\s*", re.IGNORECASE)
_LEFT, _RIGHT = "\"'([{<,;:", "\"')]}>,;:.!?*#%$&"


def _short(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The token; of one above MAX_CHARS, what follows each trigger."""
    if a < b <= a + MAX_CHARS:
        yield a, b
        return
    while t := _TRIGGER.search(text, a, b):
        a = min(t.start() + MAX_CHARS, b)
        yield t.start(), a


def _tokens(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Tokens outside of base spans, and (start, -1) for each of these."""
    at = 0
    for start, end, _ in [*taken, (len(text), len(text), "")]:
        if start > at:
            for m in _TOKEN.finditer(text, at, start):
                a, b = m.span()
                if a == at > 0:  # what joins it to a base span isn't of it
                    first = _BEGIN.search(text, a, b)
                    a = first.start() if first else b
                yield from _short(text, a, b)
        if start < len(text):
            yield start, -1
        at = max(at, end)


def regions(text: str, taken: list[tuple[int, int, str]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens near a trigger, as spans; a base span ends a run, and the rest of a token that it cuts is a token."""
    if not _TRIGGER.search(text):
        return
    run: list[tuple[int, int]] = []
    quiet, before = 0, None
    for a, b in _tokens(text, taken):
        if b < 0:  # a base span
            if run:
                yield run
            run, before = [], None
            continue
        loud = bool(_TRIGGER.search(text, a, b))
        if run:
            run.append((a, b))
            quiet = 0 if loud else quiet + 1
            if quiet >= 2:
                yield run
                run = []
        elif loud:
            run, quiet = ([before] if before else []) + [(a, b)], 0
        before = (a, b)
    if run:
        yield run


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _LEFT and not re.match(r"\(\d+\)|[\[({](?:at|dot)", text[start:end], re.IGNORECASE):
        start += 1
    while end > start and text[end - 1] in _RIGHT:
        end -= 1
    return start, end


def features(span: str, before: str) -> list[str]:
    """What is seen of a candidate as a whole. before: the word before it."""
    plain = _WORD_AT.sub(lambda m: "@" if m.group(1).lower() == "at" else ".", span)
    digits = re.sub("[^0-9]", "", plain)
    shape = re.sub("[A-Za-zÀ-ÿ]+", "a", re.sub("[0-9]+", lambda m: str(min(len(m.group()), 20)) + "d", plain))
    groups = "-".join(str(len(g)) for g in re.findall("[0-9]+", plain))
    marks = "".join(sorted(set(re.sub("[A-Za-zÀ-ÿ0-9]", "", plain))))
    out = [f"shape={shape[:60]}", f"groups={groups[:40]}", f"marks={marks[:20]}", f"groups+marks={groups[:40]}|{marks[:20]}", f"digits={min(len(digits), 20)}", f"before={before.lower().strip(_LEFT + _RIGHT)[:12]}"]
    out.append(f"starts={'d' if plain[:1].isdigit() else 'a' if plain[:1].isalpha() else plain[:1]}")
    out.append(f"luhn={12 <= len(digits) <= 19 and luhn(digits)}")
    parts = re.fullmatch(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})", plain)
    out.append(f"ip={bool(parts) and all(int(p) < 256 for p in parts.groups())}")
    out.append(f"mail={bool(re.fullmatch(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', plain))}")
    out.append(f"letters={bool(re.search('[A-Za-zÀ-ÿ]', plain))}|{plain != span}")
    return out


@lru_cache(maxsize=20_000)
def _slots(span: str, before: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(f.encode()) % FEATURES for f in features(span, before))


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, int, tuple[int, ...]]]:
    """first token, token after the last, span, slots of features."""
    out = []
    for i in range(len(tokens)):
        before = text[tokens[i - 1][0] : tokens[i - 1][1]] if i else ""
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            if tokens[j][1] - tokens[i][0] > MAX_CHARS or (i < j and _MARK.search(text, tokens[j - 1][1], tokens[j][0])):
                break
            a, b = trimmed(text, tokens[i][0], tokens[j][1])
            span = text[a:b]
            if _TRIGGER.search(span) and not (i < j and (a >= tokens[i][1] or b <= tokens[j][0])):
                out.append((i, j + 1, a, b, _slots(span, before[-20:])))
    return out


# --- the field


class Field:
    """weights: kinds x features; links: from the kind before (the last: none) to a kind."""

    def __init__(self, weights: np.ndarray, links: np.ndarray):
        self.weights, self.links = weights, links

    def scores(self, found: list) -> np.ndarray:
        return np.array([self.weights[:, list(s)].sum(axis=1) for *_, s in found]).reshape(len(found), len(KINDS))

    def sums(self, n: int, found: list, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Log sums over segmentations up to and from each token bound, by the last kind (the last row: none yet), and over all."""
        k = len(KINDS)
        ahead, back = np.full((n + 1, k + 1), -np.inf), np.full((n + 1, k + 1), -np.inf)
        ahead[0, k], back[n] = 0.0, 0.0
        by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for c, (i, j, *_) in enumerate(found):
            by_end[j].append((c, i))
            by_start[i].append((c, j))
        for t in range(1, n + 1):
            ahead[t] = ahead[t - 1]  # an outside token
            for c, i in by_end[t]:
                ahead[t, :k] = np.logaddexp(ahead[t, :k], np.logaddexp.reduce(ahead[i][:, None] + self.links, axis=0) + scores[c])
        for t in range(n - 1, -1, -1):
            back[t] = back[t + 1]
            for c, j in by_start[t]:
                back[t] = np.logaddexp(back[t], np.logaddexp.reduce(self.links + (scores[c] + back[j, :k])[None], axis=1))
        return ahead, back, float(np.logaddexp.reduce(ahead[n]))

    def chances(self, n: int, found: list, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probability of each candidate with each kind; expected counts of links; log of the sum over all segmentations."""
        ahead, back, total = self.sums(n, found, scores)
        out, links = np.zeros((len(found), len(KINDS))), np.zeros_like(self.links)
        for c, (i, j, *_) in enumerate(found):
            both = np.exp(ahead[i][:, None] + self.links + (scores[c] + back[j, :-1])[None] - total)
            out[c] = both.sum(axis=0)
            links += both
        return out, links, total

    def best(self, n: int, found: list, scores: np.ndarray) -> list[tuple[int, int]]:
        """The best segmentation: candidates and their kinds."""
        k = len(KINDS)
        value, back = np.full((n + 1, k + 1), -np.inf), {}
        value[0, k] = 0.0
        by_end = [[] for _ in range(n + 1)]
        for c, (i, j, *_) in enumerate(found):
            by_end[j].append((c, i))
        for t in range(1, n + 1):
            value[t] = value[t - 1]
            for c, i in by_end[t]:
                through = value[i][:, None] + self.links
                total, left = through.max(axis=0) + scores[c], through.argmax(axis=0)
                for y in np.flatnonzero(total > value[t, :k]):
                    value[t, y] = total[y]
                    back[t, int(y)] = (c, i, int(left[y]))
        out, t, y = [], n, int(value[n].argmax())
        while t > 0:
            if (t, y) in back and (value[t, y] > value[t - 1, y]):
                c, i, left = back[t, y]
                out.append((c, y))
                t, y = i, left
            else:
                t -= 1
        return out[::-1]

    def spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        out = []
        for tokens in regions(text, base):
            found = candidates(text, tokens)
            if not found:
                continue
            scores = self.scores(found)
            best = self.best(len(tokens), found, scores)
            if best:
                chance, _, _ = self.chances(len(tokens), found, scores)
                out += [(found[c][2], found[c][3], KINDS[y]) for c, y in best if chance[c, y] >= MIN_PROBABILITY]
        return out


# --- training


def _with_luhn(r: random.Random, n: int) -> str:
    head = str(r.choice((3, 4, 5))) + "".join(str(r.randrange(10)) for _ in range(n - 2))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def _positive(r: random.Random) -> tuple[str, str]:
    """A span and its kind."""
    d = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randrange(3, 9)))
    kind = r.choice(KINDS)
    if kind == "phone":
        area, mid, end, s = r.choice("23456789") + d(2), d(3), d(4), r.choice("-. ")
        return r.choice((f"({area}) {mid}-{end}", f"({area}){mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"1-{area}-{mid}-{end}", f"+1 ({area}) {mid}-{end}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}")), kind
    if kind == "card":
        n, s = _with_luhn(r, 16), r.choice(("-", ".", " "))
        return (s.join(n[k : k + 4] for k in range(0, 16, 4)) if r.random() < 0.7 else (lambda a: f"{a[:4]}{s}{a[4:10]}{s}{a[10:]}")(_with_luhn(r, 15))), kind
    if kind == "ip":
        parts = [str(r.randrange(1, 256)) for _ in range(4)]
        return r.choice((".", "[.]", "(.)", "[dot]")).join(parts), kind
    at, dot = r.choice((("@", "."), ("@", "[.]"), (" (at) ", "."), (" [at] ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]")))
    host = [word(), *([word()] if r.random() < 0.3 else []), r.choice(("com", "org", "net", "example", "edu"))]
    return r.choice((word(), f"{word()}.{word()}", f"{word()}{d(2)}")) + at + dot.join(host), "email"


def _negative(r: random.Random) -> str:
    d = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    key = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 16, 32, 40, 64))))
    return r.choice((
        f"{r.randrange(1900, 2040)}", f"{r.randrange(1900, 2040)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"v{d(1)}.{d(1)}.{d(1)}.{d(1)}",
        f"${d(1)},{d(3)}.{d(2)}", f"{d(2)}%", key, f'"{key}"', f"token = \"{key}\"", f"#{d(5)}", f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", d(r.randrange(1, 12)), "{} {} {}".format(*(r.randrange(1, 100) for _ in range(3))), f"{d(3)} {d(3)} {d(3)}", f"{d(2)}-{d(2)}", f"({d(1)})", f"[{d(2)}]", f"x{d(2)}y{d(2)}",
        f"{d(1)}.{d(1)}.", f"page {d(2)}", f"@{key[:6]}", f"{d(4)}-{d(4)}", f"{d(8)}-{key[:4]}-{key[4:8]}-{key[2:6]}-{d(12)}", f"{d(1)},{d(3)},{d(3)}",
        f"{256 + r.randrange(700)}.{d(1)}.{d(1)}.{d(1)}", d(16) if r.random() < 0.5 else d(20), f"{d(4)} {d(4)} {d(4)} {d(4)}" if r.random() < 0.4 else f"{d(2)} {d(2)}",
    ))


def examples(seed: int = SEED, n: int = EXAMPLES) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated lines with the spans in them."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice(("an", "er", "on", "the", "ti", "el", "re", "ch", "la", "de", "st", "in", "ou", "é", "ü")) for _ in range(r.randrange(1, 4)))
    cue = {"phone": ("call", "phone", "tel:", "fax"), "email": ("mail", "contact", "write"), "card": ("card", "visa", "paid"), "ip": ("host", "from", "server")}
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randrange(1, 4))), []
        for _ in range(r.randrange(1, 3)):
            if r.random() < 0.5:
                span, kind = _positive(r)
                text += f" {r.choice(cue[kind])}" if r.random() < 0.4 else ""
                spans.append((len(text) + 1, len(text) + 1 + len(span), kind))
                text += f" {span}{r.choice(('', '', '.', ',', '!!', '***'))}"
            else:
                text += f" {_negative(r)}{r.choice(('', '', '.', ',', '###'))}"
            text += "".join(f" {word()}" for _ in range(r.randrange(2, 5)))
        out.append((text, spans))
    return out


@cache
def trained(seed: int = SEED, n: int = EXAMPLES) -> Field:
    """AdaGrad on the conditional log likelihood, in a fixed order: the same field each time."""
    field = Field(np.zeros((len(KINDS), FEATURES)), np.zeros((len(KINDS) + 1, len(KINDS))))
    seen, seen_links = np.full_like(field.weights, 1e-6), np.full_like(field.links, 1e-6)
    cases = []
    for text, spans in examples(seed, n):
        for tokens in regions(text, []):
            found = candidates(text, tokens)
            truth = {(c[2], c[3]): k for k, c in enumerate(found)}
            own = [(truth[a, b], KINDS.index(kind)) for a, b, kind in spans if (a, b) in truth]
            if found:
                cases.append((len(tokens), found, own, np.array([s for *_, s in found])))
    r = random.Random(seed)
    for _ in range(EPOCHS):
        r.shuffle(cases)
        for tokens, found, own, slots in cases:
            chance, links, _ = field.chances(tokens, found, field.scores(found))
            want, want_links, last = -chance, -links, len(KINDS)
            for c, y in own:
                want[c, y] += 1
                want_links[last, y] += 1
                last = y
            active = np.abs(want).max(axis=1) > 1e-6
            for y in range(len(KINDS)):
                flat, w = slots[active].ravel(), np.repeat(want[active, y], slots.shape[1])
                used, place = np.unique(flat, return_inverse=True)
                step = np.bincount(place, w, len(used)) - DECAY * field.weights[y, used]
                seen[y, used] += step**2
                field.weights[y, used] += RATE * step / np.sqrt(seen[y, used])
            seen_links += want_links**2
            field.links += RATE * want_links / np.sqrt(seen_links)
    return field


# --- tables


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = {k: n for n, k in enumerate(KINDS)}
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id, base and added: arrays of kind, start and end."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())
    names = ("kind", "start", "end")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = shared.value
        for batch in batches:
            base = [base_spans(t) for t in batch["text"]]
            added = [field.spans(t, b) for t, b in zip(batch["text"], base, strict=True)]
            pack = lambda lists: [[dict(zip(names, (k, a, b), strict=True)) for a, b, k in spans] for spans in lists]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "base": pack(base), "added": pack(added)})

    small_batches(docs.sparkSession)
    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, f"doc_id long, base {span}, added {span}")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shared = spark.sparkContext.broadcast(trained())
    columns = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                base = base_spans(text)
                added = shared.value.spans(text, base)
                kinds = [k for *_, k in base]
                rows.append((doc, *(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
