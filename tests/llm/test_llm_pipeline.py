"""The pipeline's stages on the smallest table, each against a plain form of its own on its input."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from tidemark.llm.tokens import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def kept_of_near_copies(docs):
    """Brute force over all pairs: five words, 0.8; the smallest id of each component stays."""
    sets, parent = {}, {}
    for d, t in docs:
        w = WORD.findall(low(t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            i, j = root(a), root(b)
            parent[max(i, j)] = min(i, j)
    return {d for d in sets if root(d) == d}


def copies_of_mix(docs):
    """How often each document is taken: shares above twice a source are cut and shared again; of 20 draws the nearest."""
    size, own = {d: len(WORD.findall(t or "")) for d, t, _ in docs}, defaultdict(list)
    for d, _, s in docs:
        own[s].append(d)
    total = {s: sum(size[d] for d in ids) for s, ids in own.items()}
    order = sorted((s for s in own if s is not None)) + [None] * (None in own)
    left, target, budget = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(total.values())
    while left:
        unit = (budget - sum(target.values())) / sum(left.values())
        over = [s for s, w in left.items() if unit * w > 2 * total[s]]
        target |= {s: 2.0 * total[s] for s in over} if over else {s: unit * w for s, w in left.items()}
        left = {s: w for s, w in left.items() if over and s not in over}
    out = {}
    for s, ids in own.items():
        rate = target[s] / total[s] if total[s] else 0.0
        number = lambda d, k: int(hashlib.md5(f"{d}:42".encode()).hexdigest()[k : k + 13], 16) / 2**52
        draws = [{d: math.floor(rate) + (number(d, k) < rate - math.floor(rate)) for d in ids} for k in range(20)]
        out |= min(draws, key=lambda n: abs(sum(size[d] * c for d, c in n.items()) - target[s]))  # noqa: B023
    return {d: c for d, c in out.items() if c}


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs.toPandas()
    out = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001").persist()
        out[name] = docs.toPandas()
        assert name == "packing" or docs.columns == cp.COLUMNS
    first, exact, near, mixed, packed = (out[n] for n, _ in cp.STAGES)
    # Language ID: what stays is as it was, and nearly all texts in a known language stay.
    assert set(map(tuple, first.astype(str).values)) <= set(map(tuple, before.astype(str).values)) and len(first) >= 198
    assert not any(t is None or not any(map(str.isalpha, t)) for t in first.text)
    assert set(exact.doc_id) == set(first.groupby("text").doc_id.max())
    assert set(near.doc_id) == kept_of_near_copies(list(zip(exact.doc_id, exact.text, strict=True)))
    copies = Counter(mixed.doc_id)
    assert copies == copies_of_mix(list(zip(near.doc_id, near.text, near.source, strict=True)))
    lengths, texts, t = Counter(), dict(zip(mixed.doc_id, mixed.text, strict=True)), Tokenizer.from_file(tokenizer_path())
    for d, c in copies.items():
        n = len(t.encode(texts[d], add_special_tokens=False).ids) + 1
        for k, a in enumerate(range(0, n, 4096)):
            lengths[d, k, a, min(4096, n - a)] += c
    assert Counter(zip(packed.doc_id, packed.piece, packed.start, packed.length, strict=True)) == lengths
    for _, rows in packed.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 4096
