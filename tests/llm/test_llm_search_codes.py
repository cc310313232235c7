"""Pieces against the library, vector codes and ranked search against plain loops, with nulls, ties, repeated rows, hot groups and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import pieces, search, vector_codes

EXTRA = "ids array<int>, decoded string, data string, code int, score string, rank long, place string, salt int, key string"


def tagged(df):
    """With extra columns whose names are those that the operators use."""
    return df.selectExpr("*", "array(7) AS ids", "'x' AS decoded", "'y' AS data", "3 AS code", "'z' AS score", "9L AS rank", "'p' AS place", "1 AS salt", "'k' AS key")


# --- 11: pieces


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(pieces.model_path())


def test_pieces_of_odd_texts(encoder, monkeypatch):
    r = random.Random(3)
    letters = "aaaabcdeé ▁  \n\tthérin漢ﬁ\0<0x>s/12"
    texts = ["", " ", "▁", "  a", "a" * 700, "th" * 400, "漢ﬁ" * 300, " " * 900 + "x", "<s></s><unk><0x0A>", *("".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(4000))]
    want = encoder.library.encode(texts)
    same = lambda: [list(map(int, x)) for x in encoder.encode_all(texts)] == want
    assert same()
    assert same()  # from what is kept
    for name, value in (("LONG", 1), ("LONG", 10_000), ("BLOCK", 50), ("KEPT_WORDS", 20), ("KEPT_PAIRS", 50), ("SIDE_BY_SIDE", 3)):
        monkeypatch.setattr(pieces, name, value)
        encoder._clear()
        assert same(), name


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_pieces_of_any_text(texts):
    own = pieces.encoder(pieces.model_path())
    assert [list(map(int, x)) for x in own.encode_all(texts)] == own.library.encode(texts)


def test_neighbours_rejoined(encoder):
    """Each row's neighbours hold, and a greedy longest row of another text doesn't: the check decides."""
    r, failed = random.Random(8), 0
    for _ in range(300):
        word = "▁" + "".join(r.choice("etaoinshrdlu") for _ in range(12))
        row = [encoder.string(p) for p in encoder.split_long(word)]
        assert "".join(row) == word and all(encoder.joined(a + b, len(a)) for a, b in zip(row, row[1:]))
        greedy, at, longest = [], 0, encoder.automaton.longest_one(word)
        while at < len(word):
            greedy.append(encoder.string(longest[at]))
            at += len(greedy[-1])
        failed += greedy != row
    assert failed > 30


def test_pieces_table(spark):
    texts = [None, "", " a  b ", "x" * 5000, "The same", "The same", "漢字\n\t", "word " * 3000]
    df = tagged(spark.createDataFrame([*enumerate(texts), (None, "no id")], "doc_id long, text string")).drop("decoded").withColumn("decoded", F.lit(1))
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), r.decoded) for r in pieces.encoded(df.repartition(3)).collect())
    library = pieces.encoder(pieces.model_path()).library
    rows = [(False, k, [*library.encode(t or ""), 2]) for k, t in enumerate(texts)] + [(True, 0, [*library.encode("no id"), 2])]
    assert got == [(*r, library.decode(r[2])) for r in rows]
    assert pieces.encoded(df.where("false")).count() == 0


def test_op11(spark):
    folder = "/root/testdata/sf0.001"
    library = pieces.encoder(pieces.model_path()).library
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = [*library.encode(r.text or ""), 2]
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert {tuple(r) for r in pieces.op11_pieces(spark, folder).collect()} == want


# --- 12: vector codes


def plain_codes(vectors, entries=16, rounds=6):
    """{row: (code, error)} and the codebooks, by loops over whole numbers."""
    kept = [(k, [math.floor(4096 * float(np.float32(x))) for x in v]) for k, v in vectors]
    width = len(kept[0][1]) // 8
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v in kept[:entries]] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            own = [[] for _ in books[p]]
            for _, v in kept:
                own[near(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(xs) for c in zip(*xs, strict=True)] if xs else b for xs, b in zip(own, books[p], strict=True)]
    out = {}
    for n, (k, v) in enumerate(kept):
        found = [near(part(v, p), books[p]) for p in range(8)]
        out[n] = (k, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found))
    return list(out.values()), books


@pytest.mark.parametrize(("length", "n"), [(8, 60), (16, 5), (40, 90), (64, 40)])
def test_vector_codes(spark, length, n):
    r = random.Random(length)
    base = [[r.gauss(0, 1) for _ in range(length)] for _ in range(12)]
    rows = [(k, [b + r.choice((0, 0.001, 0.3)) for b in r.choice(base)], r.choice((1, 2, None))) for k in range(n)]
    rows += [(n + k, rows[0][1], 7) for k in range(40)]  # many copies
    odd = [(900, None, 1), (901, [float("nan")] * length, 1), (902, [None, *[0.0] * (length - 1)], 1), (903, [float("inf")] * length, None)]
    df = tagged(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int")).drop("label_").repartition(3)
    codes, books = vector_codes.compressed(vector_codes.kept_vectors(df))
    want, plain = plain_codes([(k, v) for k, v, _ in rows])
    assert sorted((r.vec_id, r.code, r.error) for r in codes.collect()) == want
    assert [b.tolist() for b in books] == plain


def test_bounds_never_drop_the_nearest():
    r = np.random.default_rng(5)
    for width in (1, 2, 5, 8, 33):
        for spread in (3, 2000, 1 << 26):
            entries, rows = r.integers(-spread, spread + 1, (16, width)), r.integers(-spread, spread + 1, (500, width))
            entries[5] = entries[2]
            rows[:50] = entries[r.integers(0, 16, 50)]
            far = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
            nearest, least = vector_codes.Bounds(entries).nearest(rows)
            assert (nearest == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_vectors_that_have_no_code(spark):
    schema = "vec_id long, embedding array<float>, label int"
    make = lambda *rows: vector_codes.kept_vectors(spark.createDataFrame(list(rows), schema))
    codes, _ = vector_codes.compressed(make())
    assert codes.count() == 0
    codes, _ = vector_codes.compressed(make((1, [], None), (None, [], 2)))
    assert sorted((r.code, r.error) for r in codes.collect()) == [("00" * 8, 0)] * 2
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compressed(make((1, [0.5] * 9, 1)))
    for rows, message in ((((1, [0.5] * 8, 1), (2, [0.5] * 16, 1)), "differ in length"), (((1, [0.5] * 8, 1), (2, [1e30] * 8, 1)), "64 bits")):
        with pytest.raises(Exception, match=message):
            vector_codes.compressed(make(*rows))


# --- 13: ranked search


def plain_search(docs, items, k=10):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    terms = lambda t: term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(d, Counter(terms(t))) for d, t in docs]
    rows = [(d, c, sum(c.values())) for d, c in rows if c]
    n_docs, n_words, df = len(rows), sum(n for *_, n in rows), Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in rows:
            m = 25 + 75 * n * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_DOCS", 7), ("GROUP_TERMS", 12), ("SALTS", 2)):
            monkeypatch.setattr(search, name, value)
    r = random.Random(6)
    words = [*"abcdefgh", "é", "Ünï", "x1", "漢字", "THE", "the"]
    text = lambda n: "".join(r.choice(words) + r.choice((" ", ", ", "\n", "'", "-")) for _ in range(n))
    copy = text(9)
    texts = [None, "", "...", " \n", *(text(r.randrange(1, 60)) for _ in range(60)), *[copy] * 30, text(4000), "the " * 50]
    docs = [*((k, t) for k, t in enumerate(texts)), (3, text(5)), (None, copy)]
    items = [(1, "a b c the"), (2, copy), (2, "Ünï a a a"), (3, None), (4, "?!"), (5, "nowhere"), (None, "x1 the THE 漢字"), *((10 + k, text(12)) for k in range(5))]
    d = tagged(spark.createDataFrame(docs, "doc_id long, text string")).repartition(4)
    i = tagged(spark.createDataFrame(items, "item_id long, text string"))
    got = search.search(d, i).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == plain_search(docs, items)
    assert search.search(d.where("false"), i).count() == 0 and search.search(d, i.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_search"])
def test_equal_to_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    query, sql = {"op12_vector_codes": (vector_codes.op12_vector_codes, vector_codes.OP12_SQL), "op13_search": (search.op13_search, search.OP13_SQL)}[name]
    got = query(spark, folder)
    want = con.sql(sql).select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want
