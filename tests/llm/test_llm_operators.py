"""Each operator against a plain form on a small table with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, exact_dedup, langid, lm, media, mixing, near_dedup, packing, pii, token_files
from tidemark.llm.tokens import encoder, tokenizer_path
from tidemark.llm.words import Words, cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, row long, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def make_rows():
    r = random.Random(4)
    word = lambda: "".join(r.choice(("an", "er", "the", "ti", "é", "ü", "on", "st")) for _ in range(r.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(120)
    near = [re.sub(r"^\S+", f"x{k}", base) for k in range(6)]
    texts = [None, "", "  \n\t", "One", "one", text(30), text(30), base, base, *near, text(9000), "x" * 300, "A. b, c.", "mail a.b@c.de on +1 (743) 555-3824 or 4465758382889437 at 10.0.0.1 at", *(text(r.randrange(5, 80)) for _ in range(25))]
    rows = [(k, t, ("en", "fr", None)[k % 3], ("a", "b", None, "a")[k % 4], 1, 7, "x", 3, True) for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, "null id here", "en", "a", 1, 7, "x", 3, True)]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exact_groups(docs, empty):
    groups = defaultdict(list)
    for d, t, *_ in ROWS:
        groups[t or ""].append(d)
    top = {t: max(d for d in ids if d is not None) if any(d is not None for d in ids) else None for t, ids in groups.items()}
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(groups)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert all(r["keep_id"] == top[by_hash[r["text_sha256"]]] and r["group_size"] == len(groups[by_hash[r["text_sha256"]]]) for r in got)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and Counter(r["text"] or "" for r in kept.collect()) == Counter(groups.keys())
    assert rows(exact_dedup.exact_groups(docs, max_bits=1 << 16)) and rows(exact_dedup.exact_groups(empty)) == [] and rows(exact_dedup.deduplicate(empty)) == []


def test_exact_groups_in_slices(spark):
    df = spark.range(9000).select("id", F.concat(F.lit("t"), F.when(F.col("id") % 3 == 0, F.col("id") % 600).otherwise(F.col("id"))).alias("text")).toDF("doc_id", "text").repartition(3)
    texts = defaultdict(list)
    for d, t in df.collect():
        texts[t].append(d)
    for bits in (1 << 27, 1 << 16):  # one filter, and four
        got = exact_dedup.exact_groups(df, max_bits=bits).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == sorted((d, max(g), len(g), d == max(g)) for g in texts.values() for d in g)
        assert sorted(tuple(r) for r in exact_dedup.deduplicate(df, max_bits=bits).collect()) == sorted((max(g), t) for t, g in texts.items())


def test_mixing(docs, empty, spark):
    sized = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    got = mixing.with_copies(sized).collect()
    sizes = defaultdict(int)
    for _, t, _, s, *_ in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    left, target, budget = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(sizes.values())
    while left:  # shares above the limit are cut and the excess is shared again
        unit = (budget - sum(target.values())) / sum(left.values())
        over = [s for s, w in left.items() if unit * w > 2 * sizes[s]]
        if not over:
            target |= {s: unit * w for s, w in left.items()}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            del left[s]
    for r in got:
        assert math.isclose(r["target"], target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        rate = target[r["source"]] / sizes[r["source"]]
        assert r["copies"] in (math.floor(rate), math.floor(rate) + 1) and r["copies"] <= 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.with_copies(sized).collect()))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert rows(mixing.mixed(empty)) == []


def test_mix_comes_near_its_targets(spark):
    """Of the fixed draws a source takes the nearest; columns named like the operator's own don't disturb it."""
    r = random.Random(12)
    data = [(k, f"s{r.randrange(6)}", r.randrange(20, 200), "d", "t", "p") for k in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, source string, size long, docs string, target string, draw string")
    got = mixing.with_copies(df).collect()
    assert got[0].__fields__ == ["doc_id", "source", "size", "docs", "draw", "source_size", "target", "copies"] and {x["docs"] for x in got} == {"d"}
    for s in {x["source"] for x in got}:
        own = [x for x in got if x["source"] == s]
        taken = lambda draw: sum(x["size"] * (math.floor(rate) + (int(hashlib.md5(f"{x['doc_id']}:42".encode()).hexdigest()[draw : draw + 13], 16) / 2**52 < rate % 1)) for x in own)  # noqa: E731, B023
        rate = own[0]["target"] / own[0]["source_size"]
        off = [abs(taken(k) - own[0]["target"]) for k in range(mixing.DRAWS)]
        assert abs(sum(x["size"] * x["copies"] for x in own) - own[0]["target"]) == min(off) < 0.03 * own[0]["target"]


def test_mixing_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    df = spark.createDataFrame([(k, None if k % 5 == 4 else f"s{k % 5}", 10 + k) for k in range(60)], "doc_id long, source string, size long")
    a = {(r["doc_id"], r["copies"], r["target"]) for r in mixing.with_copies(df).collect()}
    monkeypatch.undo()
    assert a == {(r["doc_id"], r["copies"], r["target"]) for r in mixing.with_copies(df).collect()} and len(a) == 60


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = [x[1] or "" for x in ROWS] + ["<|endoftext|> It's 'RE é ß İ ΣΑΣ a b \x1cfoo ½ … ,a. .b, c.", "A,\n. , b. c.", "y " * 400_000]
    assert [x.tolist() for x in encoder(tokenizer_path()).encode_all([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing(docs, empty):
    enc, want = encoder(tokenizer_path()), Counter()
    for d, t, *_ in ROWS:
        ids = np.append(enc.encode_all([(t or "").encode()])[0].astype("<u4"), np.uint32(1))
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[d, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    got = packing.packed(docs).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert rows(packing.packed(empty)) == []


def test_plan_is_near_its_bound():
    r = random.Random(1)
    h = Counter(min(4096, int(r.lognormvariate(6.5, 1))) or 1 for _ in range(20_000))
    p, got = packing.plan(h), Counter()
    for uses, found in p:
        assert sum(k * t for k, t in found.items()) <= 4096
        for k, t in found.items():
            got[k] += uses * t
    assert got == h and sum(u for u, _ in p) <= 1.001 * sum(k * n for k, n in h.items()) / 4096 + 1
    assert packing.share_of_program(h) > 0.9


@pytest.mark.parametrize("counts", [{4096: 5}, {1: 3}, {4095: 4, 2: 1}, {3000: 7, 2000: 9}, {1366: 100}, {}])
def test_plan_of_odd_histograms(counts):
    got = Counter()
    for uses, found in packing.plan(counts):
        assert uses > 0 and sum(k * t for k, t in found.items()) <= 4096
        for k, t in found.items():
            got[k] += uses * t
    assert got == counts


def test_program_prices_what_is_left():
    """The knapsack's value for each capacity equals that of a search through all multisets."""
    lengths, values = np.array([3, 5, 7]), np.array([0.4, 0.5, 0.9])
    best, _ = packing.knapsack(lengths, values, 20)
    for c in range(21):
        each = ((a * 0.4 + b * 0.5 + d * 0.9, c - 3 * a - 5 * b - 7 * d) for a in range(7) for b in range(5) for d in range(3))
        assert math.isclose(best[c], max(v - packing.WASTE / 20 * free for v, free in each if free >= 0), abs_tol=1e-9)


def brute(words, percent):
    sets = []
    for _, t, *_ in ROWS:
        w = WORD.findall(low(t))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    ids = [-(1 << 63) if r[0] is None else r[0] for r in ROWS]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(list(zip(ids, sets, strict=True)), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return {(None if i == -(1 << 63) else i, len(s), None if root(i) == -(1 << 63) else root(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize("rule", [near_dedup.Rule(words=3, percent=85), near_dedup.Rule()])
def test_near_duplicates(docs, empty, rule):
    got = near_dedup.grouped(docs, rule).collect()
    assert len(got) == len(ROWS)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rule.words, rule.percent)
    if rule.words == 5:
        kept = near_dedup.kept_documents(docs, rule)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"] or r["doc_id"] is None}
        assert rows(near_dedup.grouped(empty, rule)) == []


def test_chains_and_blocks(spark, monkeypatch):
    """A chain of near copies whose ends aren't alike, compared in blocks of two."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 2)
    words = [f"w{k}" for k in range(200)]
    chain = [" ".join([*(f"c{j}" for j in range(4 * k)), *words[4 * k :]]) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.grouped(df, near_dedup.Rule(words=3, percent=85)).collect()} == {0}


def test_common_counts_and_forest(monkeypatch):
    monkeypatch.setattr(near_dedup, "SLICE", 7)
    r = np.random.default_rng(8)
    sets = [np.unique(r.integers(1, 60, n).astype(np.uint64)) for n in (40, 50, 60, 45, 3)]
    sets.append(sets[1][:-1])
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = near_dedup.common_counts(sets)
    assert all(got[i][j] == want[i][j] for i in range(6) for j in range(6) if i != j)
    copies = [np.append(sets[0], np.uint64(1000 + k)) for k in range(30)]
    found = near_dedup.forest(np.arange(30), np.arange(30), copies, 85)
    assert len(found) == 29 and len({x for pair in found for x in pair}) == 30
    assert near_dedup.forest(np.arange(30), np.zeros(30), copies, 85) == []


def test_many_texts_just_below_the_threshold(spark, monkeypatch):
    """A large group of like texts, few of them linked: components equal brute force, and no stage gives more links than texts."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    r = random.Random(6)
    core = [f"w{k}" for k in range(120)]

    def near(words, changes):
        words = list(words)
        for k in r.sample(range(len(words)), changes):
            words[k] = f"x{r.randrange(10**9)}"
        return words

    texts = [near(core, r.choice((4, 5, 6, 7))) for _ in range(180)]
    texts += [near(t, 2) for t in texts[:25]] + [core, near(core, 1)]
    sets = [{tuple(t[i : i + 3]) for i in range(118)} for t in texts]
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    seen = {}

    def noted(df, name, stored=near_dedup.stored):
        out = stored(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "stored", noted)
    got = near_dedup.grouped(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"), near_dedup.Rule(words=3, percent=85)).collect()
    assert [r["component_id"] for r in sorted(got)] == [find(k) for k in range(len(texts))] and len({find(k) for k in range(len(texts))}) > 100
    assert "split" in seen and max(seen["links"]) < len(texts) and seen["rest"][0] <= len(texts) * near_dedup.Rule(words=3, percent=85).bands


def test_signature_estimates_similarity():
    r = np.random.default_rng(2)
    pool = r.integers(1, 1 << 62, 900).astype(np.uint64)
    a, b = np.unique(pool[:600]), np.unique(pool[150:750])
    s = near_dedup.super_minhash([a, b, a[:5]], 240)
    assert abs((s[0] == s[1]).mean() - 450 / 750) < 0.12 and (s < 0xFFFFFFFF).all()
    assert (near_dedup.super_minhash([a], 240)[0] == s[0]).all()


def test_media(docs, empty):
    index = media.write_media(docs)
    found = {bytes(r["digest"]): r for r in media.features(media.contents(index)).collect()}
    heads = {bytes(r["digest"]): r for r in media.metadata(media.contents(index)).collect()}
    got = index.collect()
    assert len(got) == len(ROWS)
    want = Counter()
    for _, t, *_ in ROWS:
        p = media.payload((t or "").encode())
        want[hashlib.sha256(p).digest()] += 1
        f = found[hashlib.sha256(p).digest()]
        assert (f["payload_bytes"], f["payload_sha256"], f["tail_crc32"], f["feature"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), media.feature(p))
        assert heads[hashlib.sha256(p).digest()]["height"] == len(p) // 576
    assert {k: v["rows"] for k, v in found.items()} == dict(want) and rows(media.write_media(empty)) == []


def test_token_files(docs, empty):
    got = sorted(token_files.read_tokens(token_files.write_tokens(docs, shard_rows=10)).collect(), key=lambda r: r["start"])
    enc, at = encoder(tokenizer_path()), 0
    order = [(-math.inf if r["doc_id"] is None else r["doc_id"]) for r in got]
    assert order == sorted(order) and len(got) == len(ROWS)
    texts = {d: (t or "") for d, t, *_ in ROWS}
    for r in got:
        ids = np.append(enc.encode_all([texts[r["doc_id"]].encode()])[0].astype("<u4"), np.uint32(2))
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert rows(token_files.read_tokens(token_files.write_tokens(empty))) == []


def test_block_coding_of_any_width():
    import io

    ids = [np.array([5] * 400 + list(range(1000, 1600)), np.uint32), np.zeros(0, np.uint32), np.arange(70_000, dtype=np.uint32)]
    blocks = list(token_files.read_blocks(io.BytesIO(token_files.encode_block([3, 4, -1], ids) + token_files.encode_block([], []))))
    assert blocks[0][0].tolist() == [3, 4, -1] and (blocks[0][2] == np.concatenate(ids)).all() and len(blocks[1][2]) == 0


def test_pii(docs, empty):
    text = "mail a.b@c.de, (743) 555-3824 and +1 (743) 555-3824 with 4465-7583-8288-9437 or 256.1.1.1 but 10.0.0.1"
    spans = [(k, text[a:b]) for a, b, k in pii.base_spans(text)]
    assert spans == [("email", "a.b@c.de"), ("phone", "+1 (743) 555-3824"), ("card", "4465-7583-8288-9437"), ("ip", "10.0.0.1")]
    field = pii.trained()
    assert [(k, text[a:b]) for a, b, k in field.spans(text, pii.base_spans(text))] == [("phone", "(743) 555-3824")]
    assert field.spans("Version 2.0 of 2024-01-05 costs $3.50, page 12.", []) == []
    assert pii.redacted(text, pii.base_spans(text)).startswith("mail <email>, (743)")
    got = {r["doc_id"]: r for r in pii.with_spans(docs).collect()}
    assert len(got[next(d for d, t, *_ in ROWS if t and "@" in t)]["base"]) == 4 and got[0]["base"] == [] and rows(pii.with_spans(empty)) == []


def test_field_bounds_spans_inside_joined_tokens():
    field = pii.trained()
    number = "743-555-3824"
    for text in (f"ann,{number},x", f"ann,b,{number}", f'{{"name":"ann","tel":"{number}","n":[1,2]}}', f"{'y' * 100}={number}", f"call:[{number}] now", f"mail a.b@c.de/{number} or so", f"f({number})"):
        assert [(k, text[a:b]) for a, b, k in field.spans(text, pii.base_spans(text))] == [("phone", number)], text
    for text in ("ann,2024-01-05,12:30:45,$3,500.00", '{"v":[1,22,333],"id":"8f3a","day":"05/06/2024"}'):
        assert field.spans(text, pii.base_spans(text)) == [], text


def test_field_sums_equal_all_segmentations():
    r = np.random.default_rng(3)
    found = [(0, 1, 0, 0, ()), (0, 2, 0, 0, ()), (1, 2, 0, 0, ()), (2, 3, 0, 0, ())]
    field, scores = pii.Field(np.zeros((4, 8)), r.normal(0, 1, (5, 4))), r.normal(0, 1, (4, 4))
    paths = []

    def walk(t, last, score, own):
        if t == 3:
            paths.append((score, own))
            return
        walk(t + 1, last, score, own)
        for c, (i, j, *_) in enumerate(found):
            if i == t:
                for y in range(4):
                    walk(j, y, score + field.links[last, y] + scores[c, y], [*own, (c, y)])

    walk(0, 4, 0.0, [])
    chance, _, total = field.chances(3, found, scores)
    assert math.isclose(total, math.log(sum(math.exp(s) for s, _ in paths)))
    want = np.zeros((4, 4))
    for s, own in paths:
        for c, y in own:
            want[c, y] += math.exp(s - total)
    assert np.allclose(chance, want) and field.best(3, found, scores) == max(paths)[1]


def test_language_model_of_documents(docs, empty):
    labelled = [(f"the cat and the dog {k}", "en") for k in range(40)] + [(f"le chat et le chien {k}", "fr") for k in range(40)]
    model = langid.train(labelled)
    p = model.probabilities([b"the dog", b"le chien"])
    assert [model.labels[k] for k in p.argmax(axis=1)] == ["en", "fr"] and np.allclose(p.sum(axis=1), 1)
    got = {r["doc_id"]: r for r in langid.predicted(docs, model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == "und" and got[0]["rejected"] and got[5]["lang_pred"] in ("en", "fr") and 0 <= got[5]["score"] <= 1
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predicted(docs, none).collect()} == {"und"} and rows(langid.predicted(empty, model)) == []
    long = "the cat " * 100_000
    assert np.allclose(model.probabilities([long.encode()]), model.probabilities([("the cat " * 100).encode()]), atol=0.02)


def test_predictions_keep_columns_of_any_name(spark):
    model = langid.train([(f"the cat and dog {k}", "en") for k in range(20)] + [(f"le chat et chien {k}", "fr") for k in range(20)])
    df = spark.createDataFrame([(1, "the dog", "mine", "too")], "doc_id long, text string, __text string, text______ string")
    (row,) = langid.predicted(df, model).collect()
    assert (row["__text"], row["text______"], row["lang_pred"]) == ("mine", "too", "en")


def test_exact_duplicates_with_maps(spark):
    df = spark.createDataFrame([(1, "a", {"x": "1"}), (1, "a", {"x": "0"}), (2, "b", {})], "doc_id long, text string, extra map<string,string>")
    assert sorted((r["doc_id"], r["extra"]) for r in exact_dedup.deduplicate(df).collect()) == [(1, {"x": "0"}), (2, {})]


def test_language_model_reads_whole_texts(spark):
    """What stands in front of long texts is the same in all; the language shows behind it."""
    random_ = random.Random(3)
    front = "0 licence 1 text 2 of 3 all " * 320
    words = {"en": "the cat sat on this mat with those dogs there".split(), "fr": "le chat est assis sur un tapis avec ces chiens".split()}
    say = lambda lang, n: " ".join(random_.choice(words[lang]) for _ in range(n))
    assert len(front) > 8000
    rows_ = [(k, front + say(lang, 9000), lang) for k in range(60) for lang in [("en", "fr")[k % 2]]]
    model = langid.fit(spark.createDataFrame(rows_, "doc_id long, text string, lang string"))
    tests = [(lang, say(lang, 20)) for lang in ("en", "fr") * 20]
    p = model.probabilities([langid.normal(t) for _, t in tests])
    assert [model.labels[k] for k in p.argmax(axis=1)] == [lang for lang, _ in tests]
    assert all(p.max(axis=1) > model.threshold)


def test_lm_scores(docs, empty):
    got = lm.scored(docs, known_words=50).collect()
    train = [t or "" for d, t, *_ in ROWS if zlib.crc32(("null" if d is None else str(d)).encode()) % 7 != 2]
    tokens = lambda t: [*WORD.findall(low(t)), "\n"]
    c = Counter(w for t in train for w in tokens(t))
    n, texts = sum(c.values()), {d: t or "" for d, t, *_ in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        own = tokens(texts[r["doc_id"]])
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in own), rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in c for w in own), n) and r["score"] < 0 and r["bits_per_byte"] > 0
    assert rows(lm.scored(empty)) == []


def test_lm_bits_are_probabilities():
    """Over all continuations of a prefix the code's bits form a distribution, and units see what plain text shows."""
    code = lm.Code(np.bincount(np.frombuffer(b"banana bandana\n" * 9, np.uint8), minlength=256))
    assert math.isclose(sum(0.5 ** int(n) for n in code.length), 1.0)
    texts = [b"Banana  bandana\tbanana", b"", b"banana"]
    ((at, u),) = list(lm.units(texts))
    words = [bytes(u.data[s : s + n]) for s, n in zip(u.start, u.length, strict=True)]
    assert at == [0, 1, 2] and [[words[k] for k, o in zip(u.unit, u.owner, strict=True) if o == d] for d in range(3)] == [[b"banana ", b"bandana ", b"banana\n"], [], [b"banana\n"]] and u.empty.tolist() == [1] and words[-1] == b"\n"


def test_lm_counts_of_every_context_are_its_own(spark):
    """Tables hold as many contexts as the texts have, each with exact counts."""
    texts = [" ".join(f"{a}{b}{k}" for b in "xyz") for a in ("ab", "abc", "q") for k in range(300)]
    data = np.frombuffer("\n".join(texts).encode() + b"\n", np.uint8)
    code = lm.Code(np.bincount(data, minlength=256))
    rows_ = spark.createDataFrame([(bytearray(t, "utf8"), k % 5 == 4) for k, t in enumerate(texts)], "text binary, held_out boolean")
    units = lm.all_units(rows_)
    last, far, start = lm.short_tables(units, code)
    words = Counter(w for k, t in enumerate(texts) if k % 5 != 4 for w in [x + " " for x in t.split()[:-1]] + [t.split()[-1] + "\n"])
    counts = defaultdict(lambda: [0, 0])
    path = {b: (lambda x: list(zip(x[1].tolist(), x[2].tolist(), strict=True)))(code.bits(np.array([b], np.uint8))) for b in set(data.tolist())}
    for w, c in words.items():
        for k, b in enumerate(w.encode()):
            for node, bit in path[b]:
                counts[w[:k], node][bit] += c
    spelled = {r["word"]: bytes(r["spelled"]).decode() for r in units.collect()}
    got = {spelled[r["word"]]: np.frombuffer(r["cells"], np.uint16) for r in lm.word_cells(units, code, start).collect()}
    assert len(got) == 2700
    for w, cells in got.items():
        zero, one = np.array([counts[w[:k], node] for k, b in enumerate(w.encode()) for node, _ in path[b]], float).T
        assert (cells[: len(zero)] == lm.to_cells(zero, one)).all()


def test_lm_sees_the_whole_word_before(spark):
    """What follows depends on each single word before: far more of these than classes of words."""
    follows = {f"w{zlib.crc32(str(k).encode())}": ("alpha", "omega")[zlib.crc32(b"%d" % (k * 7)) >> 5 & 1] for k in range(400)}
    other = {"alpha": "omega", "omega": "alpha"}
    text = lambda swap: " ".join(f"{w} {other[x] if swap else x} end" for w, x in follows.items())
    docs = spark.createDataFrame([*((k, text(False)) for k in range(12)), (100, text(False)), (101, text(True))], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in lm.scored(docs, training=F.col("doc_id") < 100).collect()}
    assert score[100] - score[101] > 400 * math.log10(4)  # two bits a pair at least
    # The first byte of a word is predicted from the bytes of the word before.
    ((_, u),) = list(lm.units([b"ab c"]))
    seen = {bytes(u.data[s : s + n]): t for s, n, t in zip(u.start, u.length, u.tail, strict=True)}
    assert lm.three(np.frombuffer(b"c\n", np.uint8), np.array([2]), np.array([seen[b"c\n"]])).tolist() == [int.from_bytes(b"ab ", "big"), int.from_bytes(b"b c", "big")]


def test_lm_mix_learns_from_all_training_documents(spark, monkeypatch):
    texts = [f"doc {k} has word{k % 17} and word{k * 7 % 13}" for k in range(400)]
    seen, averaged = [], lm.averaged

    def noted(parts):
        parts = list(parts)
        seen.extend(p[1].sum() for p in parts)
        return averaged(parts)

    monkeypatch.setattr(lm, "averaged", noted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lm.scored(docs, training=F.lit(True)).collect()
    data = np.frombuffer("".join(t + "\n" for t in texts).encode(), np.uint8)
    assert sum(seen) == lm.Code(np.bincount(data, minlength=256)).length[data].sum()
    # A unit is predicted from counts without its own occurrence.
    zero, one, bit = np.array([0.0, 3]), np.array([1.0, 0]), np.array([1, 0])
    assert (lm.without_one(zero, one, bit) == lm.to_cells(np.array([0.0, 2]), np.array([0.0, 0]))).all()


def test_lm_cuts_hide_no_word_before(monkeypatch):
    text = " ".join(f"word{k}" for k in range(200)).encode()
    whole = [set(u.key[:-1].tolist()) for _, u in lm.units([text, b"", b"b a"])]
    monkeypatch.setattr(lm, "BLOCK_BYTES", 50)
    parts = [set(u.key[:-1].tolist()) for _, u in lm.units([text, b"", b"b a"])]
    assert len(whole) == 1 and len(parts) > 10 and set.union(*parts) == whole[0]


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "", None, "<|turn|>x<|text|>", f"a{chat.MARK}.b{chat.MARK}", " [/INST]", "<s", "[", "plain é", "<<s>s>"]
    turns = [(c, k, role, t, "extra") for c, role in enumerate(("user", "assistant", "system", None, "<|end|>", ""), 1) for k, t in enumerate(hard)] + [(1, 3, "assistant", "tie", "x"), (None, 0, "user", "no id", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.summaries(chat.formatted(df)).collect()}
    by = defaultdict(list)
    for c, k, role, t, _ in turns:
        by[c].append((k, role or "", t or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    with pytest.raises(ValueError):
        chat.parse("<s>[INST] a </s>")
    assert rows(chat.summaries(chat.formatted(df.limit(0)))) == []


def test_segments_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_CHARS", 50)
    df = spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], f"turn {k} </s>") for k in range(40)], "conv_id long, turn long, role string, text string")
    assert chat.formatted(df).count() > 1 and chat.summaries(chat.formatted(df)).first()["n_turns"] == 40
    assert chat.summaries(chat.read_back(chat.formatted(df).repartition(5))).first() == chat.summaries(chat.formatted(df)).first()


def test_words_and_cuts():
    w = Words([b"Aa b\x0bc", b"", b"aa"])
    assert [w.word(k) for k in range(len(w))] == [b"aa", b"b", b"c", b"aa"] and w.first.tolist() == [0, 3, 3, 4] and w.hashes[0] == w.hashes[3]
    text = b"ab " * 1000 + b"z" * 500 + b" q"
    assert b"".join(cut(text, 100)) == text and all(len(p) <= 700 for p in cut(text, 100))


def test_components_by_stars_and_in_one_task(spark):
    """Both ways equal plain union-find: random links, a chain, a star, repeated links, no links."""
    from tidemark.llm.components import components, union_find

    rng = random.Random(11)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2050)]
    for pairs in (links + links[:20], []):
        expected = {(u, v) for u, v in union_find(p for p in pairs if p[0] != p[1]).items() if u != v}
        edges = spark.createDataFrame(pairs, "u long, v long").repartition(5)
        for task_edges in (-1, 1 << 18):
            assert sorted(map(tuple, components(edges, task_edges).collect())) == sorted(expected)


def test_lm_parts_give_each_document_the_units_of_its_text(spark):
    """Dealt in blobs by the word before, counts are those of the texts; what is stored takes less room than the texts' units as rows."""
    texts = [" ".join(f"{a}{k * j % 7} {b}{k % 5}\t" for j, (a, b) in enumerate((("ab", "x"), ("abcd", "abcde"), ("q", "é")))) for k in range(60)] + ["", "  ", "ab0"]
    held = [k % 6 == 5 for k in range(len(texts))]
    rows_ = spark.createDataFrame([(k, bytearray(t, "utf8"), h) for k, (t, h) in enumerate(zip(texts, held, strict=True))], "row long, text binary, held_out boolean")
    code = lm.Code(np.bincount(np.frombuffer("\n".join(texts).encode(), np.uint8), minlength=256))
    joined = lm.joined_units(lm.dealt_units(rows_, 3), 3)
    last, far, start = lm.to_shorts(lm.counted_keys(joined), code)
    plain = lm.all_units(rows_)
    for a, b in zip((last, far, start), lm.short_tables(plain, code), strict=True):
        assert (a.keys == b.keys).all() and (a.zero == b.zero).all() and (a.one == b.one).all()
    words = lm.word_counts(joined, code, 3)
    blobs = defaultdict(list)
    for r in words.collect():
        blobs[r["part"]].append(bytes(r["data"]))
    split = [lm.stream(t.encode())[:-1].decode().split() for t in texts]
    seen = [[(p, w + (" " if k < len(s) - 1 else "\n")) for k, (p, w) in enumerate(zip(["", *s], s))] or [("", "\n")] for s in split]  # noqa: B905
    counts = defaultdict(lambda: [0, 0])
    path = lambda byte: list(zip(*(x.tolist() for x in code.bits(np.array([byte], np.uint8))[1:]), strict=True))
    for units, h in zip(seen, held, strict=True):
        for p, w in units:
            for k, byte in enumerate(w.encode()):
                for node, bit in path(byte):
                    counts[w.encode()[:k], node][bit] += not h
                    counts[p, w.encode()[:k], node][bit] += not h
    got, mine = Counter(), Counter((k, w) for k, units in enumerate(seen) for _, w in units)
    for part, data in joined.where("kind = 0").select("part", "data").collect():
        for learning in (True, False):
            pw = lm.PartWords(blobs[part], code, start, far, learning)
            u = lm.Chunk(bytes(data), pw, code, last, far, learning)
            g, at = u.got, np.cumsum(u.bits) - u.bits
            docs, row, post = np.repeat(np.arange(len(u.c)), g["n_docs"]), np.cumsum(g["rows"].astype(np.int64)), defaultdict(set)
            for j, d, t in zip(docs, g["docs"], g["times"], strict=True):
                post[int(j)].add((int(row[d]), int(t)))
            for j, wi in enumerate(g["wi"].astype(int)):
                w = bytes(pw.data[pw.start[wi] : pw.start[wi] + pw.length[wi]])
                if not learning:
                    for d, t in post[j]:
                        got[d, w.decode()] += t
                d = next(iter(post[j]))[0]
                befores = {p for p, x in seen[d] if x.encode() == w and (p, x) in set(seen[d])}
                want = [(k, node, bit) for k, byte in enumerate(w) for node, bit in path(byte)]
                bit = np.array([b for *_, b in want])
                to = lm.without_one if learning else lambda z, o, _: lm.to_cells(z, o)
                if learning and not u.c[j]:
                    continue
                own = slice(at[j], at[j] + u.bits[j])
                zero, one = np.array([counts[w[:k], node] for k, node, _ in want], float).T
                assert (u.cells[2][own] == to(zero, one, bit)).all()
                pairs = [np.array([counts[p, w[:k], node] for k, node, _ in want], float).T for p in befores]
                assert any((u.cells[3][own] == to(*x, bit)).all() for x in pairs)
    assert got == mine


def test_lm_deals_what_stands_behind_a_frequent_word(spark):
    """Units behind a frequent word go to all parts, with the counts that they have in one; of a text's start as well."""
    r = random.Random(4)
    texts = [" ".join(f"{r.choice(['the', 'the', 'of', 'x'])} {r.choice(['a', 'ab', 'abc', 'q'])}{r.choice(['', 'd', r.randrange(3000)])}" for _ in range(r.randrange(40))) for _ in range(300)]
    docs = spark.createDataFrame([(k, bytearray(t, "utf8"), k % 6 == 5) for k, t in enumerate(texts)], "row long, text binary, held_out boolean")
    code = lm.Code(np.bincount(np.frombuffer("\n".join(texts).encode(), np.uint8), minlength=256))
    training = [t for k, t in enumerate(texts) if k % 6 != 5]
    c = Counter(h for t in training for h in Words([t.encode()]).hashes.view(np.int64).tolist())
    total = sum(c.values()) + len(training)
    words = spark.createDataFrame(list(c.items()), "h long, c long")
    hot = lm.frequent_before(words, total, len(training), 12)
    assert {*Words([b"the of"]).hashes.tolist()} < {*hot.tolist()} and (hot[1:] > hot[:-1]).all() and len(hot) < 24

    def cells(hot):
        joined = lm.joined_units(lm.dealt_units(docs, 12, hot), 12, hot)
        last, far, start = lm.to_shorts(lm.counted_keys(joined), code)
        blobs, early, found, sizes = defaultdict(list), lm.part_folders(lm.early_counts(joined, 12)), Counter(), Counter()
        for r in lm.word_counts(joined, code, 12).collect():
            blobs[r["part"]].append(bytes(r["data"]))
        for part, data in joined.where("kind = 0").select("part", "data").collect():
            for learning in (True, False):
                pw = lm.PartWords(blobs[part], code, start, far, learning)
                u = lm.Chunk(bytes(data), pw, code, last, far, learning, lm.part_early(early.get(part)))
                ends, posts, row = np.cumsum(u.bits), np.cumsum(u.got["n_docs"].astype(int)), np.cumsum(u.got["rows"].astype(int))
                for k in range(len(u.c)):
                    own, post = slice(ends[k] - u.bits[k], ends[k]), slice(posts[k] - u.got["n_docs"][k], posts[k])
                    in_docs = tuple(sorted(zip(row[u.got["docs"][post]].tolist(), u.got["times"][post].tolist(), strict=True)))
                    w = bytes(pw.data[pw.start[u.wi[k]] : pw.start[u.wi[k]] + pw.length[u.wi[k]]])
                    if u.c[k] or not learning:
                        found[learning, w, int(u.c[k]), in_docs, *(x[own].tobytes() for x in u.cells)] += 1
                sizes[part] += len(u.c)
        return found, sizes

    (plain, before), (dealt, after) = cells(lm.NO_HASHES), cells(hot)
    assert plain == dealt and sum(before.values()) == sum(after.values())
    assert max(before.values()) > 2 * max(after.values()) > 0


def test_lm_stores_units_in_little_room(spark):
    """What is dealt by the word before takes less room than the texts; a row for each unit took several times theirs."""
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(400)) for _ in range(300)]
    docs = spark.createDataFrame([(k, bytearray(t, "utf8"), False) for k, t in enumerate(texts)], "row long, text binary, held_out boolean")
    joined = lm.joined_units(lm.dealt_units(docs, 4), 4)
    assert sum(len(x["data"]) for x in joined.collect()) < 2 * sum(map(len, texts))


def test_lm_spreads_out_the_bits_of_a_piece_at_a_time(spark):
    """Behind a frequent word stand many; a task keeps a few numbers for each of their bytes, and has the bits of some units alone."""
    import tracemalloc

    text = " ".join(f"the w{k * 7919 % 100_003}x{k}" for k in range(40_000))
    docs = spark.createDataFrame([(0, bytearray(text, "utf8"), False)], "row long, text binary, held_out boolean")
    code = lm.Code(np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256))
    joined = lm.joined_units(lm.dealt_units(docs, 1), 1)
    last, far, start = lm.to_shorts(lm.counted_keys(joined), code)
    pw = lm.PartWords([bytes(r["data"]) for r in lm.word_counts(joined, code, 1).collect()], code, start, far, True)
    chunks = [bytes(r["data"]) for r in joined.where("kind = 0").collect()]
    tracemalloc.start()
    try:
        n, peak = 0, 0
        for data in chunks:
            tracemalloc.reset_peak()
            u = lm.Chunk(data, pw, code, last, far, True)
            at, whole = np.cumsum(u.bits) - u.bits, None
            for own in u.pieces(np.arange(len(u.c))[::-1]):
                cells, bit = u.part(own)
                lm.to_inputs(cells)
                n += len(bit)
            peak = max(peak, tracemalloc.get_traced_memory()[1])
            whole, bits, order = u.cells, u.part(np.arange(len(u.c)))[1], lm.spread(at[own], u.bits[own])
            assert all((a == b[order]).all() for a, b in zip([*cells, bit], [*whole, bits], strict=True))
    finally:
        tracemalloc.stop()
    assert n > 2_000_000
    assert peak < 60 * n
