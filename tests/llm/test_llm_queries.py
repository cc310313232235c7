"""The registered queries themselves, on a whole small folder, against plain forms."""

import hashlib
import re
import tarfile
import zlib

import numpy as np
import pytest

from tidemark.llm import media, packing, pii

FOLDER = "/root/testdata/sf0.001"


def plain_spans(text):
    """The contract's patterns by re alone: leftmost, non-overlapping for each kind, failing matches dropped."""
    from tidemark.llm.pii import luhn

    out = []
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), list(patterns).index(kind), m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_op1_base_spans_of_every_row(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = pii.op1_pii(spark, FOLDER).collect()
    assert len(got) == len(texts)
    found = 0
    for r in got:
        base = plain_spans(texts[r.doc_id])
        found += len(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for *_, k in base) for kind in pii.KINDS]
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert len(spans) == len(base) + r.n_added and set(text.split(",") if text else []) <= set(spans)
    assert found > 20


@pytest.mark.parametrize("text", ["x" * 90 + "/743-555-3824", "https://example.org/" + "a" * 70 + "/743-555-3824 now", "tel 743-555-3824/" + "y" * 80, "https://example.org/a/743-555-3824?x", "x" * 100 + "-743-555-3824"])
def test_numbers_inside_long_tokens(text):
    field = pii.trained()
    assert [(k, text[a:b]) for a, b, k in field.spans(text, pii.base_spans(text))] == [("phone", "743-555-3824")]
    for quiet in ("x" * 300, "1" * 500, "on 05/06/2024 at 3/4", "/" * 200):
        assert field.spans(quiet, pii.base_spans(quiet)) == []


def histogram(folder):
    import pyarrow.parquet as pq

    from tidemark.llm.tokens import encoder, tokenizer_path

    out, texts = {}, [(t or "").encode() for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist()]
    for ids in encoder(tokenizer_path()).encode_all(texts):
        n = len(ids) + 1
        while n > 0:
            out[min(n, 4096)] = out.get(min(n, 4096), 0) + 1
            n -= 4096
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_packing_program_is_near_its_dual_bound(folder):
    """In fractions, within 1 % of the bound; rounded, as few sequences as the tokens need at least, all of them the program's."""
    h = histogram(folder)
    lengths, counts = (np.array(x) for x in zip(*sorted(h.items()), strict=True))
    used, bound = packing.solve(lengths, counts, 4096, packing.KNAPSACKS[0])
    value = sum(used.values())
    assert value <= 1.01 * bound and bound <= value + 1e-6 and bound >= (lengths * counts).sum() / 4096 - 1e-6
    held = np.zeros(len(lengths))
    for found, x in used.items():
        assert sum(int(lengths[k]) * t for k, t in found) <= 4096 and x > 0
        for k, t in found:
            held[k] += x * t
    assert np.allclose(held, counts, atol=1e-6)
    assert sum(abs(x - round(x)) > 1e-6 for x in used.values()) > len(used) / 2
    steps = packing.steps_of_plan(h)
    assert sum(uses for uses, *_ in steps) == -(-int((lengths * counts).sum()) // 4096) and all(own for *_, own in steps)


@pytest.mark.parametrize("h", [{7: 1}, {4096: 3}, {3000: 5}, {2049: 4, 2047: 3, 1: 9}, {1: 5000}, {1500: 2, 2600: 2, 100: 1, 4000: 1}])
def test_small_tables_go_through_the_program(h):
    steps = packing.steps_of_plan(h)
    held = {}
    for uses, found, own in steps:
        assert own and sum(x * t for x, t in found.items()) <= 4096
        for x, t in found.items():
            held[x] = held.get(x, 0) + uses * t
    assert held == h
    lengths, counts = (np.array(x) for x in zip(*sorted(h.items()), strict=True))
    _, bound = packing.solve(lengths, counts, 4096, 4)
    assert sum(uses for uses, *_ in steps) <= bound + 1.01


def plain_png(data):
    """Width, height and samples of an 8-bit gray PNG without filters, by the format's description."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, raw, size = 8, b"", None
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert int.from_bytes(data[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + body)
        if kind == b"IHDR":
            size = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        elif kind == b"IDAT":
            raw += body
        at += 12 + n
    width, height = size
    rows = zlib.decompress(raw)
    assert len(rows) == height * (width + 1) and not any(rows[k * (width + 1)] for k in range(height))
    return width, height, b"".join(rows[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def test_op5_from_its_shards(spark):
    """Each content once in a shard, found by tarfile; the query's columns from what tarfile and zlib give back."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    index = media.write_media(docs).collect()
    shards = {}
    for uri in {r.file for r in index}:
        with tarfile.open(uri.removeprefix("file:").replace("///", "/")) as tar:
            shards[uri] = {m.offset_data: (m.name, tar.extractfile(m).read()) for m in tar.getmembers()}
            assert len({name for name, _ in shards[uri].values()}) == len(shards[uri])
    stored = {}
    for r in index:
        name, data = shards[r.file][r.offset]
        assert name == f"{bytes(r.digest).hex()}.png" and len(data) == r.length
        stored[bytes(r.digest)] = data
    got = {r.doc_id: r for r in media.op5_media_columns(spark, FOLDER).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        padded = text + b"\xff" * (max(576, (len(text) + 575) // 576 * 576) - len(text))
        r, digest = got[doc], hashlib.sha256(padded).digest()
        width, height, samples = plain_png(stored[digest])
        assert samples == padded and (width, height) == (576, len(padded) // 576) == (r.width, r.height)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(padded), digest.hex(), zlib.crc32(padded[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[digest]), hashlib.sha256(stored[digest]).hexdigest())
        bits, mean, deviation = r.feature.split(":")
        whole = sum(padded) / len(padded)
        want = "".join("1" if sum(padded[a:b]) * len(padded) > sum(padded) * (b - a) else "0" for a, b in ((k * len(padded) // 64, (k + 1) * len(padded) // 64) for k in range(64)))
        assert int(bits, 16) == int(want, 2) and abs(float(mean) - whole) < 1e-4
        assert abs(float(deviation) - (sum((x - whole) ** 2 for x in padded) / len(padded)) ** 0.5) < 1e-3


@pytest.mark.parametrize("name", ["op3_pack_sequences", "op4_near_dedup", "op7_language_id", "op8_token_files", "op9_exact_dedup", "op10_chat_format"])
def test_queries_cover_their_tables(spark, name):
    from tidemark.llm import queries

    got = queries.QUERIES[name](spark, FOLDER)
    if name == "op10_chat_format":
        conversations = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count()
        assert got.count() == conversations + 1 and got.where("conv_id = -7 and n_turns = 2").count() == 1
        return
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    rows = got.collect()
    assert {r.doc_id for r in rows} == ids and (name == "op3_pack_sequences" or len(rows) == len(ids))
    if name == "op3_pack_sequences":
        used = {}
        for r in rows:
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in used.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 4096
        assert len(used) == -(-sum(r.length for r in rows) // 4096)
    if name == "op4_near_dedup":
        assert all(r.kept == (r.doc_id == r.component_id) and r.component_id <= r.doc_id for r in rows)


def test_pipeline_run(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
