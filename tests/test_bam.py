"""Split reading, pruning, pushed conditions, and the index and file that tasks write together."""

import io
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import upscale
from tidemark.sources import bam

HEADER = "@HD\tVN:1.6\n@SQ\tSN:c\tLN:9000000\n@SQ\tSN:d\tLN:500000\n"
PLAIN = ", ".join(bam.SCHEMA.split(", ")[:-1])


def records(seed, n, longest=200):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        size = r.choice((0, 1, 7, 50, longest))
        seq = "".join(r.choice("ACGTN") for _ in range(size)) or "*"
        qual = "*" if size == 0 or r.random() < 0.3 else "".join(chr(33 + r.randrange(60)) for _ in range(size))
        chrom = r.choice(("c", "c", "c", "d", None))
        tags = r.choice(("", "NM:i:3", f"RG:Z:a b\tXB:B:s,1,-2,{k}\tXA:A:q\tXF:f:0.5"))
        rows.append((f"name{k}" + "x" * r.randrange(30), r.choice((0, 64, 128, 4, 1024)), chrom, r.randrange(400_000) if chrom else None, r.randrange(61), r.choice(("*", f"{size + 1}M", "3S20M1000N7M", "10M2I3D")), r.choice((None, "d")), r.choice((None, 77)), r.randrange(-9, 9), seq, qual, tags))
    return sorted(rows, key=lambda x: (x[2] is None, x[2] or "", x[3] or 0))


def written(spark, path, rows, parts=3, **options):
    df = spark.createDataFrame(rows, PLAIN)
    order = [F.col("chrom").asc_nulls_last(), F.col("pos")]
    bam.write_bam(df.repartitionByRange(parts, *order).sortWithinPartitions(*order), path, HEADER, **options)


def whole(path, start=0, end=1 << 60):
    """The record bodies and virtual offsets of a range."""
    out = []
    for _, data, begins, offsets in bam.split_records(path, start, end):
        out += [(int(o), data[b + 4 : b + 4 + struct.unpack_from("<i", data, b)[0]]) for b, o in zip(begins.tolist(), offsets, strict=True)]
    return out


def in_order(path):
    """The same by the reader of one block after another."""
    with open(path, "rb") as raw:
        stream = bam._Virtual(raw)
        bam.read_header(stream)
        out = []
        while True:
            at = stream.tell()
            head = stream.read(4)
            if not head:
                return out
            out.append((at, stream.read(struct.unpack("<i", head)[0])))


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "a.bam")
    rows = records(1, 5000)
    written(spark, path, rows, 4)
    return path, rows


def test_splits_cover_every_record_once(big):
    path, rows = big
    want = in_order(path)
    size = len(open(path, "rb").read())
    assert len(want) == len(rows) and whole(path) == want
    for step in (size // 4 + 1, 50_000, 7_001):
        got = [x for a in range(0, size, step) for x in whole(path, a, min(a + step, size))]
        assert got == want, step


def test_records_over_blocks_and_long_ones(tmp_path, monkeypatch):
    """Small blocks, of which a record takes many; other fields before a block's size; empty blocks between; bytes that look like a block."""
    rows = [dict(zip(bam.COLUMNS[:-1], r, strict=True)) for r in records(2, 150, 30_000)]
    rows[20]["tags"] = "XZ:Z:" + "y" * 300_000
    decoy = (bam.EOF[:16] + b"\x30\x00" + b"zzzz" * 5) * 40  # stored as it is, it looks like headers of blocks
    for k in range(0, 150, 7):
        rows[k] |= {"seq": "A" * len(decoy), "qual": "".join(chr(b + 33) for b in decoy)}
    head, _ = bam.encode_header(HEADER)
    body = b"".join(bam.encode_record(r, {"c": 0, "d": 1}) for r in rows)

    def block(data, stored=False):
        z = zlib.compressobj(0 if stored else 6, zlib.DEFLATED, -15)
        raw = z.compress(data) + z.flush()
        extra = struct.pack("<2sHH", b"ZZ", 2, 5) + struct.pack("<2sHH", b"BC", 2, len(raw) + 31)
        return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + raw + struct.pack("<II", zlib.crc32(data), len(data))

    out, r = [bam.compressed(head)], random.Random(1)
    at = 0
    while at < len(body):
        n = r.choice((1, 300, 5_000, 40_000))
        out.append(block(body[at : at + n], stored=r.random() < 0.3))
        at += n
        if r.random() < 0.1:
            out.append(bam.EOF)
    assert b"".join(out).count(decoy[:18]) > 100
    path = tmp_path / "x.bam"
    path.write_bytes(b"".join(out) + bam.EOF)
    bodies = []
    at = 0
    while at < len(body):
        n = struct.unpack_from("<i", body, at)[0]
        bodies.append(body[at + 4 : at + 4 + n])
        at += 4 + n
    size = path.stat().st_size
    for chunk in (1 << 22, 1000):
        monkeypatch.setattr(bam, "CHUNK", chunk)
        assert [b for _, b in whole(str(path))] == bodies
        for step in (size // 3 + 1, 9_999):
            got = [x for a in range(0, size, step) for x in whole(str(path), a, min(a + step, size))]
            assert [b for _, b in got] == bodies and [o for o, _ in got] == sorted({o for o, _ in got}), (chunk, step)
    path.write_bytes(b"".join(out)[:-50])
    with pytest.raises(ValueError):
        whole(str(path))


def test_split_table_equals_rows(spark, big):
    path, rows = big
    df = bam.read_bam(spark, [path], split=20_000)
    assert df.rdd.getNumPartitions() > 4
    got = df.orderBy("ord").collect()
    assert [tuple(r)[:-1] for r in got] == rows and len({r.ord for r in got}) == len(rows)


def test_pruned_and_pushed(spark, big):
    path, rows = big
    df = bam.read_bam(spark, [path], ["pos", "qname", "file"], split=50_000)
    assert df.columns == ["pos", "qname", "file"] and sorted(map(str, ((r.pos, r.qname) for r in df.collect()))) == sorted(str((r[3], r[0])) for r in rows)
    assert {r.file for r in df.select("file").distinct().collect()} == {path}
    some = bam.read_bam(spark, [path], without=1024 | 4, min_mapq=20, chroms=["c", "x"])
    want = [r for r in rows if not r[1] & 1028 and r[4] >= 20 and r[2] == "c"]
    assert sorted(r.qname for r in some.collect()) == sorted(r[0] for r in want) and want
    # Two conditions on one table don't meet.
    full = bam.read_bam(spark, [path])
    assert full.where("mapq >= 20").unionByName(full.where("mapq < 20 or chrom is null")).count() == sum((r[4] >= 20) + (r[4] < 20 or r[2] is None) for r in rows)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_merged_index_is_that_of_one_pass(spark, tmp_path, parts):
    path = str(tmp_path / "a.bam")
    written(spark, path, records(3, 4000), parts)
    made = open(f"{path}.bai", "rb").read()
    bam.write_index(path)
    assert made == open(f"{path}.bai", "rb").read() and len(made) > 1000
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.bam", "a.bam.bai"]


def test_empty_and_out_of_order(spark, tmp_path):
    path = str(tmp_path / "e.bam")
    written(spark, path, [])
    assert bam.read_bam(spark, [path]).count() == 0
    made = open(f"{path}.bai", "rb").read()
    bam.write_index(path)
    assert made == open(f"{path}.bai", "rb").read()
    df = spark.createDataFrame(records(4, 50), PLAIN)
    with pytest.raises(ValueError, match="order of place"):
        bam.write_bam(df.orderBy(F.col("chrom").desc()).coalesce(1), str(tmp_path / "f.bam"), HEADER)


def test_index_finds_records(spark, tmp_path):
    """Chunks of the bins that a region touches hold all of its records, and the linear index doesn't start behind them."""
    path = str(tmp_path / "a.bam")
    rows = [(f"q{k}", 0, "c", k * 911 % 8_000_000, 9, "100M", None, None, 0, "*", "*", "") for k in range(3000)]
    written(spark, path, sorted(rows, key=lambda r: r[3]), 4)
    raw = io.BytesIO(open(f"{path}.bai", "rb").read()[8:])
    take = lambda f: struct.unpack("<" + f, raw.read(struct.calcsize("<" + f)))
    bins = {}
    for _ in range(take("i")[0]):
        number, n = take("Ii")
        bins[number] = [take("QQ") for _ in range(n)]
    linear = [take("Q")[0] for _ in range(take("i")[0])]
    for offset, body in in_order(path):
        pos, number = struct.unpack_from("<i", body, 4)[0], struct.unpack_from("<H", body, 10)[0]
        assert any(a <= offset < b for a, b in bins[number]) and linear[pos >> 14] <= offset


def test_upscaled_file(spark, tmp_path):
    """Upscaled reads of a split file, written in order by several tasks."""
    path, out = str(tmp_path / "a.bam"), str(tmp_path / "b.bam")
    rows = [(f"q{k // 2}", 64 if k % 2 else 128, "c", k * 100, 60, "50M", None, None, 0, "*", "*", "") for k in range(600)]
    written(spark, path, rows, 2)
    track = spark.createDataFrame([("c", 0, 30_000, 3.0)], "chrom string, start long, end long, own_scale double")
    big = upscale.coordinate_sorted(upscale.upscaled(bam.read_bam(spark, [path], split=3000), track), 3)
    bam.write_bam(big, out, HEADER)
    back = bam.read_bam(spark, [out]).orderBy("ord").collect()
    assert [r.pos for r in back] == sorted(r.pos for r in back) and len(back) == 600 + 2 * 300
    made = open(f"{out}.bai", "rb").read()
    bam.write_index(out)
    assert made == open(f"{out}.bai", "rb").read()
