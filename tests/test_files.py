"""Text files in order made by many tasks, and FASTA files read in ranges."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import tables
from tidemark.sources.fasta import read_fasta


def test_lines_in_order_from_many_parts(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"c{r.randrange(9)}", r.randrange(10_000), r.choice((None, 1.5, float("nan"), 0.1)), r.choice((None, "x"))) for _ in range(5000)]
    df = spark.createDataFrame(rows, "chrom string, start long, v double, name string").repartition(7)
    path = str(tmp_path / "new" / "a.tsv")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that ranges stay apart
    try:
        tables.write_lines(df, path, order=["chrom", "start", "v", "name"])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    text = open(path).read()
    lines = text.split("\n")
    assert lines[0] == "chrom\tstart\tv\tname" and lines[-1] == "" and len(lines) == 5002
    show = lambda v: "" if v is None or v != v else str(v)
    assert sorted(lines[1:-1]) == sorted("\t".join(map(show, x)) for x in rows)
    keys = [(x.split("\t")[0], int(x.split("\t")[1])) for x in lines[1:-1]]
    assert keys == sorted(keys) and [p.name for p in (tmp_path / "new").iterdir()] == ["a.tsv"]
    tables.write_lines(df.where("false"), path)
    assert open(path).read() == "chrom\tstart\tv\tname\n"
    tables.write_lines(df.where("false"), path, header=False)
    assert open(path).read() == ""


def test_all_samples_in_one_job(spark, tmp_path):
    """One large sample and small ones, with a name that a folder couldn't have; each file as if it were written alone."""
    rows = [("big", f"c{k % 3}", k * 7919 % 5000, k) for k in range(3000)] + [("a/b=c %", "c", 5, 1), ("z", "c", 2, 1), ("z", "c", 1, 1)]
    df = spark.createDataFrame(rows, "sample string, chrom string, start long, end long").repartition(5)
    paths = {"big": str(tmp_path / "big.tsv"), "a/b=c %": str(tmp_path / "odd.tsv"), "z": str(tmp_path / "z.tsv")}
    tables.write_by_sample(df, paths, ["chrom", "start", "end"])
    for sample, path in paths.items():
        own = sorted(x[1:] for x in rows if x[0] == sample)
        assert open(path).read() == "chrom\tstart\tend\n" + "".join("\t".join(map(str, x)) + "\n" for x in own)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["big.tsv", "odd.tsv", "z.tsv"]


def plain_fasta(text, chunk):
    out, name, bases = [], None, ""
    for line in [*text.split("\n"), ">"]:
        if line.startswith(">"):
            out += [(name, a, bases[a : a + chunk]) for a in range(0, len(bases), chunk)]
            name, bases = (line[1:].split() or [""])[0], ""
        else:
            bases += line.strip()
    return out


def joined_up(rows, chunk):
    """Pieces joined up to multiples of chunk; each must lie within one."""
    out = []
    for chrom, start, seq in sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1])):
        assert seq and start // chunk == (start + len(seq) - 1) // chunk
        if out and out[-1][0] == chrom and out[-1][1] // chunk == start // chunk and out[-1][1] + len(out[-1][2]) == start:
            out[-1] = (chrom, out[-1][1], out[-1][2] + seq)
        else:
            out.append((chrom, start, seq))
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fasta_in_ranges(spark, tmp_path, end):
    r = random.Random(2)
    letters = lambda n: "".join(r.choice("ACGTNacgt") for _ in range(n))
    lines = ["ACGT", ">c1 first one", *[letters(60) for _ in range(40)], letters(7), "", ">empty", ">c2", letters(3000), ">" + "long" * 60 + " x>y", letters(5), ">c4", *[letters(1) for _ in range(50)]]
    text = end.join(lines) + end
    path = tmp_path / "a.fa"
    path.write_text(text, newline="")
    want = sorted(plain_fasta(text.replace("\r", ""), 500), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    for split in (1 << 20, 2000, 997, 61):
        got = read_fasta(spark, str(path), 500, split)
        assert joined_up(map(tuple, got.collect()), 500) == want, split
    assert got.where(F.length("seq") > 500).count() == 0
    with gzip.open(tmp_path / "a.fa.gz", "wt", newline="") as f:
        f.write(text)
    assert joined_up(map(tuple, read_fasta(spark, str(tmp_path / "a.fa.gz"), 500, 100).collect()), 500) == want
    (tmp_path / "b.fa").write_text(">e")
    (tmp_path / "none.fa").write_text("")
    both = read_fasta(spark, f"{path},{tmp_path}/b.fa,{tmp_path}/none.fa", 500, 700)
    assert joined_up(map(tuple, both.collect()), 500) == want
    assert read_fasta(spark, f"{tmp_path}/none.fa").count() == 0


def test_gc_of_one_sequence_in_ranges(spark, tmp_path):
    from tidemark.operators import coverage

    r = random.Random(3)
    bases = "".join(r.choice("ACGTN") for _ in range(20_000))
    (tmp_path / "s.fa").write_text(">c\n" + "\n".join(bases[k : k + 60] for k in range(0, len(bases), 60)) + "\n")
    places = [(f"w{k}", "c", a, a + n) for k, (a, n) in enumerate([(0, 20_000), (5, 10), (990, 20), (4_999, 7_000), (19_990, 10)])]
    windows = spark.createDataFrame(places, "window_id string, chrom string, start long, end long")
    got = coverage.gc_fraction(windows, read_fasta(spark, str(tmp_path / "s.fa"), 1000, 5200), 1000)
    want = {w: sum(x in "GC" for x in bases[a:b]) / (b - a) for w, _, a, b in places}
    assert {x.window_id: x.gc_pct for x in got.collect()} == want
