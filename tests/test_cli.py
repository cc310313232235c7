"""The six steps of the command line, one after another, on files made here."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.sources import bam, tables

SIZE = 90_000


def reads(spark, seed, n):
    r = random.Random(seed)
    rows = [(f"q{k // 2}", 64 if k % 2 == 0 else 128, "chr1", r.randrange(SIZE - 100), 60, "100M", None, None, 0, "*", "*", "") for k in range(n)]
    df = spark.createDataFrame(rows, ", ".join(bam.SCHEMA.split(", ")[:-1]))
    return df.repartitionByRange(2, "pos").sortWithinPartitions("pos")


def test_all_steps(spark, tmp_path, capsys):
    p = lambda name: str(tmp_path / name)
    r = random.Random(9)
    (tmp_path / "sizes").write_text(f"chr1\t{SIZE}\n")
    (tmp_path / "targets.bed").write_text("".join(f"chr1\t{s}\t{s + 300}\n" for s in range(2000, SIZE - 1000, 9000)))
    (tmp_path / "access.bed").write_text(f"chr1\t0\t{SIZE}\n")
    (tmp_path / "centromeres.bed").write_text("chr1\t40000\t41000\n")
    (tmp_path / "a.fa").write_text(">chr1\n" + "\n".join("".join(r.choice("ACGT") for _ in range(60)) for _ in range(SIZE // 60)) + "\n")
    for folder in ("normals", "tumours", "out_a", "out_b", "big"):
        (tmp_path / folder).mkdir()
    header = f"@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:{SIZE}\n"
    for k in range(3):
        bam.write_bam(reads(spark, k, 4000), p(f"normals/n{k}.bam"), header)
    bam.write_bam(reads(spark, 7, 3000), p("tumours/t1.bam"), header)
    run = lambda *args: cli.main([str(a) for a in args])
    run("windows", "--targets", p("targets.bed"), "--access", p("access.bed"), "--centromeres", p("centromeres.bed"), "--chr_sizes", p("sizes"), "--output_bed", p("windows.bed"))
    windows = tables.read_bed(spark, p("windows.bed")).collect()
    assert windows and all(2500 <= w["end"] - w["start"] <= 5000 and w["name"] == f"chr1:{w['start']}-{w['end']}" for w in windows)
    run("matrix", "--windows_bed", p("windows.bed"), "--reference", p("a.fa"), "--wgs_bams_dir", p("normals"), "--matrix", p("matrix.tsv"))
    matrix = tables.read_matrix(spark, p("matrix.tsv"))
    assert matrix.count() == 3 * len(windows) and matrix.where("depth is null or gc_pct not between 0.3 and 0.7").count() == 0
    run("panel", "--wgs_matrix", p("matrix.tsv"), "--output", p("panel.tsv"), "-k", 1)
    panel = tables.read_panel(spark, p("panel.tsv"))
    assert panel.count() == len(windows) and panel.where("pon_median > 0 and pon_variance >= 0").count() == len(windows)
    run("track-b", "--offtarget_windows", p("windows.bed"), "--pon_tsv", p("panel.tsv"), "--wes_dir", p("tumours"), "--output_dir", p("out_b"))
    run("track-a", "--targets", p("targets.bed"), "--offtarget_windows", p("windows.bed"), "--reference", p("a.fa"), "--pon_tsv", p("panel.tsv"), "--wes_dir", p("tumours"), "--output_dir", p("out_a"))
    for folder in ("out_a", "out_b"):
        track = tables.read_track(spark, p(f"{folder}/t1{tables.TRACK_SUFFIX}"))
        assert track.count() == len(windows) and track.where("depth_scaled_ratio > 0").count() == len(windows)
    run("upscale", "--tracks_dir", p("out_b"), "--bam_dir", p("tumours"), "--output_dir", p("big"))
    big = bam.read_bam(spark, [p("big/t1.additive_scaled.bam")])
    said = capsys.readouterr().err
    assert f"t1: kept 3000 reads, added {big.count() - 3000}\n" in said
    bases = sum(w["end"] - w["start"] for w in windows)
    for line in (f"windows: windows: {len(windows)} rows, {bases} bases", f"windows: tiles: {SIZE // 5000} rows, {SIZE} bases", "windows: targets with flanks: 10 rows, 7000 bases", f"matrix: cells: {3 * len(windows)} rows, 0 skipped, 0 without_depth", f"panel: windows: {len(windows)} rows, ", f"track-a: rows of all samples: {len(windows)} rows, ", f"track-b: rows of all samples: {len(windows)} rows, "):
        assert line in said, (line, said)
    assert big.where(~F.col("qname").contains(":upscale_")).count() == 3000 and (tmp_path / "big/t1.additive_scaled.bam.bai").exists()
    (tmp_path / "normals/n9.cram").write_bytes(b"CRAM")
    with pytest.raises(ValueError, match="CRAM"):
        run("matrix", "--windows_bed", p("windows.bed"), "--reference", p("a.fa"), "--wgs_bams_dir", p("normals"), "--matrix", p("m2.tsv"))
