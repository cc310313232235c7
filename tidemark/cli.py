"""Command line: python -m tidemark.cli STEP --options. Steps read and write the same files as one another.

windows   targets, accessible regions, centromeres and chromosome sizes -> off-target windows
matrix    windows, FASTA and normals' BAM files -> corrected depth matrix
panel     matrix -> panel of normals
track-a   tumour BAM files, targets, windows, FASTA and panel -> copy-ratio tracks anchored on targets
track-b   tumour BAM files, windows and panel -> copy-ratio tracks anchored on the panel
upscale   BAM files and tracks -> larger BAM files and their indexes
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.columns import sample_name
from .functions.counts import Counts
from .functions.reuse import release, reused
from .operators import coverage, matrix, panel
from .params import DEFAULT, Params
from .plans import pipelines
from .sources import bam, tables
from .sources.fasta import read_fasta


def _windows_with_gc(spark: SparkSession, bed: str, fasta: str) -> DataFrame:
    rows = tables.read_bed(spark, bed)
    windows = rows.withColumn("window_id", F.coalesce("name", F.concat("chrom", F.lit(":"), F.col("start"), F.lit("-"), F.col("end")))).drop("name")
    return windows.join(coverage.gc_fraction(windows, read_fasta(spark, fasta), 100_000), "window_id")


def _reads(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("bam",)) -> tuple[DataFrame, list[str]]:
    """What depth needs of all files' records, in one scan, and the samples. A file's sample is known by its name, as alignment_files() has it."""
    files = [tuple(r) for r in tables.alignment_files(spark, folder, kinds).collect()]
    reads = bam.read_bam(spark, [path for path, _ in files], ["qname", "flag", "chrom", "pos", "mapq", "cigar", "file"], without=DEFAULT.flag_mask, min_mapq=DEFAULT.min_mapq)
    return reads.withColumn("sample", sample_name("file")).drop("file"), [sample for _, sample in files]


def windows(spark: SparkSession, a: argparse.Namespace) -> None:
    read = lambda path: tables.read_bed(spark, path)
    params = Params(window_size=a.window_size, flank=a.flank_buffer)
    counts = Counts()
    made = reused(pipelines.define_windows(read(a.access), read(a.targets), read(a.centromeres), tables.read_sizes(spark, a.chr_sizes), params, counts))
    tables.write_bed(made, a.output_bed)
    counts.report("windows")


def build_matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    own = _windows_with_gc(spark, a.windows_bed, a.reference)
    reads, samples = _reads(spark, a.wgs_bams_dir)
    counts = Counts()
    rows = counts.stored(pipelines.normal_matrix(reads, own, samples), "cells", skipped=(F.col("status") != "ok").cast("int"), without_depth=(F.col("depth") == 0).cast("int"))
    tables.write_matrix(rows, a.matrix, samples)
    counts.report("matrix")


def build_panel(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = tables.read_matrix(spark, a.wgs_matrix)
    meta = rows.select(*matrix.META).distinct()
    counts = Counts()
    tables.write_panel(counts.stored(panel.panel(rows, meta, a.k), "windows", high_variance=F.col("is_high_variance")), a.output)
    counts.report("panel")


def _write_tracks(track: DataFrame, folder: str, step: str) -> None:
    counts = Counts()
    flags = {c: F.col(c) for c in track.columns if c.startswith("flag_") or c == "mask_rejected"}
    tables.write_tracks(counts.stored(track, "rows of all samples", **flags), folder)
    counts.report(step)


def track_a(spark: SparkSession, a: argparse.Namespace) -> None:
    reads, samples = _reads(spark, a.wes_dir)
    targets = _windows_with_gc(spark, a.targets, a.reference)
    _write_tracks(pipelines.track_a(reads, targets, tables.read_panel(spark, a.pon_tsv), samples), a.output_dir, "track-a")


def track_b(spark: SparkSession, a: argparse.Namespace) -> None:
    reads, samples = _reads(spark, a.wes_dir)
    _write_tracks(pipelines.track_b(reads, tables.read_panel(spark, a.pon_tsv), samples), a.output_dir, "track-b")


def upscale(spark: SparkSession, a: argparse.Namespace) -> None:
    tracks = tables.listed(spark, f"{a.tracks_dir}/*{tables.TRACK_SUFFIX}")
    samples = spark.createDataFrame([(p.rsplit("/", 1)[-1].removesuffix(tables.TRACK_SUFFIX), p) for p in tracks], "sample string, track string")
    files = spark.createDataFrame([(p,) for p in tables.listed(spark, f"{a.bam_dir}/*.bam")], "path string")
    for sample, track, path in samples.join(tables.resolved_files(samples, files), "sample").select("sample", "track", "path").orderBy("sample").collect():
        if path is None:
            print(f"no BAM file for {sample}: left out", file=sys.stderr)
            continue
        raw, where = bam.open_path(path)
        with raw.open_input_stream(where, compression=None) as file:
            header, _ = bam.read_header(bam.io.BufferedReader(bam.BlockReader(file), 1 << 20))
        out = pipelines.upscale_reads(bam.read_bam(spark, [path]), tables.read_track(spark, track))
        seen = Observation(f"upscaled {sample}")
        bam.write_bam(out.observe(seen, F.count_if(F.col("copy") == 0).alias("kept_reads"), F.count_if(F.col("copy") > 0).alias("duplicated_reads")), f"{a.output_dir}/{sample}.additive_scaled.bam", header)
        print(f"{sample}: kept {seen.get['kept_reads']} reads, added {seen.get['duplicated_reads']}", file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    steps = p.add_subparsers(dest="step", required=True)

    def step(name: str, run, *paths: str) -> argparse.ArgumentParser:
        s = steps.add_parser(name)
        s.set_defaults(run=run)
        for path in paths:
            s.add_argument(f"--{path}", required=True)
        s.add_argument("--temp_dir", help="not needed: nothing is kept between steps")
        s.add_argument("-t", type=int, default=4, help="not needed: Spark's partitions run at once")
        return s

    w = step("windows", windows, "targets", "access", "centromeres", "chr_sizes", "output_bed")
    w.add_argument("--window_size", type=int, default=DEFAULT.window_size)
    w.add_argument("--flank_buffer", type=int, default=DEFAULT.flank)
    step("matrix", build_matrix, "windows_bed", "reference", "wgs_bams_dir", "matrix")
    step("panel", build_panel, "wgs_matrix", "output").add_argument("-k", type=int, default=DEFAULT.components)
    step("track-a", track_a, "targets", "offtarget_windows", "reference", "pon_tsv", "wes_dir", "output_dir")
    step("track-b", track_b, "offtarget_windows", "pon_tsv", "wes_dir", "output_dir")
    step("upscale", upscale, "tracks_dir", "bam_dir", "output_dir")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"tidemark {a.step}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        a.run(spark, a)
    finally:
        release(spark)


if __name__ == "__main__":
    main()
