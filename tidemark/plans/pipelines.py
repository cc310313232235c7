"""The whole pipelines, as plans from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.counts import Counts
from ..operators import coverage, intervals, matrix, panel, scaling, upscale
from ..params import DEFAULT, Params


def define_windows(access: DataFrame, targets: DataFrame, centromeres: DataFrame, sizes: DataFrame, params: Params = DEFAULT, counts: Counts | None = None) -> DataFrame:
    """Off-target windows: chrom, start, end, name. counts: to watch the stages with."""
    bases = F.col("end") - F.col("start")
    seen = (lambda df, name: counts.watch(df, name, bases=bases)) if counts else (lambda df, name: df)
    mask = seen(intervals.merge(intervals.concatenated(seen(intervals.widen(targets, sizes, params.flank), "targets with flanks"), centromeres)), "merged mask")
    left = seen(intervals.subtract(seen(intervals.tile(access, params.window_size), "tiles"), mask, params.window_size), "pieces outside the mask")
    return intervals.named(seen(intervals.long_enough(left, params.window_size, params.min_fraction), "windows"))


def normal_matrix(reads: DataFrame, windows: DataFrame, samples: list[str] | None = None, params: Params = DEFAULT, drop_skipped: bool = False, **depth_options) -> DataFrame:
    """Normalised, gc-corrected and recentred depths of normals, long. windows: with window_id and gc_pct."""
    depth = coverage.window_depth(reads, windows, samples, min_mapq=params.min_mapq, mask=params.flag_mask, **depth_options)
    rows = matrix.with_autosomes(windows.select("window_id", "gc_pct")).join(depth, "window_id")
    return corrected_matrix(rows, params, drop_skipped)


def corrected_matrix(rows: DataFrame, params: Params = DEFAULT, drop_skipped: bool = False) -> DataFrame:
    """rows (sample, window_id, ..., gc_pct, is_auto, depth) with centred; a skipped sample keeps its raw depth, or is dropped."""
    norm = matrix.normalized(rows)
    good = matrix.recentred(matrix.gc_corrected(norm.where("status = 'ok'"), matrix.normal_training(), min_points=params.min_points_normal, floor=params.fit_floor))
    keep = ["sample", "window_id", "chrom", "start", "end", "gc_pct", "depth", "status", "centred"]
    if drop_skipped:
        return good.select(keep)
    return good.select(keep).unionByName(norm.where("status <> 'ok'").withColumn("centred", F.col("depth")).select(keep))


def build_panel(normals: DataFrame, windows: DataFrame, k: int = DEFAULT.components) -> DataFrame:
    return panel.panel(normals, windows, k, "centred")


def track_b(reads: DataFrame, panel_track: DataFrame, samples: list[str] | None = None, **depth_options) -> DataFrame:
    depth = coverage.window_depth(reads, panel_track, samples, **depth_options)
    return scaling.track_by_panel(depth, panel_track)


def track_a(reads: DataFrame, targets: DataFrame, panel_track: DataFrame, samples: list[str] | None = None, **depth_options) -> DataFrame:
    """targets: windows with window_id and gc_pct."""
    depth = coverage.window_depth(reads, panel_track, samples, **depth_options)
    on_target = coverage.window_depth(reads, targets, samples, **depth_options).join(targets.select("window_id", "gc_pct"), "window_id")
    return scaling.track_by_target(depth, on_target, panel_track)


def upscale_reads(reads: DataFrame, track: DataFrame, keys: list[str] | None = None, params: Params = DEFAULT) -> DataFrame:
    """All output records, in order of place."""
    scales = track.select("chrom", "start", "end", upscale.conditioned_scale().alias("own_scale"))
    return upscale.coordinate_sorted(upscale.upscaled(reads, scales, keys, params.seed))
