"""Copy-ratio tracks in two variants, with their quality flags.

Anchored on targets: depth over the library's on-target median, over the curve of on-target depth, over the panel's median.
Anchored on the panel: depth over the panel's median, over the curve of that ratio. Windows join by window_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, flag
from ..functions.reuse import reused
from ..params import DEFAULT
from .matrix import gc_corrected, medians, with_autosomes

COLUMNS_A = ["sample", "window_id", "chrom", "start", "end", "gc_pct", "raw_wes_depth", "pon_median_wgs", "depth_scaled_ratio", "pon_cv", "flag_high_cv", "flag_zero_wes", "flag_extreme_scaling", "mask_rejected", "log2_ratio"]
COLUMNS_B = [*COLUMNS_A[:13], "flag_pon_variance", *COLUMNS_A[13:]]


def safe_median(c: str = "pon_median") -> Column:
    return F.when(F.col(c) <= 0, F.lit(DEFAULT.safe_median)).otherwise(F.col(c))


def pon_cv(median: str = "pon_median", variance: str = "pon_variance") -> Column:
    return F.when(F.col(median) > 0, F.try_divide(F.sqrt(F.col(variance)), F.col(median))).otherwise(F.lit(0.0))


def log2_ratio(ratio: str = "depth_scaled_ratio", mask: str = "mask_rejected") -> Column:
    return F.when(F.col(mask) == 0, F.log2(clip(ratio, DEFAULT.log_floor)))


def matching_samples(depths: DataFrame, windows: DataFrame) -> DataFrame:
    """The samples that have a depth for each of the windows, and for no other: the rest would be skipped."""
    want = windows.select("window_id").distinct().withColumn("wanted", F.lit(1))
    n = windows.select("window_id").distinct().agg(F.count("*").alias("n"))
    seen = depths.select("sample", "window_id").distinct().join(want, "window_id", "left")
    found = seen.groupBy("sample").agg(F.count("wanted").alias("both"), F.count("*").alias("own"))
    return found.join(F.broadcast(n)).where("both = n and own = n").select("sample")


def flagged(rows: DataFrame, extreme: Column, columns: list[str]) -> DataFrame:
    """The flags, their union and the masked logarithm. rows: raw depth, panel columns and depth_scaled_ratio."""
    out = rows.withColumn("pon_median_wgs", F.col("pon_median")).withColumn("pon_cv", pon_cv())
    out = out.withColumns({
        "flag_high_cv": flag(F.col("pon_cv") > DEFAULT.max_cv),
        "flag_zero_wes": flag(F.col("raw_wes_depth") == 0),
        "flag_extreme_scaling": flag(extreme),
        "flag_pon_variance": flag(F.col("is_high_variance") == 1),
    })
    mask = F.col("flag_high_cv").bitwiseOR(F.col("flag_zero_wes")).bitwiseOR(F.col("flag_extreme_scaling")).bitwiseOR(F.col("flag_pon_variance"))
    return out.withColumn("mask_rejected", mask).withColumn("log2_ratio", log2_ratio()).select(columns)


def extreme_by_target(ratio: str = "depth_scaled_ratio") -> Column:
    return (F.col(ratio) > DEFAULT.extreme_high) | (F.col(ratio) < DEFAULT.extreme_low)


def extreme_by_panel(ratio: str = "depth_scaled_ratio") -> Column:
    return (F.col("pon_median") < DEFAULT.unstable_median) | (F.col(ratio) > DEFAULT.unstable_ratio)


def joined_with_panel(depths: DataFrame, panel: DataFrame) -> DataFrame:
    """depths (sample, window_id, depth) of the samples that match the panel's windows, with its columns."""
    depths, panel = reused(depths), reused(panel)
    own = depths.join(F.broadcast(matching_samples(depths, panel)), "sample", "left_semi")
    return own.select("sample", "window_id", F.col("depth").alias("raw_wes_depth")).join(panel, "window_id")


def panel_ratio(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ratio", F.col("raw_wes_depth") / safe_median())


def track_by_panel(depths: DataFrame, panel: DataFrame) -> DataFrame:
    rows = panel_ratio(joined_with_panel(depths, panel))
    train = (F.col("raw_wes_depth") > 0) & F.col("gc_pct").isNotNull() & F.col("ratio").isNotNull()
    fixed = gc_corrected(rows, train, "ratio", DEFAULT.min_points_track).withColumn("depth_scaled_ratio", F.col("corrected"))
    return flagged(fixed, extreme_by_panel(), COLUMNS_B)


def library_scale(on_target: DataFrame) -> DataFrame:
    """sample and the median of on-target autosomal depth; samples with 0 are left out (skipped)."""
    return medians(reused(with_autosomes(on_target, "chrom", ["sample"])), "depth", "library").where("library > 0")


def target_ratio(depths: DataFrame, on_target: DataFrame, panel: DataFrame) -> DataFrame:
    """depths over library scale, over the on-target curve, over the panel. on_target: sample, chrom, depth, gc_pct."""
    on_target = reused(on_target)
    scale = F.broadcast(reused(library_scale(on_target)))
    rows = joined_with_panel(depths, panel).join(scale, "sample").withColumn("norm", F.col("raw_wes_depth") / F.col("library"))
    points = on_target.join(scale, "sample").where("depth > 0 and gc_pct is not null").select("sample", F.col("gc_pct").alias("gc"), (F.col("depth") / F.col("library")).alias("y"))
    fixed = gc_corrected(rows, F.lit(True), "norm", DEFAULT.min_points_track, training=points)
    return fixed.withColumn("depth_scaled_ratio", F.col("corrected") / safe_median())


def track_by_target(depths: DataFrame, on_target: DataFrame, panel: DataFrame) -> DataFrame:
    return flagged(target_ratio(depths, on_target, panel), extreme_by_target(), COLUMNS_A)


def usable_summary(track: DataFrame) -> DataFrame:
    """For each sample: windows, usable ones and how many have each flag."""
    flags = [c for c in track.columns if c.startswith("flag_") or c == "mask_rejected"]
    return track.groupBy("sample").agg(F.count("*").alias("windows"), F.count_if(F.col("mask_rejected") == 0).alias("usable"), *[F.sum(F.col(c).cast("long")).alias(c) for c in flags])
