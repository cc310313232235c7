"""The depth matrix, kept long (sample, window_id, ..., depth): reshaping, normalisation, correction.

A wide table is made for files alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_column, is_autosome
from ..functions.quantiles import exact_quantiles
from ..functions.reuse import reused
from ..params import DEFAULT
from .smooth import corrected, interpolated, lowess_fit

META = ["window_id", "chrom", "start", "end", "gc_pct"]


def pivoted(depths: DataFrame, samples: list[str], value: str = "depth", by: list[str] | None = None) -> DataFrame:
    """A column for each sample. A sample that has a window twice is an error, raised when the rows are read."""
    cell = F.when(F.count(value) <= 1, F.first(value)).otherwise(F.raise_error(F.lit("a sample has a window twice")).cast("double"))
    return depths.groupBy(*(by or ["window_id"])).pivot("sample", samples).agg(cell)


def unpivoted(wide: DataFrame, meta: list[str] | None = None, value: str = "depth") -> DataFrame:
    """A row for each window and sample; every column that isn't meta is a sample."""
    meta = [c for c in (meta or META) if c in wide.columns]
    return wide.unpivot(meta, [c for c in wide.columns if c not in meta], "sample", value)


def with_autosomes(windows: DataFrame, by: str | Column = "window_id", keys: list[str] | None = None) -> DataFrame:
    """windows with is_auto; where there is no autosome (of the keys), all count as one."""
    auto = is_autosome(by)
    windows = reused(windows)
    if keys is None:
        some = windows.agg(F.coalesce(F.bool_or(auto), F.lit(False)).alias("some"))
        return windows.join(F.broadcast(some)).withColumn("is_auto", auto | ~F.col("some")).drop("some")
    return windows.withColumn("is_auto", auto | ~F.max(auto).over(Window.partitionBy(*keys)))


def medians(rows: DataFrame, value: str, name: str) -> DataFrame:
    """sample and the exact median of value over rows (stored) with is_auto; nulls are ignored, and a sample without a value has no row."""
    return exact_quantiles(rows.where("is_auto"), ["sample"], value, 0.5, name)


def normalized(rows: DataFrame, value: str = "depth") -> DataFrame:
    """rows (with is_auto) with norm: value over the sample's autosomal median, and status.

    A sample whose median is 0 keeps its raw values, with status "skipped".
    """
    rows = reused(rows)
    m = medians(rows, value, "middle")
    ok = F.col("middle") != 0
    out = rows.join(F.broadcast(m), "sample", "left")
    return out.withColumn("norm", F.when(ok, F.try_divide(F.col(value), F.col("middle"))).otherwise(F.col(value))).withColumn("status", F.when(ok, F.lit("ok")).otherwise(F.lit("skipped"))).drop("middle")


def gc_corrected(rows: DataFrame, train: Column, value: str = "norm", min_points: int = DEFAULT.min_points_normal, floor: float = DEFAULT.fit_floor, gc: str = "gc_pct", training: DataFrame | None = None) -> DataFrame:
    """rows with corrected: value over the sample's curve, which the rows where train holds give; with fewer than min_points of them, value.

    training: other rows to fit the curve to (sample, gc, y).
    """
    rows = reused(rows)
    points = rows.where(train).select("sample", F.col(gc).alias("gc"), F.col(value).alias("y")) if training is None else training
    curve = reused(lowess_fit(points))
    usable = curve.where(F.col("points") >= min_points)
    fitted = interpolated(rows.withColumn("gc", F.col(gc)), usable.select("sample", "gc", "fit"))
    enough = F.broadcast(usable.select("sample").distinct().withColumn("enough", F.lit(True)))
    out = fitted.join(enough, "sample", "left")
    return out.withColumn("corrected", F.when(F.col("enough"), corrected(value, "fit", floor)).otherwise(as_column(value))).withColumn("corrected_by", F.when(F.col("enough"), F.lit("curve")).otherwise(F.lit("too few points"))).drop("enough", *(["gc"] if gc != "gc" else []))


def normal_training() -> Column:
    return F.col("is_auto") & (F.col("norm") > 0) & F.col("gc_pct").isNotNull()


def recentred(rows: DataFrame, value: str = "corrected") -> DataFrame:
    """rows with centred: value over the sample's autosomal median of it. Nulls are left out of the median."""
    rows = reused(rows)
    m = medians(rows, value, "middle")
    return rows.join(F.broadcast(m), "sample", "left").withColumn("centred", F.try_divide(F.col(value), F.col("middle"))).drop("middle")
