"""Interval algebra on tables with chrom, start, end (0-based, half-open).

Joins on overlap are equi-joins on chromosome and bin. Both sides are exploded over the bins that they touch, and
a pair counts only in the bin in which the later of the two starts, so that it comes out once. One hot chromosome is
spread over its bins; no join compares a row with a whole chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_column
from ..params import DEFAULT

KEYS = ["chrom", "start", "end"]
#: Bases of a bin in which islands are made.
MERGE_BIN = 1 << 20


def tile(intervals: DataFrame, size: int = DEFAULT.window_size) -> DataFrame:
    """Windows of size from each interval's own start; the last one is cut. Empty intervals have none."""
    start = F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(size).cast("long")))
    return intervals.where("end > start").select("chrom", "end", start.alias("s")).select("chrom", F.col("s").alias("start"), F.least(F.col("s") + size, F.col("end")).alias("end"))


def widen(intervals: DataFrame, sizes: DataFrame, by: int = DEFAULT.flank) -> DataFrame:
    """Both ends moved out, within the chromosome. A chromosome without a size is an error, raised when the rows are read."""
    known = intervals.join(F.broadcast(sizes.select("chrom", "size")), "chrom", "left")
    size = F.when(F.col("size").isNotNull(), F.col("size")).otherwise(F.raise_error(F.concat(F.lit("no size for chromosome "), F.col("chrom"))).cast("long"))
    return known.select("chrom", F.greatest(F.col("start") - by, F.lit(0).cast("long")).alias("start"), F.least(F.col("end") + by, size).alias("end"))


def concatenated(*tables: DataFrame) -> DataFrame:
    """All rows, duplicates too, with the three columns that every table has."""
    first, *rest = (t.select(KEYS) for t in tables)
    for t in rest:
        first = first.unionByName(t)
    return first


def islands(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and touching intervals with the same keys become one. Rows with the same keys meet in one task, in order: for many small groups."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.select(*keys, "start", "end", F.when(F.col("start") <= before, 0).otherwise(1).alias("opens"))
    island = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def apart(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """What each interval adds to those before it with the same keys (by start, then end): pieces that overlap nowhere and cover the same places. Nothing is added up, so that a task sorts its rows and keeps no more of them."""
    before = F.max("end").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    return intervals.select(*keys, F.greatest("start", before).alias("start"), "end").where("end > start")


def cut(intervals: DataFrame, size: int) -> DataFrame:
    """The intervals cut at multiples of size, with bin; an empty one stays as it is."""
    pieces = intervals.withColumn("bin", F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"greatest(end - 1, start) div {size}"))))
    return pieces.withColumns({"start": F.greatest("start", F.col("bin") * size), "end": F.least("end", (F.col("bin") + 1) * size)})


def stitched(pieces: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Pieces (with bin, apart within each) that touch over a bound of bins become one.

    Only pieces at a bound can: of each bin two at most, which meet by the keys. All others are a group of their bin.
    """
    edge = (F.col("start") <= F.col("bin") * size) | (F.col("end") >= (F.col("bin") + 1) * size)
    return islands(pieces.withColumn("part", F.when(~edge, F.col("bin"))), [*keys, "part"]).drop("part")


def merge(intervals: DataFrame, keys: list[str] | None = None, bin_size: int = MERGE_BIN) -> DataFrame:
    """Overlapping and touching intervals with the same keys become one, however many a key has.

    Intervals are cut at bins, of which each makes its own islands; those that touch a bin's bounds are stitched. Of intervals with one start the
    longest counts, which partial aggregation finds before the exchange: a bin gets one row for each of its places at most.
    """
    keys = keys or ["chrom"]
    longest = cut(intervals.select(*keys, "start", "end"), bin_size).groupBy(*keys, "bin", "start").agg(F.max("end").alias("end"))
    return stitched(islands(longest, [*keys, "bin"]), keys, bin_size)


def _binned(table: DataFrame, size: int, start: str, end: str) -> DataFrame:
    bins = F.sequence(F.expr(f"{start} div {size}"), F.expr(f"greatest({end} - 1, {start}) div {size}"))
    return table.withColumn("bin", F.explode(bins))


def overlap_join(left: DataFrame, right: DataFrame, bin_size: int = DEFAULT.window_size, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals, once each: left's columns, and right's with the prefix r_ (chrom apart).

    how: inner, or left_outer, which keeps left rows without a partner; then left must hold a column row that is unique.
    """
    r = right.select("chrom", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "chrom"])
    a, b = _binned(left.where("end > start"), bin_size, "start", "end"), _binned(r.where("r_end > r_start"), bin_size, "r_start", "r_end")
    pairs = a.join(b, ["chrom", "bin"]).where(f"r_start < end and start < r_end and bin = greatest(start, r_start) div {bin_size}").drop("bin")
    if how == "inner":
        return pairs
    return left.join(pairs.select("row", *[c for c in r.columns if c != "chrom"]), "row", "left")


def subtract(windows: DataFrame, mask: DataFrame, bin_size: int = DEFAULT.window_size) -> DataFrame:
    """What of each window (a window per row, repeated ones too) no interval of mask covers. mask: merged.

    Windows and mask are cut at bins and meet once, a bin's mask as one array (of bin_size elements at most); what is left is stitched by window.
    """
    rows = cut(windows.select(*KEYS, F.monotonically_increasing_id().alias("row")).where("end > start"), bin_size)
    cuts = cut(mask.select(*KEYS).where("end > start"), bin_size).groupBy("chrom", "bin").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    own = rows.join(cuts, ["chrom", "bin"], "left")
    near = F.filter(F.coalesce("cuts", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda c: (c["end"] > F.col("start")) & (c["start"] < F.col("end")))
    # The pieces lie between one cut's end and the next one's start.
    own = own.withColumn("near", near)
    pieces = F.arrays_zip(F.concat(F.array("start"), F.col("near.end")).alias("start"), F.concat(F.col("near.start"), F.array("end")).alias("end"))
    left = own.select("row", "chrom", "bin", F.explode(pieces).alias("p")).select("row", "chrom", "bin", "p.start", "p.end").where("end > start")
    return stitched(left, ["row", "chrom"], bin_size).select(KEYS)


def long_enough(windows: DataFrame, size: int = DEFAULT.window_size, fraction: float = DEFAULT.min_fraction) -> DataFrame:
    return windows.where(F.col("end") - F.col("start") >= int(size * fraction))


def window_name(chrom: str | Column = "chrom", start: str | Column = "start", end: str | Column = "end") -> Column:
    return F.concat(as_column(chrom), F.lit(":"), as_column(start).cast("string"), F.lit("-"), as_column(end).cast("string"))


def named(windows: DataFrame) -> DataFrame:
    return windows.select(*KEYS, window_name().alias("name"))


def packed_bins(windows: DataFrame, value: str, bin_size: int = DEFAULT.window_size) -> DataFrame:
    """A row for each bin that windows touch: chrom, bin and windows, an array of (start, end, value) in order.

    A window of which an earlier one (by start, then end) covers all that lies in the bin is nowhere the first there and is left out. Those that stay
    end at different places of the bin, so that an array has bin_size elements at most, however many windows overlap.
    """
    w = _binned(windows.where("end > start").select("chrom", F.col("start").alias("w_start"), F.col("end").alias("w_end"), F.col(value).alias("w_value")), bin_size, "w_start", "w_end")
    order = Window.partitionBy("chrom", "bin").orderBy("w_start", "w_end", "w_value").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.least(F.col("w_end"), (F.col("bin") + 1) * bin_size)
    first = w.withColumn("before", F.max(upto).over(order)).where(F.col("before").isNull() | (upto > F.col("before")))
    return first.groupBy("chrom", "bin").agg(F.sort_array(F.collect_list(F.struct("w_start", "w_end", "w_value"))).alias("windows"))


def looked_up(points: DataFrame, bins: DataFrame, value: str, default: float, bin_size: int = DEFAULT.window_size) -> DataFrame:
    """points (with chrom and pos) with value, by one join with packed_bins; points may be a stream."""
    own = points.withColumn("bin", F.expr(f"pos div {bin_size}"))
    packed = bins.select(F.col("chrom").alias("b_chrom"), F.col("bin").alias("b_bin"), "windows")
    found = own.join(packed, (F.col("chrom") == F.col("b_chrom")) & (F.col("bin") == F.col("b_bin")), "left")
    at = F.get(F.filter("windows", lambda w: (w["w_start"] <= F.col("pos")) & (F.col("pos") < w["w_end"])), F.lit(0))["w_value"]
    return found.withColumn(value, F.coalesce(at, F.lit(default))).drop("bin", "b_chrom", "b_bin", "windows")


def point_lookup(points: DataFrame, windows: DataFrame, value: str, default: float, bin_size: int = DEFAULT.window_size) -> DataFrame:
    """points with value: that of the first window (by start, then end) with start <= pos < end, else the default.

    points: chrom and pos. They are joined once, with the packed windows of their bin; a point without a place has the default.
    """
    return looked_up(points, packed_bins(windows, value, bin_size), value, default, bin_size)
