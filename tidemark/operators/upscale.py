"""Replication of read pairs according to a copy-ratio track.

reads: qname, flag, chrom, pos, ord (order in the file, unique) and any more columns; a name (and sample) is a key, never a
whole file in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import clip, has_bits, hash_uniform
from ..params import DEFAULT
from .intervals import point_lookup

UNMAPPED, SECONDARY, DUPLICATE, SUPPLEMENTARY, FIRST = 4, 256, 1024, 2048, 64


def conditioned_scale(ratio: str = "depth_scaled_ratio", mask: str = "mask_rejected") -> Column:
    """1 up to a ratio of 1, where masked or unknown; else the ratio within the limits."""
    r = F.col(ratio)
    own = F.when(r.isNull() | (r <= 1) | F.coalesce(F.col(mask) == 1, F.lit(False)), F.lit(1.0)).otherwise(r)
    return clip(own, DEFAULT.min_scale, DEFAULT.max_scale)


def passes_through(flag: str = "flag", chrom: str = "chrom") -> Column:
    """Reads that are written unchanged: unmapped, secondary, supplementary or without a chromosome."""
    return has_bits(flag, UNMAPPED | SECONDARY | SUPPLEMENTARY) | F.col(chrom).isNull()


def paired(reads: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """reads with pair_no and nth: in order of ord a name's records are paired 1-2, 3-4, ...; a last single one is an orphan.

    complete: whether the pair has both records.
    """
    own = in_order(keys)
    out = reads.withColumns({"n": F.row_number().over(own), "more": F.lead(F.lit(True)).over(own)})
    return out.withColumn("pair_no", F.expr("(n - 1) div 2")).withColumn("nth", F.expr("(n - 1) % 2")).withColumn("complete", F.expr("n % 2 = 0 or more is not null")).drop("n", "more")


def in_order(keys: list[str] | None = None) -> WindowSpec:
    """A name's records in order. All that concerns pairs looks at neighbours in it, so that a name's records are sorted once."""
    return Window.partitionBy(*(keys or ["qname"])).orderBy("ord")


def of_mate(value: Column, keys: list[str] | None = None) -> Column:
    """The value of the pair's other record; null for an orphan."""
    own = in_order(keys)
    return F.when(F.col("nth") == 1, F.lag(value).over(own)).otherwise(F.lead(value).over(own))


def with_own_scale(reads: DataFrame, track: DataFrame) -> DataFrame:
    """reads with own_scale, that of the window at the read's start. track: chrom, start, end, own_scale."""
    return point_lookup(reads, track, "own_scale", 1.0)


def with_scale(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Paired reads with scale, the mean of the pair's two own scales; 1 for an orphan. It needs no exchange beyond that of paired()."""
    own, other = F.col("own_scale"), of_mate(F.col("own_scale"), keys)
    mean = (F.coalesce(own, other) + F.coalesce(other, own)) / 2
    return pairs.withColumn("scale", F.when(F.col("complete"), mean).otherwise(F.lit(1.0)))


def copy_count(scale: str | Column = "scale", key: str | Column = "qname", seed: int = DEFAULT.seed) -> Column:
    """floor(scale), plus one with the fraction's probability, by a number hashed from the key; at least 1."""
    s = F.col(scale) if isinstance(scale, str) else scale
    extra = F.when(s > F.floor(s), (hash_uniform(key, seed) < s - F.floor(s)).cast("int")).otherwise(F.lit(0))  # most scales have no fraction
    return F.greatest(F.lit(1), F.floor(s).cast("int") + extra)


def mate_order(keys: list[str] | None = None) -> Column:
    """1 or 2: the later record goes first if it is read 1, else the earlier one does."""
    first = has_bits("flag", FIRST)
    later_first = F.when(F.col("nth") == 1, first).otherwise(of_mate(first, keys))
    return F.when(F.coalesce(later_first, F.lit(False)), 2 - F.col("nth")).otherwise(F.col("nth") + 1)


def copies_of(rows: DataFrame, key: Column, seed: int = DEFAULT.seed) -> DataFrame:
    """A row for each copy, with copy. rows: kind and scale.

    Of a pair's record copy 0 keeps its name and the others get one of their own; none has the duplicate bit. Other records stay as they are.
    """
    pair = F.col("kind") == "pair"
    copies = F.when(pair, copy_count("scale", key, seed)).otherwise(F.lit(1))
    out = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    name = F.when(F.col("copy") == 0, F.col("qname")).otherwise(F.concat("qname", F.lit(":upscale_"), F.col("copy").cast("string")))
    return out.withColumn("qname", name).withColumn("flag", F.when(pair, F.col("flag").bitwiseAND(F.lit(~DUPLICATE))).otherwise(F.col("flag")))


def upscaled(reads: DataFrame, track: DataFrame, keys: list[str] | None = None, seed: int = DEFAULT.seed, draw: str = "pair_no") -> DataFrame:
    """All output records: reads' columns with kind (passthrough, orphan, pair), copy and mate.

    track: chrom, start, end and own_scale (see conditioned_scale). draw: what a pair's random number depends on beside its keys: pair_no, or ord,
    that of its first record, which a stream knows too.

    reads are read once, and exchanged by name once: a record that passes through is a group of its own there.
    """
    keys = keys or ["qname"]
    own = [*keys, "aside"]
    rows = with_own_scale(reads.withColumn("aside", F.when(passes_through(), F.struct("ord"))), track)
    pairs = with_scale(paired(rows, own), own)
    kind = F.when(F.col("aside").isNotNull(), "passthrough").when(F.col("complete"), "pair").otherwise("orphan")
    first = F.when(F.col("nth") == 1, of_mate(F.col("ord"), own)).otherwise(F.col("ord")) if draw == "ord" else F.col(draw)
    ready = pairs.withColumn("kind", kind).withColumn("mate", F.when(F.col("kind") == "pair", mate_order(own)).cast("int")).withColumn("drawn", first)
    return copies_of(ready, F.concat_ws(":", *keys, "drawn"), seed).select(*reads.columns, "kind", "copy", "mate")


def upscale_stats(out: DataFrame) -> DataFrame:
    """processed, kept_reads, duplicated_reads: kept is what was read, duplicated what was added."""
    return out.agg(F.count_if(F.col("copy") == 0).alias("processed"), F.count_if(F.col("copy") == 0).alias("kept_reads"), F.count_if(F.col("copy") > 0).alias("duplicated_reads"))


def coordinate_sorted(out: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by place, as an index needs it; reads without a place come last."""
    order = [F.col("chrom").asc_nulls_last(), F.col("pos").asc_nulls_last(), "ord", "copy"]
    dealt = out.repartitionByRange(partitions, *order) if partitions else out.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order)
