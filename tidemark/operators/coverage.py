"""Mean depth of windows from aligned reads.

reads: sample, qname, flag, chrom, pos (0-based), mapq, cigar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has_bits
from ..functions.reuse import reused
from ..params import DEFAULT
from .intervals import apart, cut, overlap_join

#: CIGAR operations that take up bases of the chromosome, and those of them that are aligned to it.
CONSUMING, ALIGNED = "MDN=X", "M=X"


def usable_reads(reads: DataFrame, min_mapq: int = DEFAULT.min_mapq, mask: int = DEFAULT.flag_mask) -> DataFrame:
    return reads.where((F.col("mapq") >= min_mapq) & ~has_bits("flag", mask))


def aligned_blocks(reads: DataFrame) -> DataFrame:
    """The reads' other columns, with a row (start, end) for each aligned block of the CIGAR."""
    lengths = F.transform(F.regexp_extract_all("cigar", F.lit("(\\d+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast("long"))
    kinds = F.regexp_extract_all("cigar", F.lit("\\d+([MIDNSHP=X])"), F.lit(1))
    ops = F.zip_with(lengths, kinds, lambda n, k: F.struct(n.alias("n"), k.alias("k")))
    begin = F.struct(F.col("pos").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("blocks"))

    def step(acc, op):
        end = acc["at"] + F.when(F.lit(CONSUMING).contains(op["k"]), op["n"]).otherwise(F.lit(0).cast("long"))
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.lit(ALIGNED).contains(op["k"]), F.concat(acc["blocks"], one)).otherwise(acc["blocks"]).alias("blocks"))

    # Of a single aligned block there is nothing to be parsed but its length.
    single = F.array(F.struct(F.col("pos").cast("long").alias("start"), F.expr("pos + cast(substring(cigar, 1, length(cigar) - 1) as long)").alias("end")))
    blocks = F.explode(F.when(F.col("cigar").rlike("^\\d+[M=X]\\z"), single).otherwise(F.aggregate(ops, begin, step)["blocks"]))
    return reads.withColumn("block", blocks).select(*[c for c in reads.columns if c not in ("start", "end")], "block.start", "block.end")


def window_depth(reads: DataFrame, windows: DataFrame, samples: list[str] | None = None, merge_mates: bool = True, decimals: int | None = None, min_mapq: int = DEFAULT.min_mapq, mask: int = DEFAULT.flag_mask, bin_size: int = DEFAULT.window_size) -> DataFrame:
    """sample, window_id, chrom, start, end, depth for each sample and window, zeros too.

    Depth is the mean over the window's bases; no table of single bases is made. merge_mates: bases that both mates of a
    template cover count once. decimals: round the depth, as depth files do. samples: those of the reads, if not given.

    A sweep line: blocks, cut at bins, are +1 where they start and -1 where they end, and what comes to one place is added up before the exchange. So a bin
    gets two rows at most for each sample and place, however many reads pile up there. A window's bases are the sum of sign * (window's end - place), of the places before its
    end, where a place before its start counts as its start.
    """
    windows = reused(windows)
    blocks = aligned_blocks(usable_reads(reads, min_mapq, mask)).select("sample", "qname", "chrom", "start", "end")
    if merge_mates:
        blocks = apart(blocks, ["sample", "qname", "chrom"])
    steps = cut(blocks.select("sample", "chrom", "start", "end").where("end > start"), bin_size)
    at = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step"))))
    places = steps.select("sample", "chrom", "bin", at.alias("e")).groupBy("sample", "chrom", "bin", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step")).where("step <> 0")
    pieces = cut(windows.select("window_id", "chrom", "start", "end").where("end > start"), bin_size)
    bases = F.sum(F.col("step") * (F.col("end") - F.greatest("at", "start")))
    covered = places.join(pieces, ["chrom", "bin"]).where("at < end").groupBy("sample", "window_id").agg(bases.alias("bases"))
    names = F.array(*[F.lit(s) for s in samples]) if samples is not None else None
    cells = windows.select("window_id", "chrom", "start", "end", F.explode(names).alias("sample")) if names is not None else windows.select("window_id", "chrom", "start", "end").join(F.broadcast(reads.select("sample").distinct()))
    depth = F.coalesce(F.col("bases"), F.lit(0)) / (F.col("end") - F.col("start"))
    out = cells.join(covered, ["sample", "window_id"], "left").withColumn("depth", depth if decimals is None else F.round(depth, decimals))
    return out.select("sample", "window_id", "chrom", "start", "end", "depth")


def gc_fraction(windows: DataFrame, sequences: DataFrame, chunk: int) -> DataFrame:
    """window_id and gc_pct: share of G and C, in either case, in the window's bases (N counts below the line).

    sequences: chrom, start, seq; chunks of at most chunk bases. A window with no base known has no value.
    """
    pieces = sequences.select("chrom", "start", (F.col("start") + F.length("seq")).alias("end"), "seq")
    pairs = overlap_join(windows.select("window_id", "chrom", "start", "end"), pieces, chunk)
    part = F.expr("substring(r_seq, cast(greatest(start, r_start) - r_start + 1 as int), cast(least(end, r_end) - greatest(start, r_start) as int))")
    gc = pairs.withColumn("part", part).groupBy("window_id", "start", "end").agg(F.sum(F.length("part") - F.length(F.regexp_replace("part", "[GCgc]", ""))).alias("gc"))
    found = gc.select("window_id", (F.col("gc") / (F.col("end") - F.col("start"))).alias("gc_pct"))
    return windows.select("window_id").join(found, "window_id", "left")
