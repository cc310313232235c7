"""Registered queries on coverage, and SQL for each: operators one by one, then the pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_autosome, sample_name, track_sample_name
from ..functions.reuse import new_folder, partitions_for, partitions_of, reused
from ..operators import coverage, intervals, matrix, panel, scaling, smooth, upscale
from ..streaming.upscaling import remaining, upscaled_stream
from . import fixtures as fx
from . import pipelines
from .sql import query

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Shared tables of the query that is being built, and the number of its reads.
_MADE: dict[tuple, DataFrame] = {}
_N_READS: dict[str, int] = {}


def _n_reads(spark: SparkSession, d: str) -> int:
    if d not in _N_READS:
        _N_READS[d] = fx.table(spark, d, "lineitem").count()
    return _N_READS[d]


def _once(make):
    """Within one query a shared table is made once, by as many tasks as the reads need."""

    def run(spark: SparkSession, d: str, *args) -> DataFrame:
        key = (make.__name__, d, *map(str, args))
        if key not in _MADE:
            with partitions_for(spark, _n_reads(spark, d)):
                _MADE[key] = reused(make(spark, d, *args))
        return _MADE[key]

    return run


def _registered(sql: str | None):
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _MADE.clear()
            _N_READS.clear()
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = query(sql)
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- the tables that the queries share


@_once
def _mask(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge(intervals.concatenated(intervals.widen(fx.targets(spark, d), fx.sizes(spark, d)), fx.centromeres(spark, d)))


@_once
def _windows(spark: SparkSession, d: str) -> DataFrame:
    named = pipelines.define_windows(fx.access(spark, d), fx.targets(spark, d), fx.centromeres(spark, d), fx.sizes(spark, d))
    return named.withColumnRenamed("name", "window_id").withColumn("gc_pct", fx.gc())


_ALL = [*fx.NORMALS, fx.TUMOUR]


@_once
def _made_depth(spark: SparkSession, d: str, samples: list[str]) -> DataFrame:
    reads = fx.reads(spark, d).where(F.col("sample").isin(samples))
    return coverage.window_depth(reads, _windows(spark, d), samples)


def _depth(spark: SparkSession, d: str, samples: list[str]) -> DataFrame:
    """Of a query that needs all samples, all are made at once, in one pass over the reads."""
    if ("_made_depth", d, str(_ALL)) in _MADE:
        return _made_depth(spark, d, _ALL).where(F.col("sample").isin(samples))
    return _made_depth(spark, d, samples)


@_once
def _matrix(spark: SparkSession, d: str) -> DataFrame:
    windows = _windows(spark, d).select("window_id", "gc_pct")
    return matrix.with_autosomes(windows).join(_depth(spark, d, fx.NORMALS), "window_id")


@_once
def _corrected(spark: SparkSession, d: str) -> DataFrame:
    norm = matrix.normalized(_matrix(spark, d))
    return matrix.gc_corrected(norm.where("status = 'ok'"), matrix.normal_training())


@_once
def _centred(spark: SparkSession, d: str) -> DataFrame:
    return matrix.recentred(_corrected(spark, d))


@_once
def _panel(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.build_panel(_centred(spark, d), _windows(spark, d), 1)


@_once
def _tumour(spark: SparkSession, d: str) -> DataFrame:
    _depth(spark, d, _ALL)
    return scaling.panel_ratio(scaling.joined_with_panel(_depth(spark, d, [fx.TUMOUR]), _panel(spark, d)))


#: What a read pair is known by, in all samples together.
_KEYS = ["sample", "qname"]
#: Reads of a stream for each bucket of names: a bucket's records of one batch, and those that wait, are in a Python worker at once.
BUCKET_READS = 20_000
#: Reads for each state partition of a stream, and for each range of places.
RANGE_READS = 500_000


def _reads(spark: SparkSession, d: str) -> DataFrame:
    """Read once by each query but the stream's, so that they aren't stored."""
    return fx.reads(spark, d)


@_once
def _tumour_reads(spark: SparkSession, d: str) -> DataFrame:
    return fx.reads(spark, d).where(F.col("sample") == fx.TUMOUR)


@_once
def _scales(spark: SparkSession, d: str) -> DataFrame:
    return _track_b(spark, d).select("chrom", "start", "end", upscale.conditioned_scale().alias("own_scale"))


@_once
def _track_b(spark: SparkSession, d: str) -> DataFrame:
    _depth(spark, d, _ALL)
    return scaling.track_by_panel(_depth(spark, d, [fx.TUMOUR]), _panel(spark, d))


@_once
def _track_a(spark: SparkSession, d: str) -> DataFrame:
    reads = fx.reads(spark, d).where(F.col("sample") == fx.TUMOUR)
    return pipelines.track_a(reads, fx.on_target(spark, d), _panel(spark, d), [fx.TUMOUR])


@_once
def _scaled(spark: SparkSession, d: str) -> DataFrame:
    reads = upscale.with_own_scale(_reads(spark, d).where(~upscale.passes_through()), _scales(spark, d))
    return upscale.with_scale(upscale.paired(reads, _KEYS), _KEYS).withColumn("mate", F.when(F.col("complete"), upscale.mate_order(_KEYS)).cast("int"))


@_once
def _output(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    """kind: only these records are stored."""
    out = upscale.upscaled(_reads(spark, d), _scales(spark, d), _KEYS)
    return out if kind is None else out.where(F.col("kind") == kind)


# --- windows


@_registered('SELECT chrom, start, "end" FROM tiles')
def make_windows(spark, d):
    return intervals.tile(fx.access(spark, d))


@_registered('SELECT chrom, start, "end" FROM widened')
def slop_targets(spark, d):
    return intervals.widen(fx.targets(spark, d), fx.sizes(spark, d))


@_registered('SELECT chrom, start, "end" FROM masks ORDER BY chrom, start')
def concat_masks(spark, d):
    return intervals.concatenated(intervals.widen(fx.targets(spark, d), fx.sizes(spark, d)), fx.centromeres(spark, d)).orderBy("chrom", "start")


@_registered('SELECT chrom, start, "end" FROM merged')
def merge_mask(spark, d):
    return _mask(spark, d)


@_registered('SELECT chrom, start, "end" FROM fragments')
def subtract_mask(spark, d):
    return intervals.subtract(intervals.tile(fx.access(spark, d)), _mask(spark, d))


@_registered('SELECT chrom, start, "end", "end" - start AS length FROM fragments WHERE "end" - start >= 2500')
def min_len_filter(spark, d):
    return intervals.long_enough(subtract_mask(spark, d)).withColumn("length", F.col("end") - F.col("start"))


@_registered("""SELECT chrom, start, "end", chrom || ':' || start || '-' || "end" AS name FROM fragments""")
def name_windows(spark, d):
    return intervals.named(subtract_mask(spark, d))


@_registered('SELECT chrom, start, "end", window_id AS name FROM windows')
def define_windows(spark, d):
    return pipelines.define_windows(fx.access(spark, d), fx.targets(spark, d), fx.centromeres(spark, d), fx.sizes(spark, d))


@_registered("SELECT 'tiles' AS stage, count(*) AS n FROM tiles UNION ALL SELECT 'mask', count(*) FROM merged UNION ALL SELECT 'fragments', count(*) FROM fragments UNION ALL SELECT 'windows', count(*) FROM windows")
def stage_counts(spark, d):
    stages = {"tiles": make_windows, "mask": merge_mask, "fragments": subtract_mask, "windows": define_windows}
    counts = [f(spark, d).agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, f in stages.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


# --- depth and gc


@_registered("SELECT sample, qname, ord, flag, mapq, chrom, pos FROM reads WHERE mapq >= 20 AND flag & 3844 = 0")
def read_filter(spark, d):
    return coverage.usable_reads(fx.reads(spark, d)).select("sample", "qname", "ord", "flag", "mapq", "chrom", "pos")


@_registered("""SELECT qname, ord, chrom, pos + s AS start, pos + e AS "end" FROM (SELECT qname, ord, chrom, pos, unnest([0, n + 15]) AS s, unnest([n, 2 * n + 15]) AS e FROM (SELECT *, "end" - pos AS n FROM reads)) WHERE e > s""")
def cigar_blocks(spark, d):
    """Reads as if each matched twice, with insertions, a deletion, a skip and clips around."""
    n = F.regexp_extract("cigar", "(\\d+)M", 1)
    cigar = F.concat(F.lit("3S"), n, F.lit("M2I5D10N"), n, F.lit("=4H"))
    return coverage.aligned_blocks(fx.reads(spark, d).withColumn("cigar", cigar)).select("qname", "ord", "chrom", "start", "end")


@_registered('SELECT sample, qname, chrom, start, "end" FROM templates')
def template_blocks(spark, d):
    blocks = coverage.aligned_blocks(coverage.usable_reads(fx.reads(spark, d)))
    return intervals.islands(blocks, ["sample", "qname", "chrom"]).select("sample", "qname", "chrom", "start", "end")


@_registered("SELECT sample, window_id, round(depth, 6) AS depth FROM depth")
def window_depth(spark, d):
    return _rounded(_depth(spark, d, _ALL).select("sample", "window_id", "depth"))


@_registered("""SELECT window_id, CAST(length(part) - length(regexp_replace(part, '[GCgc]', '', 'g')) AS DOUBLE) / length(part) AS gc_pct FROM (
    SELECT chrom || ':' || s || '-' || least(s + 500, n) AS window_id, substring(text, s + 1, least(s + 500, n) - s) AS part
    FROM (SELECT 'd' || doc_id AS chrom, text, length(text) AS n, unnest(range(0, length(text), 500)) AS s FROM documents WHERE length(text) > 0))""")
def gc_content(spark, d):
    return coverage.gc_fraction(fx.text_windows(spark, d), fx.sequences(spark, d), fx.GC_CHUNK)


# --- the matrix


@_registered("SELECT window_id, round(max(depth) FILTER (sample = 's0'), 6) AS s0, round(max(depth) FILTER (sample = 's1'), 6) AS s1, round(max(depth) FILTER (sample = 's2'), 6) AS s2 FROM depth GROUP BY window_id")
def pivot_matrix(spark, d):
    return _rounded(matrix.pivoted(_depth(spark, d, fx.NORMALS), fx.NORMALS))


@_registered("SELECT window_id, sample, round(depth, 6) AS depth FROM depth WHERE sample <> 's3'")
def unpivot_matrix(spark, d):
    return _rounded(matrix.unpivoted(matrix.pivoted(_depth(spark, d, fx.NORMALS), fx.NORMALS)))


@_registered("SELECT window_id, NOT regexp_matches(window_id, '^(chrX|chrY|chrM|X|Y|MT)') AS is_auto FROM windows")
def autosome_mask(spark, d):
    return matrix.with_autosomes(_windows(spark, d)).select("window_id", "is_auto")


@_registered("SELECT sample, window_id, round(norm, 6) AS norm, status FROM norm")
def median_normalize(spark, d):
    return _rounded(matrix.normalized(_matrix(spark, d)).select("sample", "window_id", "norm", "status"))


@_registered("SELECT sample, x AS gc, round(fit, 6) AS fit, n AS points FROM n_curve")
def lowess_fit(spark, d):
    rows = matrix.normalized(_matrix(spark, d)).where(matrix.normal_training())
    return _rounded(smooth.lowess_fit(rows.select("sample", F.col("gc_pct").alias("gc"), F.col("norm").alias("y")))).select("sample", "gc", "fit", "points")


@_registered("SELECT sample, window_id, round(fit, 6) AS fit FROM fitted")
def interp_clamped(spark, d):
    return _rounded(_corrected(spark, d).select("sample", "window_id", "fit"))


@_registered("SELECT sample, window_id, round(corrected, 6) AS corrected FROM corrected")
def gc_correct(spark, d):
    return _rounded(_corrected(spark, d).select("sample", "window_id", "corrected"))


@_registered("SELECT sample, window_id, round(centred, 6) AS centred FROM centred")
def recenter(spark, d):
    return _rounded(_centred(spark, d).select("sample", "window_id", "centred"))


# --- the panel


@_registered("SELECT sample, window_id, round(centred - avg(centred) OVER (PARTITION BY window_id), 6) AS off, round(avg(centred) OVER (PARTITION BY window_id), 6) AS row_mean FROM centred")
def row_center(spark, d):
    return _rounded(panel.row_centred(_centred(spark, d), "centred").select("sample", "window_id", "off", "row_mean"))


@_registered("SELECT sample, window_id, round(denoised, 6) AS denoised FROM denoised")
def svd_denoise(spark, d):
    return _rounded(panel.denoised(_centred(spark, d), 1, "centred").select("sample", "window_id", "denoised"))


@_registered("""SELECT round(100 * (var_pop(r1) / (var_pop(d1) + var_pop(d2) + var_pop(d3))), 6) AS explained_pct FROM (
    SELECT u * cos(theta) + v * sin(theta) AS r1, d1 - m AS d1, d2 - m AS d2, d3 - m AS d3 FROM offs JOIN wide USING (window_id), angle)""")
def svd_explained(spark, d):
    return spark.createDataFrame([(round(panel.explained_variance(_centred(spark, d), 1, "centred"), 6),)], "explained_pct double")


@_registered("SELECT window_id, round(pon_median, 6) AS pon_median, round(pon_variance, 9) AS pon_variance FROM stats")
def pon_stats(spark, d):
    stats = panel.panel_stats(panel.denoised(_centred(spark, d), 1, "centred"))
    return stats.select("window_id", F.round("pon_median", 6).alias("pon_median"), F.round("pon_variance", 9).alias("pon_variance"))


@_registered('SELECT window_id, chrom, start, "end", round(gc_pct, 6) AS gc_pct, round(pon_median, 6) AS pon_median, is_high_variance FROM panel')
def pon_high_variance(spark, d):
    return _rounded(_panel(spark, d).drop("pon_variance"))


# --- tracks


@_registered("SELECT window_id, round(ratio, 6) AS ratio FROM tumour")
def ratio_pon_anchored(spark, d):
    return _rounded(_tumour(spark, d).select("window_id", "ratio"))


@_registered("SELECT window_id, round(depth_scaled_ratio, 6) AS depth_scaled_ratio FROM a_rows")
def ratio_target_anchored(spark, d):
    return _rounded(_track_a(spark, d).select("window_id", "depth_scaled_ratio"))


@_registered("SELECT sample, round(library, 6) AS library FROM library")
def library_scale(spark, d):
    targets = fx.on_target(spark, d)
    return _rounded(scaling.library_scale(coverage.window_depth(_tumour_reads(spark, d), targets, [fx.TUMOUR])))


@_registered("SELECT sample FROM (SELECT sample, count(*) AS n FROM depth GROUP BY sample) WHERE n = (SELECT count(*) FROM windows)")
def matching_samples(spark, d):
    return scaling.matching_samples(_depth(spark, d, _ALL), _windows(spark, d))


@_registered("SELECT window_id, round(CASE WHEN pon_median > 0 THEN sqrt(pon_variance) / pon_median ELSE 0 END, 6) AS pon_cv FROM panel")
def pon_cv(spark, d):
    return _rounded(_panel(spark, d).select("window_id", scaling.pon_cv().alias("pon_cv")))


@_registered("SELECT window_id, flag_high_cv FROM track_b")
def flag_high_cv(spark, d):
    return _track_b(spark, d).select("window_id", "flag_high_cv")


@_registered("SELECT window_id, flag_zero_wes FROM track_b")
def flag_zero(spark, d):
    return _track_b(spark, d).select("window_id", "flag_zero_wes")


@_registered("SELECT window_id, flag_extreme_scaling FROM track_a")
def flag_extreme_a(spark, d):
    return _track_a(spark, d).select("window_id", "flag_extreme_scaling")


@_registered("SELECT window_id, flag_extreme_scaling FROM track_b")
def flag_extreme_b(spark, d):
    return _track_b(spark, d).select("window_id", "flag_extreme_scaling")


@_registered("SELECT window_id, flag_pon_variance, mask_rejected FROM track_b")
def mask_rejected(spark, d):
    return _track_b(spark, d).select("window_id", "flag_pon_variance", "mask_rejected")


@_registered("SELECT window_id, round(log2_ratio, 6) AS log2_ratio FROM track_b")
def log2_masked(spark, d):
    return _rounded(_track_b(spark, d).select("window_id", "log2_ratio"))


_SHARED = 'sample, window_id, chrom, start, "end", round(gc_pct, 6) AS gc_pct, round(raw_wes_depth, 6) AS raw_wes_depth, round(pon_median, 6) AS pon_median_wgs, round(depth_scaled_ratio, 6) AS depth_scaled_ratio, round(pon_cv, 6) AS pon_cv, flag_high_cv, flag_zero_wes, flag_extreme_scaling, mask_rejected, round(log2_ratio, 6) AS log2_ratio'


@_registered(f"SELECT {_SHARED} FROM track_a")
def track_a(spark, d):
    return _rounded(_track_a(spark, d))


@_registered(f"SELECT {_SHARED}, flag_pon_variance FROM track_b")
def track_b(spark, d):
    return _rounded(_track_b(spark, d))


@_registered("SELECT sample, count(*) AS windows, count(*) FILTER (mask_rejected = 0) AS usable, sum(flag_high_cv)::BIGINT AS flag_high_cv, sum(flag_zero_wes)::BIGINT AS flag_zero_wes, sum(flag_extreme_scaling)::BIGINT AS flag_extreme_scaling, sum(flag_pon_variance)::BIGINT AS flag_pon_variance, sum(mask_rejected)::BIGINT AS mask_rejected FROM track_b GROUP BY sample")
def usable_summary(spark, d):
    return scaling.usable_summary(_track_b(spark, d))


# --- reads


@_registered('SELECT chrom, start, "end", round(own_scale, 6) AS own_scale FROM scales')
def condition_scale(spark, d):
    return _rounded(_scales(spark, d))


@_registered("SELECT sample, qname, ord, round(own_scale, 6) AS own_scale FROM looked")
def point_lookup(spark, d):
    reads = upscale.with_own_scale(_reads(spark, d).where(~upscale.passes_through()), _scales(spark, d))
    return _rounded(reads.select(*_KEYS, "ord", "own_scale"))


@_registered("SELECT sample, qname, ord, pair_no, nth, complete FROM paired")
def pair_mates(spark, d):
    pairs = upscale.paired(_reads(spark, d).where(~upscale.passes_through()), _KEYS)
    return pairs.select(*_KEYS, "ord", F.col("pair_no").cast("long"), F.col("nth").cast("long"), "complete")


@_registered("SELECT sample, qname, ord, round(scale, 6) AS scale, CASE WHEN complete THEN CAST(mate AS INT) ELSE 0 END AS mate FROM scaled")
def pair_scale(spark, d):
    return _rounded(_scaled(spark, d).select(*_KEYS, "ord", "scale", F.coalesce("mate", F.lit(0)).alias("mate")))


@_registered("SELECT sample, qname, ord, copies FROM copied")
def copy_count(spark, d):
    return _scaled(spark, d).where("complete").select(*_KEYS, "ord", upscale.copy_count("scale", F.concat_ws(":", *_KEYS, "pair_no")).alias("copies"))


@_registered("SELECT sample, qname, flag, chrom, pos, ord, copy, mate FROM output WHERE kind = 'pair'")
def replicate_pairs(spark, d):
    return _output(spark, d, "pair").select(*_KEYS, "flag", "chrom", "pos", "ord", "copy", "mate")


@_registered("SELECT sample, qname, flag, chrom, pos, ord FROM output WHERE kind = 'passthrough'")
def passthrough(spark, d):
    return _output(spark, d, "passthrough").select(*_KEYS, "flag", "chrom", "pos", "ord")


@_registered("SELECT sample, qname, flag, chrom, pos, ord FROM output WHERE kind = 'orphan'")
def orphans(spark, d):
    return _output(spark, d, "orphan").select(*_KEYS, "flag", "chrom", "pos", "ord")


@_registered("SELECT count(*) FILTER (copy = 0) AS processed, count(*) FILTER (copy = 0) AS kept_reads, count(*) FILTER (copy > 0) AS duplicated_reads FROM output")
def upscale_stats(spark, d):
    return upscale.upscale_stats(_output(spark, d))


@_registered("SELECT kind, sample, qname, flag, chrom, pos, ord, copy FROM output ORDER BY chrom, pos, ord, copy")
def coordinate_sort(spark, d):
    return upscale.coordinate_sorted(_output(spark, d), partitions_of(spark, _n_reads(spark, d), RANGE_READS)).select("kind", *_KEYS, "flag", "chrom", "pos", "ord", "copy")


@_registered("SELECT kind, sample, qname, flag, chrom, pos, ord, copy, mate FROM streamed")
def stream_upscale(spark, d):
    """The reads as a stream in two deliveries, so that pairs reach over a restart; what waits at the end comes from the state. Nothing is evicted."""
    scales, n = _scales(spark, d), _n_reads(spark, d)
    with partitions_for(spark, n, RANGE_READS):
        reads, folder = reused(_reads(spark, d)), new_folder(spark, "stream")
        spark.createDataFrame([], reads.schema).write.parquet(f"{folder}/in")
        stream = spark.readStream.schema(reads.schema).parquet(f"{folder}/in")
        out = upscaled_stream(stream, scales, _KEYS, limit=1 << 60, buckets=max(32, -(-n // BUCKET_READS)))
        for part in ("ord <= 3", "ord > 3"):
            reads.where(part).write.mode("append").parquet(f"{folder}/in")
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    both = spark.read.schema(out.schema).parquet(f"{folder}/out").unionByName(remaining(spark, f"{folder}/state", reads.schema))
    return both.select("kind", *_KEYS, "flag", "chrom", "pos", "ord", "copy", "mate")


# --- names


@_registered("SELECT p_partkey, split_part(p_name, ' ', 1) AS sample, 'S' || p_partkey AS track_sample FROM part")
def sample_names(spark, d):
    rows = fx.table(spark, d, "part").withColumn("path", F.concat(F.lit("/data/x.y/"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".sorted.bam")))
    track = F.concat(F.lit("/out/S"), F.col("p_partkey").cast("string"), F.lit("_off_target_copy_ratios.tsv"))
    return rows.select("p_partkey", sample_name("path").alias("sample"), track_sample_name(track).alias("track_sample"))


@_registered("""SELECT p_partkey, chrom, NOT regexp_matches(chrom, '^(chrX|chrY|chrM|X|Y|MT)') AS is_auto
    FROM (SELECT p_partkey, (['chr', 'chrX', 'X', 'MT', 'M', 'chrMT', 'Y', ''])[p_partkey % 8 + 1] || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey % 25 AS VARCHAR) END AS chrom FROM part)""")
def autosome_names(spark, d):
    kinds = F.array(*map(F.lit, ("chr", "chrX", "X", "MT", "M", "chrMT", "Y", "")))
    number = F.when(F.expr("p_partkey % 3 = 0"), "").otherwise(F.expr("cast(p_partkey % 25 as string)"))
    rows = fx.table(spark, d, "part").select("p_partkey", F.concat(F.element_at(kinds, F.expr("cast(p_partkey % 8 + 1 as int)")), number).alias("chrom"))
    return rows.withColumn("is_auto", is_autosome("chrom"))
