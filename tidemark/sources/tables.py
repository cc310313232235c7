"""Tab-separated tables: intervals, chromosome sizes, depth regions, matrix, panel and copy-ratio tracks.

Missing numbers are blank or nan in files, and null in tables. gz files are read as they are (each by one task).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null, sample_name, track_sample_name
from ..operators.matrix import META, pivoted, unpivoted
from ..operators.scaling import COLUMNS_A, COLUMNS_B
from .parts import Whole, assemble

PANEL = "window_id string, chrom string, start long, end long, gc_pct double, pon_median double, pon_variance double, is_high_variance int"
_NUMBERS = {"nanValue": "nan", "positiveInf": "inf", "negativeInf": "-inf"}
_TYPES = {"sample": "string", "window_id": "string", "chrom": "string", "start": "long", "end": "long", "mask_rejected": "int"}
TRACK_SUFFIX = "_off_target_copy_ratios.tsv"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in order."""
    fs, p = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))


def _lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The file's first columns by place; missing ones are null. Blank, comment, track and browser lines are left out."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser|\\s*$)"))
    return rows.select(*[F.try_element_at(parts, F.lit(k + 1)).alias(c) for k, c in enumerate(columns)])


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name (null without a fourth column)."""
    return _lines(spark, path, ["chrom", "start", "end", "name"]).withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"no chromosome sizes at {path}")
    return _lines(spark, path, ["chrom", "size"]).withColumn("size", F.col("size").cast("long"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Depth regions of one file or many: chrom, start, end, name, depth, sample.

    Lines have five columns, or four without a name; then the name is made from the place.
    """
    parts = F.split("value", "\t")
    last = F.element_at(parts, -1)
    name = F.when(F.size(parts) >= 5, F.element_at(parts, 4)).otherwise(F.concat(parts[0], F.lit(":"), parts[1], F.lit("-"), parts[2]))
    rows = spark.read.text(path).where("value <> ''").select(parts[0].alias("chrom"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("end"), name.alias("name"), nan_to_null(last.cast("double")).alias("depth"), sample_name(F.regexp_replace(F.input_file_name(), "_mosdepth\\.regions\\.bed\\.gz$", "")).alias("sample"))
    return rows


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Long: window_id, chrom, start, end, gc_pct, sample, depth. Columns that aren't meta are samples."""
    header = spark.read.text(path).first()[0].split("\t")
    header[0] = header[0] or "window_id"
    kinds = {"window_id": T.StringType(), "chrom": T.StringType(), "start": T.LongType(), "end": T.LongType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in header])
    wide = spark.read.options(sep="\t", header=True, enforceSchema=True, **_NUMBERS).schema(schema).csv(path)
    return unpivoted(wide.select(*[nan_to_null(c).alias(c) if t == "double" else F.col(c) for c, t in wide.dtypes]))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.options(sep="\t", header=True, enforceSchema=True, **_NUMBERS).schema(PANEL).csv(path)
    return rows.select(*[nan_to_null(c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """A copy-ratio track with sample; a file that isn't there gives an empty table (all scales are then 1)."""
    def kind(c: str) -> str:
        return _TYPES.get(c, "int" if c.startswith("flag_") else "double")

    if not exists(spark, path) and not listed(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` {kind(c)}" for c in COLUMNS_B))
    header = spark.read.text(path).first()[0].split("\t")
    rows = spark.read.options(sep="\t", header=True, enforceSchema=True, **_NUMBERS).schema(", ".join(f"`{c}` {kind(c)}" for c in header)).csv(path)
    own = rows.select(*[nan_to_null(c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])
    return own if "sample" in header else own.withColumn("sample", track_sample_name(F.input_file_name()))


def alignment_files(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("bam",)) -> DataFrame:
    """path, sample of the folder's alignment files, in order of path. Two files of one sample are an error, and so is a CRAM file where none can be read."""
    if "cram" not in kinds and (left_out := listed(spark, f"{folder}/*.cram")):
        raise ValueError(f"CRAM files can't be read, and their samples would be missing: {', '.join(left_out)}")
    paths = [p for kind in kinds for p in listed(spark, f"{folder}/*.{kind}")]
    if not paths:
        raise FileNotFoundError(f"no alignment files in {folder}")
    names = [p.rsplit("/", 1)[-1].split(".")[0] for p in paths]
    if len(set(names)) < len(names):
        raise ValueError("two alignment files of one sample")
    return spark.createDataFrame(sorted(zip(paths, names, strict=True)), "path string, sample string")


def resolved_files(samples: DataFrame, files: DataFrame) -> DataFrame:
    """sample and path: the file named sample.bam, else the first whose name starts with the sample; null if there is none."""
    # Samples and files meet by every prefix of the file's name, in an equi-join.
    name = F.element_at(F.split("path", "/"), -1)
    f = files.select("path", name.alias("file")).where(F.col("file").endswith(".bam"))
    prefixes = f.withColumn("sample", F.explode(F.transform(F.sequence(F.lit(1), F.length("file")), lambda n: F.col("file").substr(F.lit(1), n))))
    pairs = samples.select("sample").join(prefixes, "sample", "left")
    order = Window.partitionBy("sample").orderBy((F.col("file") == F.concat("sample", F.lit(".bam"))).desc_nulls_last(), "path")
    return pairs.withColumn("n", F.row_number().over(order)).where("n = 1").select("sample", "path")


# --- writers


def _text(c: str, kind: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if kind != "double" else F.coalesce(F.when(F.isnan(F.col(f"`{c}`")), "").otherwise(F.col(f"`{c}`").cast("string")), F.lit(""))


def _line(df: DataFrame) -> Column:
    return F.concat_ws("\t", *[_text(c, t) for c, t in df.dtypes])


def _header(columns: list[str]) -> bytes:
    return ("\t".join(columns) + "\n").encode()


def _parts(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """A folder's part files, in their order, with their sizes."""
    fs, p = _path(spark, f"{folder}/part-*")
    return sorted((s.getPath().toString(), s.getLen()) for s in (fs.globStatus(p) or []))


def _plain(spark: SparkSession, path: str) -> str:
    """A path as pyarrow's file systems take it."""
    fs, p = _path(spark, path)
    return fs.makeQualified(p).toString()


def _delete(spark: SparkSession, folder: str) -> None:
    fs, p = _path(spark, folder)
    fs.delete(p, True)


def write_lines(df: DataFrame, path: str, header: bool = True, order: list[str] | None = None) -> None:
    """One file at path, under exactly that name, in order; for what a person or tool opens. Ranges are sorted and written by tasks of their own."""
    spark, folder = df.sparkSession, f"{path}.parts-{uuid.uuid4().hex}"
    lines = df.orderBy(*order) if order else df
    lines.select(_line(df).alias("value")).write.option("lineSep", "\n").text(folder)
    assemble(spark, [Whole(_plain(spark, path), _header(df.columns) if header else b"", _parts(spark, folder))])
    _delete(spark, folder)


def write_by_sample(df: DataFrame, paths: dict[str, str], order: list[str]) -> None:
    """A file with a header for each sample, its rows in order, without the column sample: all samples in one job, and their files in another.

    Rows are dealt by ranges of sample and order, so that a large sample takes many tasks. paths: sample -> path, of all samples.
    """
    if not paths:
        return
    spark, columns = df.sparkSession, [c for c in df.columns if c != "sample"]
    folder = f"{next(iter(paths.values()))}.parts-{uuid.uuid4().hex}"
    numbers = {s: k for k, s in enumerate(sorted(paths))}
    known = spark.createDataFrame(list(numbers.items()), "sample string, number int")
    rows = df.join(known, "sample").repartitionByRange("number", *order).sortWithinPartitions("number", *order)
    rows.select("number", _line(df.select(columns)).alias("value")).write.partitionBy("number").option("lineSep", "\n").text(folder)
    assemble(spark, [Whole(_plain(spark, paths[s]), _header(columns), _parts(spark, f"{folder}/number={k}")) for s, k in numbers.items()])
    _delete(spark, folder)


def write_bed(windows: DataFrame, path: str) -> None:
    write_lines(windows.select("chrom", "start", "end", "name"), path, header=False, order=["chrom", "start", "end"])


def write_matrix(rows: DataFrame, path: str, samples: list[str], value: str = "centred") -> None:
    write_lines(pivoted(rows, samples, value, META), path, order=["chrom", "start", "end"])


def write_panel(panel: DataFrame, path: str) -> None:
    write_lines(panel, path, order=["chrom", "start", "end"])


def write_tracks(track: DataFrame, folder: str, single_files: bool = True) -> None:
    """A file for each sample under its usual name; or one table partitioned by sample."""
    columns = [c for c in (COLUMNS_B if "flag_pon_variance" in track.columns else COLUMNS_A) if c != "sample"]
    if not single_files:
        track.select("sample", *columns).write.mode("overwrite").partitionBy("sample").option("sep", "\t").option("header", True).csv(folder)
        return
    samples = [r[0] for r in track.select("sample").distinct().collect()]
    write_by_sample(track.select("sample", *columns), {s: f"{folder}/{s}{TRACK_SUFFIX}" for s in samples}, ["chrom", "start", "end"])
