"""Files: round trips, missing parts, streaming pairing, and the registry."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.sources import bam, tables
from tidemark.streaming.pairing import pair_stream

HEADER = "@HD\tVN:1.6\n@SQ\tSN:c\tLN:100000\n@SQ\tSN:d\tLN:5000\n"


def test_bed_and_sizes(spark, tmp_path):
    path = str(tmp_path / "a.bed")
    with open(path, "w") as f:
        f.write("#x\ntrack y\nc\t1\t5\n\nd\t2\t9\tn\textra\n")
    assert [tuple(r) for r in tables.read_bed(spark, path).orderBy("chrom").collect()] == [("c", 1, 5, None), ("d", 2, 9, "n")]
    with pytest.raises(FileNotFoundError):
        tables.read_sizes(spark, str(tmp_path / "none"))
    tables.write_bed(tables.read_bed(spark, path), str(tmp_path / "b.bed"))
    assert open(tmp_path / "b.bed").read() == "c\t1\t5\t\nd\t2\t9\tn\n"


def test_track_files(spark, tmp_path):
    assert tables.read_track(spark, str(tmp_path / "none.tsv")).count() == 0
    columns = tables.COLUMNS_B
    row = ("s1", "c:1-5", "c", 1, 5, 0.5, 1.0, 1.0, 2.0, 0.1, 0, 0, 0, 0, 0, None)
    df = spark.createDataFrame([row], "sample string, window_id string, chrom string, start long, end long, gc_pct double, raw_wes_depth double, pon_median_wgs double, depth_scaled_ratio double, pon_cv double, flag_high_cv int, flag_zero_wes int, flag_extreme_scaling int, flag_pon_variance int, mask_rejected int, log2_ratio double")
    tables.write_tracks(df, str(tmp_path / "out"))
    back = tables.read_track(spark, str(tmp_path / "out" / "s1_off_target_copy_ratios.tsv"))
    assert [tuple(r) for r in back.select(columns).collect()] == [row]


def test_bam_round_trip_and_index(spark, tmp_path):
    rows = [(f"q{k}", k % 4 * 64, "c" if k % 3 else "d", k * 7, k % 60, "3S5M1I2M", None, None, 0, "ACGTNACGTAC", "I" * 11, f"NM:i:{k}\tRG:Z:x\tXB:B:s,1,-2") for k in range(300)] + [("u", 4, None, None, 0, "*", None, None, 0, "*", "*", "")]
    schema = ", ".join(bam.SCHEMA.split(", ")[:-1])
    df = spark.createDataFrame(rows, schema).repartitionByRange(3, F.col("chrom").asc_nulls_last(), "pos").sortWithinPartitions(F.col("chrom").asc_nulls_last(), "pos")
    path = str(tmp_path / "a.bam")
    bam.write_bam(df, path, HEADER)
    back = bam.read_bam(spark, [path])
    assert sorted(map(str, (tuple(r) for r in back.drop("ord").collect()))) == sorted(map(str, rows))
    assert open(path + ".bai", "rb").read(4) == b"BAI\1"
    bam.write_bam(df.orderBy(F.col("pos").desc()), str(tmp_path / "b.bam"), HEADER, index=False)
    with pytest.raises(ValueError):
        bam.write_index(str(tmp_path / "b.bam"))
    back.orderBy("ord").coalesce(1).select(bam.sam_line()).write.text(str(tmp_path / "sam"))
    sam = bam.read_sam(spark, str(tmp_path / "sam"))
    assert sorted(map(str, (tuple(r) for r in sam.drop("ord").collect()))) == sorted(map(str, rows))


def test_fasta(spark, tmp_path):
    path = str(tmp_path / "a.fa")
    with open(path, "w") as f:
        f.write(">c one\nACGT\nAC\n>d\nGG\n")
    assert [tuple(r) for r in bam.read_fasta(spark, path, 4).orderBy("chrom", "start").collect()] == [("c", 0, "ACGT"), ("c", 4, "AC"), ("d", 0, "GG")]


def test_file_resolution(spark):
    files = spark.createDataFrame([("/x/s1.bam",), ("/x/s1.a.bam",), ("/x/s2.b.bam",), ("/x/s2.a.bam",)], "path string")
    samples = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample string")
    assert [tuple(r) for r in tables.resolved_files(samples, files).orderBy("sample").collect()] == [("s1", "/x/s1.bam"), ("s2", "/x/s2.a.bam"), ("s3", None)]


def test_stream_pairs(spark, tmp_path):
    spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("a", 3)], "qname string, ord long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qname string, ord long").parquet(str(tmp_path / "in"))
    q = pair_stream(stream, 3_600_000).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()
    q.awaitTermination(60)
    q.stop()
    assert [tuple(r) for r in spark.table("pairs").collect()] == [("a", 0, 2, "pair")]


@pytest.mark.parametrize("name", ["define_windows", "cigar_blocks", "pair_mates", "sample_names"])
def test_queries_equal_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "lineitem"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, d).toPandas()
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()[list(got.columns)]
    key = list(got.columns)
    assert got.sort_values(key).astype(str).reset_index(drop=True).equals(want.sort_values(key).astype(str).reset_index(drop=True))


def test_every_coverage_query_has_sql():
    from tidemark.plans import queries

    assert queries.QUERIES.keys() == queries.ORACLE_SQL.keys()
