"""Genomic tables derived from the test tables by integer formulas, so that any engine makes the same ones.

A genome is a set of five chromosomes of LENGTH for each hundred suppliers, so that targets, windows and reads' places grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LENGTH, SET = 500_000, 100
NORMALS, TUMOUR = ["s0", "s1", "s2"], "s3"
PAD = 1000
GC_CHUNK, GC_WINDOW = 1000, 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chrom(k: str | Column) -> Column:
    k = F.expr(k) if isinstance(k, str) else k
    return F.when(k == 0, F.lit("chrX")).otherwise(F.concat(F.lit("chr"), k.cast("string")))


def sets(spark: SparkSession, sf_dir: str) -> int:
    """How many sets of five chromosomes there are."""
    return max(1, -(-table(spark, sf_dir, "supplier").count() // SET))


def of_supplier(key: str, n: int) -> Column:
    """The chromosome that a supplier's key stands for."""
    return chrom(f"cast({key} % 5 + 5 * (({key} div {SET}) % {n}) as long)")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(5 * sets(spark, sf_dir)).select(chrom("id").alias("chrom"), F.lit(LENGTH).cast("long").alias("size"))


def _in_each_set(rows: DataFrame, n: int, key: str) -> DataFrame:
    """rows once for each set, with k, the number of the chromosome."""
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("k", F.expr(f"cast({key} % 5 + 5 * k as long)"))


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _in_each_set(table(spark, sf_dir, "nation"), sets(spark, sf_dir), "n_nationkey")
    return rows.select(chrom("k").alias("chrom"), F.expr("cast(n_nationkey div 5 as long) * 100000 + 500").alias("start"), F.expr("(cast(n_nationkey div 5 as long) + 1) * 100000").alias("end"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = f"(s_suppkey * 7919) % ({LENGTH} - 400)"
    return table(spark, sf_dir, "supplier").select(of_supplier("s_suppkey", sets(spark, sf_dir)).alias("chrom"), F.expr(start).alias("start"), F.expr(f"{start} + 120 + (s_suppkey % 7) * 30").alias("end"))


def centromeres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _in_each_set(table(spark, sf_dir, "region"), sets(spark, sf_dir), "r_regionkey")
    return rows.select(chrom("k").alias("chrom"), F.expr("200000 + 1000 * cast(r_regionkey as long)").alias("start"), F.expr("215000 + 1000 * cast(r_regionkey as long)").alias("end"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, qname, flag, chrom, pos, mapq, cigar, ord (order within the name)."""
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.expr(f"(l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % ({LENGTH} - 100)"))
    order = Window.partitionBy("l_orderkey").orderBy("pos", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    flag = F.expr("case when l_partkey % 13 = 0 then 1024 when l_partkey % 17 = 0 then 256 when l_partkey % 19 = 0 then 4 else 0 end + case when l_linenumber % 2 = 0 then 64 else 0 end")
    return rows.select(
        F.expr("concat('s', l_orderkey % 4)").alias("sample"), F.col("l_orderkey").cast("string").alias("qname"), flag.alias("flag"), of_supplier("l_suppkey", sets(spark, sf_dir)).alias("chrom"), "pos",
        F.expr("cast(l_partkey % 61 as int)").alias("mapq"), F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("M")).alias("cigar"), F.row_number().over(order).alias("ord"),
    )


def gc(start: str = "start", name: str = "chrom") -> Column:
    k = F.when(F.col(name) == "chrX", F.lit(0)).otherwise(F.substring(name, 4, 9).cast("long"))
    return ((3000 + (F.col(start) * 31 + k * 17) % 3067) / 10000.0).cast("double")


def on_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded targets as windows, with gc_pct."""
    padded = targets(spark, sf_dir).select("chrom", F.expr(f"greatest(start - {PAD}, 0)").alias("start"), F.expr(f"least(end + {PAD}, {LENGTH})").alias("end"))
    return padded.withColumn("window_id", F.expr("concat(chrom, ':', start, '-', end)")).withColumn("gc_pct", gc())


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as chromosomes, in chunks."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), "text")
    at = docs.select("chrom", "text", F.explode(F.expr(f"sequence(0L, length(text) - 1L, {GC_CHUNK}L)")).alias("start"))
    return at.select("chrom", "start", F.expr(f"substring(text, cast(start + 1 as int), {GC_CHUNK})").alias("seq"))


def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), F.length("text").cast("long").alias("n"))
    at = docs.select("chrom", "n", F.explode(F.expr(f"sequence(0L, n - 1, {GC_WINDOW}L)")).alias("start"))
    return at.select(F.expr(f"concat(chrom, ':', start, '-', least(start + {GC_WINDOW}, n))").alias("window_id"), "chrom", "start", F.expr(f"least(start + {GC_WINDOW}, n)").alias("end"))
