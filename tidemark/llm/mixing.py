"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed by source; targets share a budget by weight, and a target above max_repeat times its source's size
gives its excess to the others by weight, until none is above. That is water-filling: with the sources in
order of cap / weight, a prefix gets its caps and the rest share what is left, which running sums find in one pass. A
source's rate is target / size. Each document is taken floor(rate) times, plus once more if a uniform number
hashed from its id and the seed is below the fraction: reruns agree, and rows need no order and no shuffle. Each of DRAWS fixed draws gives such a
number; a source takes that draw, for all its documents, by which its words come nearest to its target.

Null texts have size 0, very long ones are counted whole; a null source is a source of its own, last in order. Rows that repeat an id draw the same number.
A source without words has target 0 and takes none of its documents' (zero) words. An empty table gives no rows. Extra columns are carried along, whatever
their names; with_copies() replaces those that are named like its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_GROUPS, stored, table, text_of

SHARE = 1.5
MAX_REPEAT = 2
WEIGHTS = (3, 1, 2)
SEED = 42
#: Draws that a source's documents choose from, all from one hash of a document's id.
DRAWS = 20
#: Up to so many sources, their rates are broadcast; beyond it, hot sources are, and the others are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def word_count(column: str = "text") -> Column:
    """Number of words, null: 0."""
    return F.regexp_count(text_of(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, source_col: str = "source") -> DataFrame:
    """source, docs, source_size, target. sizes: source and size of each document. Its windows see one row per source."""
    by_source = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = by_source.withColumn("k", F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * float(max_repeat))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    levels = weighted.withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * share)
    levels = levels.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The level at which the water stands: that of the first source whose cap is not below its share.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("k"), F.col("level").alias("at")))
    final = levels.withColumn("water", F.min(fits).over(Window.partitionBy())["at"])
    return final.select(source_col, "docs", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def uniform(id_col: str, seed: int, draw: int | Column = 0) -> Column:
    """In [0, 1), from 52 bits of the MD5 of id and seed: those that start at its hex digit number draw (0 to DRAWS - 1)."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    at = (draw if isinstance(draw, Column) else F.lit(draw)) + 1
    return F.conv(F.substring(F.md5(key), at, F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def _joined(docs: DataFrame, targets: DataFrame, source_col: str) -> DataFrame:
    """docs with the columns of targets (one row per source, stored), null sources too; no source is dealt to one task."""
    right = targets.withColumnRenamed(source_col, "its_source")
    on = lambda left, r: left[source_col].eqNullSafe(r["its_source"])
    if targets.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(right), on(docs, right)).drop("its_source")
    limit = targets.agg(F.sum("docs")).first()[0] // HOT_GROUPS
    hot, cold = right.where(F.col("docs") > limit), right.where(F.col("docs") <= limit)
    names = F.broadcast(hot.select("its_source"))
    rest = docs.join(names, on(docs, names), "left_anti")
    return docs.join(F.broadcast(hot), on(docs, hot)).unionByName(rest.join(cold, on(rest, cold))).drop("its_source")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def with_draw(rows: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """targets with draw, stored: of DRAWS fixed draws the one by which the source's documents take nearest to its target (ties: the first).

    rows: id, source and size of each document. One pass, which adds up a sum for each draw and source.
    """
    part = _rate() - F.floor(_rate())
    sums = [F.sum(F.when(uniform("id", seed, k) < part, F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(DRAWS)]
    taken = stored(_joined(rows, targets, "source").groupBy("source").agg(*sums), "taken").withColumnRenamed("source", "its_source")
    whole = F.floor(_rate()) * F.col("source_size")
    best = F.array_min(F.array(*[F.struct(F.abs(whole + F.col(f"s{k}") - F.col("target")).alias("off"), F.lit(k).alias("draw")) for k in range(DRAWS)]))["draw"]
    return stored(targets.join(taken, targets["source"].eqNullSafe(taken["its_source"])).select(*targets.columns, best.alias("draw")), "draws")


def with_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """docs, which have a column size (words), with source_size, target and copies (how often the mix takes the row).

    Columns of docs that have one of these three names are replaced.
    """
    columns = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), "size")
    targets = stored(source_targets(rows.select("source", "size"), weights, share, max_repeat), "targets")
    joined = _joined(rows, with_draw(rows.select("id", "source", "size"), targets, seed), "source")
    copies = F.floor(_rate()) + (uniform("id", seed, F.col("draw")) < _rate() - F.floor(_rate())).cast("long")
    return joined.select("doc.*", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs, as often as it is taken."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    some = with_copies(packed, "id", "source", **options).where("copies > 0")
    return some.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size")), "sizes")
    return with_copies(sizes).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


OP2_SQL = """
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS k FROM sizes GROUP BY source),
weighted AS (
  SELECT *, CAST([3, 1, 2][(k - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighted)::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
water AS (SELECT level AS lvl FROM levels WHERE level * weight <= cap ORDER BY cap / weight, k LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT lvl FROM water) * weight, cap)) AS target FROM levels),
rates AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
draws AS (
  SELECT source, draw FROM (
    SELECT source, draw, row_number() OVER (PARTITION BY source ORDER BY abs(any_value(floor(rate)) * any_value(source_size)
             + sum(CASE WHEN CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':42'), draw + 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN size ELSE 0 END) - any_value(target)), draw) AS place
    FROM rates, (SELECT CAST(unnest(range(0, 20)) AS INT) AS draw) GROUP BY source, draw) WHERE place = 1),
drawn AS (
  SELECT r.*, CAST(floor(rate) AS BIGINT)
         + CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':42'), d.draw + 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) AS BIGINT) AS copies
  FROM rates r JOIN draws d ON r.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM drawn
"""
