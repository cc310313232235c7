"""Exact quantiles of large groups, without any group in one buffer.

The range of a group's values is cut into buckets, which partial aggregation counts; the bucket with the rank sought becomes the range, and so on, until
few enough values are left to be put in order. Each round is a pass over the rows, and keeps a row for each group on the driver: for few groups, however
large (a sample's windows, all windows). Many small groups are better served by Spark's own percentile.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a round, and values of a group that are put in order.
BUCKETS, ENOUGH = 4096, 1 << 16


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, q: float, name: str, enough: int = ENOUGH, buckets: int = BUCKETS) -> DataFrame:
    """keys and the quantile, interpolated between the two ranks next to it; nulls and NaN are ignored, and a group without values has no row.

    rows should be stored: they are read two or three times. Infinite values are an error.
    """
    spark, names = rows.sparkSession, [f"k{j}" for j in range(len(keys))]
    own = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    kinds = {n: dict(rows.dtypes)[k] for k, n in zip(keys, names, strict=True)}
    columns = ", ".join([*(f"{n} {t}" for n, t in kinds.items()), "lo double, hi double, r0 long, r1 long"])
    # Of each group: its range, how many values lie below it and in it, and the ranks sought.
    spans, done = {}, {}
    for row in own.groupBy(*names).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).collect():
        if row["n"]:
            at = q * (row["n"] - 1)
            spans[tuple(row[n] for n in names)] = [row["lo"], row["hi"], 0, row["n"], math.floor(at), math.ceil(at), at]
    if any(math.isinf(x) for lo, hi, *_ in spans.values() for x in (lo, hi)):
        raise ValueError(f"infinite values of {value}")

    def finish(key: tuple, low: float, high: float) -> None:
        _, _, _, _, r0, _, at = spans.pop(key)
        done[key] = low if low == high else (1 - (at - r0)) * low + (at - r0) * high

    def within(some: dict) -> DataFrame:
        table = spark.createDataFrame([(*k, lo, hi, r0 - below, r1 - below) for k, (lo, hi, below, _, r0, r1, _) in some.items()], columns)
        other = table.toDF(*[f"{n}_" for n in names], "lo", "hi", "r0", "r1")
        same = [own[n].eqNullSafe(other[f"{n}_"]) for n in names]
        return (own.join(F.broadcast(other), same) if same else own.crossJoin(F.broadcast(other))).where("v between lo and hi")

    while spans:
        for key in [k for k, s in spans.items() if s[0] == s[1]]:
            finish(key, spans[key][0], spans[key][0])
        small = {k: s for k, s in spans.items() if s[3] <= enough}
        if small:
            ranks = within(small).groupBy(*names).agg(F.sort_array(F.collect_list("v")).alias("all"), F.first("r0").alias("r0"), F.first("r1").alias("r1"))
            for row in ranks.select(*names, F.get("all", F.col("r0").cast("int")).alias("low"), F.get("all", F.col("r1").cast("int")).alias("high")).collect():
                finish(tuple(row[n] for n in names), row["low"], row["high"])
        if spans:
            part = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets)
            counted = within(spans).groupBy(*names, F.least(part, F.lit(buckets - 1)).alias("b")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("r0").alias("r0"), F.first("r1").alias("r1"))
            upto = F.sum("n").over(Window.partitionBy(*names).orderBy("b"))
            hit = counted.withColumn("upto", upto).where("(upto - n <= r0 and r0 < upto) or (upto - n <= r1 and r1 < upto)")
            found: dict[tuple, list] = {}
            for row in hit.collect():  # two rows at most for each group
                found.setdefault(tuple(row[n] for n in names), []).append(row)
            for key, rows_ in found.items():
                first, last = min(rows_, key=lambda r: r["b"]), max(rows_, key=lambda r: r["b"])
                if first["b"] != last["b"]:
                    finish(key, first["high"], last["low"])
                else:
                    spans[key][:4] = first["low"], first["high"], spans[key][2] + first["upto"] - first["n"], first["n"]
    schema = ", ".join([*(f"`{k}` {kinds[n]}" for k, n in zip(keys, names, strict=True)), f"`{name}` double"])
    return spark.createDataFrame([(*k, v) for k, v in done.items()], schema)
