"""Connected components of a graph of longs, spread over the cluster.

Each partition of edges first becomes a forest of stars by union-find. While these hold more than TASK_EDGES edges, large-star and
small-star steps alternate, each written to the shared folder, until nothing changes: every node then has one edge, to the smallest
node of its component. No more edges than that are joined by union-find in one task, whose memory they bound, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored

TASK_EDGES = 1 << 18


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The smallest member of the component for each node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    roots = union_find((a, b) for batch in batches for a, b in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True))
    pairs = [(u, v) for u, v in roots.items() if u != v]
    yield pd.DataFrame(pairs, columns=["u", "v"], dtype="int64")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """edges: u, v. The result, stored: u, v, where v is the smallest node of u's component; nodes that are that themselves are left out."""
    now = stored(edges.where("u <> v").mapInPandas(_local, "u long, v long"), "stars")
    if now.count() <= task_edges:
        after = stored(now.coalesce(1).mapInPandas(_local, "u long, v long"), "stars")
        drop(now)
        return after
    state = None
    while True:
        after = stored(_small_star(_large_star(now)), "stars")
        drop(now)
        now, before = after, state
        # A change moves some node to a smaller one, which the sum shows.
        row = now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        state = tuple(row)
        if state[0] == 0 or state == before:
            return now
