"""Counts of a step's stages, seen while the step's own job runs."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .reuse import reused


class Counts:
    """Stages by name, each with the number of its rows and any sums asked for.

    watch() observes a stage where it stands in a plan; stored() also computes it, once. What is watched must be computed by one job that
    reads it once: below a range exchange, whose sampling reads it too, a stage would count twice, so that stored() comes first there.
    """

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, name: str, **sums: Column) -> DataFrame:
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(k) for k, c in sums.items()])

    def stored(self, df: DataFrame, name: str, **sums: Column) -> DataFrame:
        return reused(self.watch(df, name, **sums))

    def get(self) -> dict[str, dict[str, int]]:
        """All counts, when the jobs are done."""
        return {name: {k: v or 0 for k, v in o.get.items()} for name, o in self.seen.items()}

    def report(self, step: str) -> None:
        for name, found in self.get().items():
            print(f"{step}: {name}: " + ", ".join(f"{v} {k}" for k, v in found.items()), file=sys.stderr)
