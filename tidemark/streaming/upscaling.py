"""Replication of read pairs over a stream: the streaming form of operators.upscale, with bounded waiting.

A read's scale is looked up in a static track as it comes. Names are dealt to buckets by their hash, and a bucket's state is the list of
records that wait for their mate, in order of arrival. A name's second record completes a pair, which is given out with its
copies at once. Waiting is bounded in two ways, both by giving the records that wait longest out as orphans, unscaled: when more than
limit / buckets wait in a bucket, evict / buckets go (with one bucket that is a cache of limit records); and what waits longer than the timeout goes
by a timer. A mate that comes later waits anew. Records that still wait when a stream has ended are its state: remaining() reads them from the
checkpoint. So every record comes out once with copy 0: kept = processed.

Where nothing is evicted, a stream that brings each name's records in order gives the rows of upscaled(..., draw="ord").

reads need ord, a number that orders a name's records. Records travel as text, in which every value keeps its type and nulls. A name's records, however many, are one
bucket's; at most one of them waits. Null names are one name. An empty stream gives nothing. A track without windows scales by 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.columns import has_bits
from ..functions.reuse import reused
from ..operators.intervals import looked_up, packed_bins
from ..operators.upscale import FIRST, copies_of, passes_through
from ..params import DEFAULT

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING = "name string, ord long, first boolean, scale double, record string, since long"
GIVEN = "record string, kind string, mate int, scale double, first_ord long"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class MateCache(StatefulProcessor):
    """The waiting records of one bucket."""

    def __init__(self, limit: int, evict: int, timeout_ms: int | None):
        self.limit, self.evict, self.timeout_ms = limit, evict, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getListState("waiting", WAITING)

    def _load(self) -> dict[str, tuple]:
        """By name, in order of arrival; a name waits with one record at most."""
        return {row[0]: tuple(row) for row in self.state.get()} if self.state.exists() else {}

    def _store(self, waiting: dict[str, tuple]) -> None:
        if waiting:
            self.state.put(list(waiting.values()))
        else:
            self.state.clear()
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if waiting:
                self.handle.registerTimer(next(iter(waiting.values()))[5] + self.timeout_ms)

    @staticmethod
    def _orphan(row: tuple) -> tuple:
        return row[4], "orphan", 0, 1.0, row[1]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.timeout_ms is not None else 0
        waiting, out = self._load(), []
        batch = pd.concat(rows)
        out += [(record, "passthrough", 0, 1.0, 0) for record in batch.loc[batch["aside"], "record"]]
        batch = batch[~batch["aside"]].sort_values(["ord", "name"], kind="stable")
        for row in zip(batch["name"], batch["ord"].tolist(), batch["first"].tolist(), batch["scale"].tolist(), batch["record"], strict=True):
            if (mate := waiting.pop(row[0], None)) is None:
                waiting[row[0]] = (*row, now)
            else:
                scale, later_first = (mate[3] + row[3]) / 2, row[2]
                out += [(mate[4], "pair", 2 if later_first else 1, scale, mate[1]), (row[4], "pair", 1 if later_first else 2, scale, mate[1])]
            if len(waiting) > self.limit:
                out += [self._orphan(waiting.pop(name)) for name in list(waiting)[: self.evict]]
        self._store(waiting)
        yield _given(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, until = self._load(), expiredTimerInfo.getExpiryTimeInMs() - self.timeout_ms
        late = [name for name, row in waiting.items() if row[5] <= until]
        out = [self._orphan(waiting.pop(name)) for name in late]
        self._store(waiting)
        yield _given(out)

    def close(self) -> None:
        pass


def _given(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in GIVEN.split(", ")]).astype({"mate": "int32", "scale": "float64", "first_ord": "int64"})


def _record(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), _JSON)


def _unpacked(given: DataFrame, schema: StructType) -> DataFrame:
    """The records with kind, mate, scale and first_ord."""
    own = given.select(F.from_json("record", schema, _JSON).alias("r"), F.col("kind").alias("kind_"), F.col("mate").alias("mate_"), F.col("scale").alias("scale_"), F.col("first_ord").alias("first_"))
    return own.select("r.*", F.col("kind_").alias("kind"), F.when(F.col("mate_") > 0, F.col("mate_")).alias("mate"), F.col("scale_").alias("scale"), F.col("first_").alias("first_ord"))


def upscaled_stream(reads: DataFrame, track: DataFrame, keys: list[str] | None = None, seed: int = DEFAULT.seed, limit: int = DEFAULT.cache_limit, evict: int = DEFAULT.evict, timeout_ms: int | None = None, buckets: int = 32) -> DataFrame:
    """Output records of a stream of reads: reads' columns with kind, copy and mate. track: chrom, start, end, own_scale.

    limit, evict: records that wait in all buckets together, and how many go when there are more. timeout_ms: processing time; None: no timer.
    """
    spark, keys = reads.sparkSession, keys or ["qname"]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the one that lists and timers need
    schema, columns = reads.schema, reads.columns
    bins = reused(packed_bins(track, "own_scale"))
    name = F.to_json(F.struct(*keys))
    aside, order = passes_through(), F.col("ord").cast("long")
    # What passes through waits for nothing: it goes to any bucket, so that the stream is read once.
    bucket = F.pmod(F.when(aside, F.xxhash64(name, order)).otherwise(F.xxhash64(name)), F.lit(buckets))
    rows = looked_up(reads, bins, "own_scale", 1.0).select(bucket.alias("bucket"), name.alias("name"), F.coalesce(order, F.lit(0)).alias("ord"), has_bits("flag", FIRST).alias("first"), F.col("own_scale").alias("scale"), _record(columns).alias("record"), aside.alias("aside"))
    cache = MateCache(max(1, limit // buckets), max(1, evict // buckets), timeout_ms)
    given = rows.groupBy("bucket").transformWithStateInPandas(cache, GIVEN, "Append", "None" if timeout_ms is None else "ProcessingTime")
    return copies_of(_unpacked(given, schema), F.concat_ws(":", *keys, "first_ord"), seed).select(*columns, "kind", "copy", "mate")


def remaining(spark: SparkSession, checkpoint: str, schema: StructType) -> DataFrame:
    """The records that still wait in a stopped stream's checkpoint, as orphans. schema: that of its reads."""
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint).select("list_element.*")
    given = state.select("record", F.lit("orphan").alias("kind"), F.lit(0).alias("mate"), F.lit(1.0).alias("scale"), F.col("ord").alias("first_ord"))
    return _unpacked(given, schema).withColumn("copy", F.lit(0)).select(*schema.names, "kind", "copy", "mate")
