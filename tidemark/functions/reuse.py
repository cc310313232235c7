"""Tables that a plan reads more than once."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named by spark.checkpoint.dir; a local one of our own only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local["):
        root = f"file://{os.path.join(tempfile.gettempdir(), 'tidemark-scratch')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; on a cluster without one this is an error, as what executors keep themselves is lost with them."""
    if (root := shared_folder(spark)) is None:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of input for each shuffle partition at most, and the size to which small partitions of a large input are put together: so few that what a task sorts
#: and adds up stays within the first page (64 MB) of each sort or hash table on any input.
TASK_ROWS, TASK_BYTES = 200_000, "4m"
#: Limits of stored tables, where the session's are higher: tables of windows grow with the input, and a broadcast one would be in each task's memory, many times as
#: large as its file; with more than 200 partitions a task sorts all rows of its split.
BOUNDS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES, "spark.sql.autoBroadcastJoinThreshold": "256k", "spark.sql.files.maxPartitionBytes": "32m"}


def partitions_of(spark: SparkSession, rows: int, task_rows: int | None = None) -> int:
    """The session's shuffle partitions, or one for each task_rows (TASK_ROWS) rows if these are more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (task_rows or TASK_ROWS)))


@contextmanager
def partitions_for(spark: SparkSession, rows: int, task_rows: int | None = None) -> Iterator[None]:
    """What runs meanwhile (tables that are stored, streams) has a shuffle partition for each task_rows (TASK_ROWS) rows at least, small ones are put together up to
    TASK_BYTES at most, however few rows there are, and the session's BOUNDS hold: with many partitions tasks would grow with the input up to the session's size. So a
    task's memory doesn't grow with the input.
    """
    wanted = {"spark.sql.shuffle.partitions": str(partitions_of(spark, rows, task_rows))}
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in BOUNDS.items():
        own = spark.conf.get(key)
        if not own.startswith("-") and in_bytes(own) > in_bytes(most):  # -1: no broadcast at all
            wanted[key] = most
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Folders of stored tables that are still there.
_STORED: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete all tables that this process has stored, when nothing will read them again; how many there were."""
    n = len(_STORED)
    while _STORED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def reused(df: DataFrame) -> DataFrame:
    """df, computed once: written to the shared folder and read back, which also cuts its lineage short. release() deletes what was written."""
    if getattr(df, "_reused", False):
        return df
    spark = df.sparkSession
    path = new_folder(spark, "table")
    _STORED.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._reused = True
    return out
