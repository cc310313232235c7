"""Shared helpers: scratch tables in the cluster's shared folder, skew-safe group joins, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A group of at least this share of all rows is hot: at most this many such groups can exist.
HOT_GROUPS = 1000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one of our own only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "tidemark-scratch")
        os.makedirs(root, exist_ok=True)
        root = f"file://{root}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows of df, written to the shared folder (in a folder for each value of by) and read back: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is stored meanwhile gives the disk of its exchanges back when it is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group, of which none is dealt to one task.

    A group with over total / HOT_GROUPS of the rows is hot. There are fewer than HOT_GROUPS of those, so that
    they can be broadcast; the rows of all others are joined by a shuffle, in which no key can be large.
    groups must be stored (it is read twice).
    """
    limit = max(total // HOT_GROUPS, 1000)
    if total <= limit:
        return rows.join(groups, keys)
    hot, cold = groups.where(F.col(count) > limit), groups.where(F.col(count) <= limit)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts reach Python in batches of no more rows than this, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def shared_file(uri: str):
    """The file system and path behind a URI in the shared folder, for Python on the executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
