"""The package's code for Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Have Spark send the package to its executors, unless they find it by PYTHONPATH or the working folder."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if any(Path(p).resolve() == ROOT for p in [*paths, os.getcwd()]) or spark.sparkContext.applicationId in _SHIPPED:
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    folder = tempfile.mkdtemp(prefix="tidemark-code-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tidemark", "zip", ROOT, "tidemark"))
