"""One file out of the parts that tasks have written, under exactly the name asked for."""

from __future__ import annotations

import itertools
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession


def open_path(path: str):
    from pyarrow import fs

    files, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return files, where


@dataclass
class Whole:
    """A file to be made: what it starts with, its parts in order with their sizes, and what it ends with."""

    path: str
    head: bytes
    parts: list[tuple[str, int]] = field(default_factory=list)
    tail: bytes = b""

    def starts(self) -> list[int]:
        return list(itertools.accumulate((size for _, size in self.parts), initial=len(self.head)))


def assemble(spark: SparkSession, wholes: list[Whole]) -> None:
    """Make the files, all in one job. No content passes through the driver.

    On a file system with plain files (a shared mount) each part is copied to its place by a task of its own, and the file gets its name when it is whole; a task
    that runs twice writes the same bytes to the same place. Elsewhere a file is streamed together by one task.
    """
    if not wholes:
        return
    if all(open_path(w.path)[0].type_name == "local" for w in wholes):
        made, rows = [], []
        for w in wholes:
            target = open_path(w.path)[1]
            os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
            made.append((f"{target}.{uuid.uuid4().hex}.whole", target))
            starts = w.starts()
            with open(made[-1][0], "wb") as out:
                out.write(w.head)
                out.seek(starts[-1])
                out.write(w.tail)
                out.truncate(starts[-1] + len(w.tail))
            rows += [(part, made[-1][0], start) for (part, size), start in zip(w.parts, starts, strict=False) if size]

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, into, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    with open(open_path(part)[1], "rb") as data, open(into, "r+b") as out:
                        out.seek(start)
                        shutil.copyfileobj(data, out, 1 << 20)
                yield batch

        if rows:
            schema = "part string, into string, start long"
            spark.createDataFrame(rows, schema).repartition(len(rows)).mapInArrow(copy, schema).write.format("noop").mode("overwrite").save()
        for temporary, target in made:
            os.replace(temporary, target)
        return

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                joined(wholes[k])
            yield batch

    spark.range(len(wholes)).repartition(len(wholes)).mapInArrow(stream, "id long").write.format("noop").mode("overwrite").save()


def joined(whole: Whole) -> None:
    """Stream the parts together in this process."""
    files, where = open_path(whole.path)
    with files.open_output_stream(where, compression=None) as out:
        out.write(whole.head)
        for part, _ in whole.parts:
            source, at = open_path(part)
            with source.open_input_stream(at, compression=None) as data:
                while piece := data.read(1 << 20):
                    out.write(piece)
        out.write(whole.tail)
