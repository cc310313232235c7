"""Sequences from FASTA files, read in byte ranges that may start inside a sequence.

A first pass counts, for each range, the bases before its first header and those behind its last one; so each range knows which sequence it starts in, and where in
it. A second pass gives the bases. A header belongs to the range in which its line starts. Compressed files are read by one task each.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .parts import open_path

#: Bytes of a file for a task, and of a header's line at most.
SPLIT, LONGEST_HEADER = 32 << 20, 1 << 16
BUFFER = 1 << 20
SCHEMA = "chrom string, start long, seq string"


def _pieces(path: str, start: int, end: int) -> Iterator[tuple[str | None, bytes]]:
    """What the range has, in order: (name, b"") for a header, (None, bases)."""
    files, where = open_path(path)
    if where.endswith(".gz"):
        with files.open_input_stream(where, compression=None) as raw, gzip.open(raw) as data:
            yield from _parsed(data, 1 << 62, True, False)
        return
    with files.open_input_file(where) as data:
        look = max(0, start - LONGEST_HEADER)
        data.seek(look)
        line = data.read(start - look).rpartition(b"\n")[2] if start else b""
        # Inside a line: of a header, which is another range's, or of bases. (A line longer than a header can be is one of bases.)
        inside = line.startswith(b">") and (look == 0 or len(line) < start - look)
        data.seek(start)
        yield from _parsed(data, end - start, not line, inside)


def _parsed(data, left: int, line_start: bool, in_header: bool) -> Iterator[tuple[str | None, bytes]]:
    name: bytes | None = None  # of a header that belongs here
    while left > 0 and (block := data.read(min(BUFFER, left))):
        left -= len(block)
        at = 0
        while at < len(block):
            if in_header:
                stop = block.find(b"\n", at)
                if name is not None:
                    name += block[at : stop if stop >= 0 else len(block)]
                if stop < 0:
                    break
                if name is not None:
                    yield _word(name), b""
                name, in_header, line_start, at = None, False, True, stop + 1
            elif line_start and block[at] == ord(">"):
                name, in_header, line_start, at = b"", True, False, at + 1
            else:
                following = block.find(b"\n>", at)
                stop = len(block) if following < 0 else following + 1
                if bases := block[at:stop].translate(None, b" \t\r\n"):
                    yield None, bases
                line_start, at = block[stop - 1 : stop] == b"\n", stop
    if name is not None:  # the header reaches over the range's end
        while b"\n" not in (more := data.read(1 << 12)) and more:
            name += more
        yield _word(name + more.partition(b"\n")[0]), b""


def _word(line: bytes) -> str:
    return (line.split() or [b""])[0].decode()


def read_fasta(spark: SparkSession, path: str, chunk: int = 100_000, split: int = SPLIT) -> DataFrame:
    """chrom, start, seq: bases in pieces within multiples of chunk. path: a file, or several, comma-separated. Bases before any header have no chrom."""
    ranges = []
    for one in path.split(","):
        files, where = open_path(one)
        if (size := files.get_file_info(where).size) is None:
            raise FileNotFoundError(one)
        step = max(size, 1) if where.endswith(".gz") else split
        ranges += [(one, a, min(a + step, size)) for a in range(0, size, step)]
    if not ranges:
        return spark.createDataFrame([], SCHEMA)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, one, a, b in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                lead, last, behind = 0, None, 0
                for name, bases in _pieces(one, a, b):
                    if name is not None:
                        last, behind = name, 0
                    elif last is None:
                        lead += len(bases)
                    else:
                        behind += len(bases)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([lead], pa.int64()), pa.array([last], pa.string()), pa.array([behind], pa.int64())], names=["k", "lead", "last", "behind"])

    numbered = spark.createDataFrame([(k, *r) for k, r in enumerate(ranges)], "k long, path string, a long, b long").repartition(len(ranges))
    # A row for each range.
    counts = {r[0]: r[1:] for r in numbered.mapInArrow(count, "k long, lead long, last string, behind long").collect()}
    begins, name, place, before = [], None, 0, None
    for k, (one, a, b) in enumerate(ranges):
        if one != before:
            name, place, before = None, 0, one
        begins.append((one, a, b, name, place))
        lead, last, behind = counts[k]
        name, place = (name, place + lead) if last is None else (last, behind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(names: list, starts: list, seqs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(seqs, pa.string())], names=["chrom", "start", "seq"])

        for batch in batches:
            for one, a, b, chrom, at in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
                waiting = b""
                for head, bases in _pieces(one, a, b):
                    if head is not None:
                        if waiting:
                            yield rows([chrom], [at], [waiting.decode()])
                        chrom, at, waiting = head, 0, b""
                        continue
                    waiting += bases
                    while len(waiting) >= (n := chunk - at % chunk):
                        yield rows([chrom], [at], [waiting[:n].decode()])
                        at, waiting = at + n, waiting[n:]
                if waiting:
                    yield rows([chrom], [at], [waiting.decode()])

    placed = spark.createDataFrame(begins, "path string, a long, b long, chrom string, start long").repartition(len(begins))
    return placed.mapInArrow(read, SCHEMA)
