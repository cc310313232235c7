"""Alignment files: BAM as a Spark data source that reads and writes, and SAM text.

BAM follows the public SAM specification: BGZF blocks with little-endian records. A file is split into ranges of bytes: a task looks for the first
block in its range, and in that for the first record, which a chain of plausible ones tells; it reads on to the end of the last record that starts
in its range. Records become Arrow batches: heads, names, bases and qualities by numpy, and only the columns asked for. Conditions on flag, mapq and
chromosome drop records by their heads. ord is a record's virtual offset. Files are opened through pyarrow's file systems, so that paths may be URIs. CRAM isn't read.

    read_bam(spark, paths, columns), write_bam(reads, path, header)
    spark.dataSource.register(BamSource); spark.read.format("bam").load(path)
    df.write.format("bam").option("header", text).mode("append").save(path)  # one process puts the parts together, no index
"""

from __future__ import annotations

import functools
import io
import itertools
import pickle
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .fasta import read_fasta  # noqa: F401 - of the same files as alignments
from .parts import Whole, assemble, joined, open_path

SCHEMA = "qname string, flag int, chrom string, pos long, mapq int, cigar string, rnext string, pnext long, tlen int, seq string, qual string, tags string, ord long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 0xFF00
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


# --- BGZF


def blocks(raw) -> Iterator[bytes]:
    while head := raw.read(18):
        size = struct.unpack("<H", head[16:18])[0] + 1
        body = raw.read(size - 18)
        yield zlib.decompress(body[:-8], -15)


class BlockReader(io.RawIOBase):
    def __init__(self, raw):
        self.source, self.rest = blocks(raw), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest:
            if (block := next(self.source, None)) is None:
                return 0
            self.rest = block
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def compressed(data: bytes) -> bytes:
    out = []
    for a in range(0, len(data), BLOCK):
        part = data[a : a + BLOCK]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(bytes.fromhex("1f8b08040000000000ff060042430200") + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


# --- records


def encode_header(text: str) -> tuple[bytes, list[str]]:
    """The header and the names of its sequences, from SAM header lines."""
    found = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in text.splitlines() if line.startswith("@SQ")]
    raw = text.encode()
    out = [b"BAM\1", struct.pack("<i", len(raw)), raw, struct.pack("<i", len(found))]
    for s in found:
        name = s["SN"].encode() + b"\0"
        out.append(struct.pack("<i", len(name)) + name + struct.pack("<i", int(s["LN"])))
    return b"".join(out), [s["SN"] for s in found]


def read_header(file) -> tuple[str, list[str]]:
    if file.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = file.read(struct.unpack("<i", file.read(4))[0]).rstrip(b"\0").decode()
    names = []
    for _ in range(struct.unpack("<i", file.read(4))[0]):
        names.append(file.read(struct.unpack("<i", file.read(4))[0])[:-1].decode())
        file.read(4)
    return text, names


def _read_tags(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{_NUMBERS[sub]}", data, at + 5)
            value, at = ",".join([sub, *map(str, values)]), at + 5 + struct.calcsize(f"<{n}{_NUMBERS[sub]}")
        else:
            value, at, kind = str(struct.unpack_from("<" + _NUMBERS[kind], data, at)[0]), at + struct.calcsize("<" + _NUMBERS[kind]), "f" if kind == "f" else "i"
        out.append(f"{tag}:{kind}:{value}")
    return "\t".join(out)


def _write_tags(text: str | None) -> bytes:
    out = []
    for part in (text or "").split("\t") if text else []:
        tag, kind, value = part.split(":", 2)
        head = tag.encode() + kind.encode()
        if kind in "ZH":
            out.append(head + value.encode() + b"\0")
        elif kind == "A":
            out.append(head + value.encode()[:1])
        elif kind == "B":
            sub, *values = value.split(",")
            out.append(head + sub.encode() + struct.pack(f"<i{len(values)}{_NUMBERS[sub]}", len(values), *(float(v) if sub == "f" else int(v) for v in values)))
        elif kind == "f":
            out.append(head + struct.pack("<f", float(value)))
        else:
            out.append(head + struct.pack("<i", int(value)))
    return b"".join(out)


def bin_of(start: int, end: int) -> int:
    """The smallest bin of the indexing scheme that holds [start, end)."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def encode_record(row, place: dict[str, int]) -> bytes:
    name = (row["qname"] or "*").encode() + b"\0"
    cigar = [] if row["cigar"] in (None, "*", "") else _cigar(row["cigar"])
    pos = -1 if row["pos"] is None else row["pos"]
    span = sum(n for n, op in cigar if op in "MDN=X") or 1
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    codes = [max(BASES.find(b), 0) if b.upper() in BASES else 15 for b in seq.upper()] + [0] * (len(seq) % 2)
    qual = b"\xff" * len(seq) if row["qual"] in (None, "*") else bytes(ord(c) - 33 for c in row["qual"])
    body = struct.pack("<iiBBHHHiiii", place.get(row["chrom"], -1), pos, len(name), row["mapq"] or 0, bin_of(max(pos, 0), max(pos, 0) + span) if pos >= 0 else 4680, len(cigar), row["flag"], len(seq), place.get(row["rnext"], -1), -1 if row["pnext"] is None else row["pnext"], row["tlen"] or 0)
    body += name + struct.pack(f"<{len(cigar)}I", *(n << 4 | OPS.index(op) for n, op in cigar)) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + qual + _write_tags(row["tags"])
    return struct.pack("<i", len(body)) + body


def _cigar(text: str) -> list[tuple[int, str]]:
    out, n = [], ""
    for c in text:
        if c.isdigit():
            n += c
        else:
            out.append((int(n), c))
            n = ""
    return out


# --- splits


CHUNK = 4 << 20
#: Records that must follow one another from a place for it to count as the start of one.
CHAIN = 8


def block_size(data: bytes, at: int = 0) -> int | None:
    """Size of the BGZF block that starts there, from its header (18 bytes at least); None: no block starts there."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 18:
        return None
    extra = data[at + 12 : at + 12 + struct.unpack_from("<H", data, at + 10)[0]]
    k = 0
    while k + 4 <= len(extra):
        n = struct.unpack_from("<H", extra, k + 2)[0]
        if extra[k : k + 2] == b"BC" and n == 2 and k + 6 <= len(extra):
            return struct.unpack_from("<H", extra, k + 4)[0] + 1
        k += 4 + n
    return None


def inflated(block: bytes) -> bytes:
    return zlib.decompress(block[12 + struct.unpack_from("<H", block, 10)[0] : -8], -15)


class _Raw(io.RawIOBase):
    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.stream.read(len(into))
        into[: len(data)] = data
        return len(data)


class BlockFile:
    """Random access to the blocks of an open BGZF file."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))

    def block(self, at: int) -> tuple[bytes, int] | None:
        """What the block there holds, and where the next one starts; None at the end."""
        if at >= self.size:
            return None
        head = self._read(at, 1 << 16)
        if (n := block_size(head)) is None:
            raise ValueError(f"no block at {at}: the file is damaged, or not BGZF")
        if len(head) < n:
            raise ValueError(f"the block at {at} is cut short")
        return inflated(head[:n]), at + n

    def next_block(self, at: int) -> int:
        """Where the first block at or behind a place starts: a header that a chain of further ones follows. The file's size, if none does."""
        start = at
        while start < self.size:
            data = self._read(start, 1 << 17)
            k = data.find(b"\x1f\x8b\x08\x04")
            while 0 <= k < min(len(data), 1 << 16):
                if self._chained(start + k):
                    return start + k
                k = data.find(b"\x1f\x8b\x08\x04", k + 1)
            start += 1 << 16
        return self.size

    def _chained(self, at: int) -> bool:
        for _ in range(3):
            if at == self.size:
                return True
            n = block_size(self._read(at, 1 << 10))
            if n is None or at + n > self.size:
                return False
            at += n
        return True


class Segments:
    """Uncompressed bytes of consecutive blocks, and for each place its virtual offset: the block's start in the file << 16 | place in the block."""

    def __init__(self):
        self.parts, self.length = [], 0

    def add(self, at: int, skip: int, data: bytes) -> None:
        if data:
            self.parts.append((at, skip, data))
            self.length += len(data)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes; where each part starts in them; its virtual offset."""
        starts = np.cumsum([0, *(len(d) for *_, d in self.parts)])[:-1]
        return b"".join(d for *_, d in self.parts), starts, np.array([a << 16 | s for a, s, _ in self.parts], np.int64)

    def drop(self, n: int) -> None:
        """Leave out the first n bytes."""
        self.length -= n
        kept = []
        for at, skip, data in self.parts:
            if n < len(data):
                kept.append((at, skip + n, data[n:]) if n else (at, skip, data))
                n = 0
            else:
                n -= len(data)
        self.parts = kept


def looks_like_record(data: bytes, at: int, n_refs: int) -> int | None:
    """The record's size with its length, if what stands there can be one (as far as data reaches); else None."""
    if len(data) < at + 36:
        return None
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    if not (-1 <= ref < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1 and l_name >= 1 and l_seq >= 0):
        return None
    if size < 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq:
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    ops = data[at + 36 + l_name : at + 36 + l_name + 4 * n_cigar]
    return None if any(c & 15 > 8 for c in ops[::4]) else size + 4


def first_record(data: bytes, n_refs: int, whole: bool) -> int | None:
    """Where the first record in data starts: a chain of CHAIN records goes from there, or (whole) one that ends where the file does. None: too little data.

    The first record's chain holds those of all later ones, so that none of these is taken for it.
    """
    for start in range(len(data)):
        at, n = start, 0
        while n < CHAIN and (size := looks_like_record(data, at, n_refs)) is not None:
            at, n = at + size, n + 1
        if n == CHAIN or (whole and n and at == len(data)):
            return start
    return None


@dataclass
class _Split(InputPartition):
    path: str
    start: int
    end: int


def split_records(path: str, start: int, end: int) -> Iterator[tuple[list[str], bytes, np.ndarray, np.ndarray]]:
    """The records that start in a block that starts in [start, end): names of the sequences; bytes; where each record starts in them; its virtual offset.

    A record may reach over blocks, and over the end of the split; it belongs to where it starts.
    """
    files, where = open_path(path)
    with files.open_input_file(where) as raw:
        file = BlockFile(raw)
        header = _Virtual(_Raw(raw))
        _, names = read_header(header)
        first = header.tell()
        at = file.next_block(start) if start > first >> 16 else first >> 16
        own, skip = Segments(), 0
        if at == first >> 16:
            skip = first & 0xFFFF
        else:
            # Blocks are read until a chain of records tells where the first one starts.
            look, to, need = Segments(), at, 1 << 17
            while at < end:
                while look.length < need and (block := file.block(to)) is not None:
                    look.add(to, 0, block[0])
                    to = block[1]
                data, starts, offsets = look.joined()
                whole = to >= file.size
                if (found := first_record(data, len(names), whole)) is not None:
                    k = int(np.searchsorted(starts, found, side="right")) - 1
                    at, skip = int(offsets[k]) >> 16, found - int(starts[k])
                    break
                if whole:
                    return
                need *= 2
        ended, room = False, CHUNK
        while not ended:
            while own.length < room and at < end and (block := file.block(at)) is not None:
                own.add(at, skip, block[0][skip:])
                at, skip = block[1], 0
            ended = at >= min(end, file.size)
            data, starts, offsets = own.joined()
            owned = len(data)
            found, place = [], 0
            while place < owned:
                while len(data) < place + 4 or len(data) < place + 4 + struct.unpack_from("<i", data, place)[0]:
                    if not ended or (block := file.block(at)) is None:
                        break
                    data, at = data + block[0], block[1]
                else:
                    found.append(place)
                    place += 4 + struct.unpack_from("<i", data, place)[0]
                    continue
                break
            if ended and place < owned:
                raise ValueError(f"{path} ends within a record")
            if found:
                begins = np.array(found, np.int64)
                k = np.searchsorted(starts, begins, side="right") - 1
                yield names, data, begins, offsets[k] + (begins - starts[k])
            room = CHUNK if found else 2 * room  # a record may be longer than a chunk
            own.drop(min(place, owned))


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many spans behind one another, and the bounds of each."""
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return data[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


def _strings(values: np.ndarray, bounds: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    bits = None if mask is None else pa.py_buffer(np.packbits(~mask, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(values.tobytes()), bits).cast(pa.string())


_HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
_LETTERS = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], np.uint8)


def decoded(names: list[str], data: bytes, begins: np.ndarray, offsets: np.ndarray, columns: list[str], conditions: Heads, path: str) -> pa.RecordBatch:
    """A batch of the columns asked for; records that the conditions exclude are dropped before anything else of them is decoded."""
    raw = np.frombuffer(data, np.uint8)
    heads = raw[begins[:, None] + np.arange(36)].view(_HEAD).ravel()
    keep = conditions.keep(heads, names)
    heads, begins, offsets = heads[keep], begins[keep], offsets[keep]
    ints = {c: heads[c].astype(np.int64) for c in ("size", "l_name", "n_cigar", "l_seq")}
    cigar_at = begins + 36 + ints["l_name"]
    seq_at = cigar_at + 4 * ints["n_cigar"]
    qual_at = seq_at + (ints["l_seq"] + 1) // 2
    tags_at = qual_at + ints["l_seq"]
    sequences = pa.array([*names, None], pa.string())

    def spans(starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def place(column: str) -> pa.Array:
        at = heads[column].astype(np.int64)
        return pa.array(at, pa.int64(), mask=at < 0)

    def bases() -> pa.Array:
        packed, bounds = _gathered(raw, seq_at, (ints["l_seq"] + 1) // 2)
        letters = _LETTERS[packed].ravel()
        out, cut = _gathered(letters, 2 * bounds[:-1], ints["l_seq"])
        return _starred(out, cut, ints["l_seq"] == 0)

    def qualities() -> pa.Array:
        values, bounds = _gathered(raw, qual_at, ints["l_seq"])
        missing = ints["l_seq"] == 0
        some = np.flatnonzero(~missing)
        missing[some] = values[bounds[some]] == 255
        return _starred(values + np.uint8(33), bounds, missing)

    make = {
        "qname": lambda: _strings(*_gathered(raw, begins + 36, ints["l_name"] - 1)),
        "flag": lambda: pa.array(heads["flag"].astype(np.int32)),
        "chrom": lambda: sequences.take(pa.array(np.where(heads["ref"] < 0, len(names), heads["ref"]))),
        "pos": lambda: place("pos"),
        "mapq": lambda: pa.array(heads["mapq"].astype(np.int32)),
        "cigar": lambda: pa.array([_cigar_text(c) for c in spans(cigar_at, seq_at)], pa.string()),
        "rnext": lambda: sequences.take(pa.array(np.where(heads["next_ref"] < 0, len(names), heads["next_ref"]))),
        "pnext": lambda: place("next_pos"),
        "tlen": lambda: pa.array(heads["tlen"].astype(np.int32)),
        "seq": bases,
        "qual": qualities,
        "tags": lambda: pa.array([_read_tags(t) for t in spans(tags_at, begins + 4 + ints["size"])], pa.string()),
        "ord": lambda: pa.array(offsets),
        "file": lambda: pa.array([path] * len(heads), pa.string()),
    }
    return pa.RecordBatch.from_arrays([make[c]() for c in columns], names=columns)


def _starred(values: np.ndarray, bounds: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Strings, with a star for those that are missing."""
    rows = _strings(values, bounds)
    return pc.if_else(pa.array(missing), pa.scalar("*"), rows) if missing.any() else rows


@functools.lru_cache(1 << 16)
def _cigar_text(data: bytes) -> str:
    return "".join(f"{v >> 4}{OPS[v & 15]}" for v in struct.unpack(f"<{len(data) // 4}I", data)) or "*"


# --- the source


#: Records of a batch.
BATCH = 1 << 14


@dataclass
class Heads:
    """Conditions that a record's head tells: no flag bit of without, at least min_mapq, and, if any are named, one of these chromosomes."""

    without: int = 0
    min_mapq: int = 0
    chroms: frozenset[str] = frozenset()

    def keep(self, heads: np.ndarray, names: list[str]) -> np.ndarray:
        out = (heads["flag"] & self.without == 0) & (heads["mapq"] >= self.min_mapq)
        if self.chroms:
            out &= np.array([*(n in self.chroms for n in names), False])[np.where(heads["ref"] < 0, len(names), heads["ref"])]
        return out


class _Reader(DataSourceReader):
    """It has no pushFilters(): in the present version of Spark two plans of one table share what was pushed last, and give wrong rows."""

    def __init__(self, paths: list[str], columns: list[str], split: int, conditions: Heads):
        self.paths, self.columns, self.split, self.conditions = paths, columns, split, conditions

    def partitions(self) -> list[_Split]:
        out = []
        for path in self.paths:
            files, where = open_path(path)
            size = files.get_file_info(where).size
            if size is None:
                raise FileNotFoundError(path)
            out += [_Split(path, a, min(a + self.split, size)) for a in range(0, max(size, 1), self.split)]
        return out

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        for names, data, begins, offsets in split_records(partition.path, partition.start, partition.end):
            for a in range(0, len(begins), BATCH):
                yield decoded(names, data, begins[a : a + BATCH], offsets[a : a + BATCH], self.columns, self.conditions, partition.path)


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str
    size: int


class PartIndex:
    """Bins with chunks, and the linear index, of records in order of place, with virtual offsets from the part's start. Parts merge in their order."""

    def __init__(self, n_refs: int):
        self.bins, self.linear = [{} for _ in range(n_refs)], [{} for _ in range(n_refs)]
        self.first = self.last = None
        self.sorted = True

    def add(self, body: bytes, begin: int, end: int) -> None:
        """A record (without its length) that starts and ends at those virtual offsets."""
        ref, pos, l_name, _, number, n_cigar = struct.unpack_from("<iiBBHH", body)
        if ref < 0 or pos < 0:
            return
        if self.last is not None and (ref, pos) < self.last:
            self.sorted = False
        self.first, self.last = self.first or (ref, pos), (ref, pos)
        span = sum(v >> 4 for v in struct.unpack_from(f"<{n_cigar}I", body, 32 + l_name) if OPS[v & 15] in "MDN=X") or 1
        self._chunk(ref, number, begin, end)
        for w in range(pos >> 14, (pos + span - 1 >> 14) + 1):
            self.linear[ref].setdefault(w, begin)

    def _chunk(self, ref: int, number: int, begin: int, end: int) -> None:
        chunks = self.bins[ref].setdefault(number, [])
        if chunks and chunks[-1][1] >> 16 == begin >> 16:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])

    def merge(self, part: PartIndex, shift: int) -> None:
        """Add the next part, whose first block starts at shift in the whole file."""
        self.sorted &= part.sorted and (self.last is None or part.first is None or self.last <= part.first)
        self.first, self.last = self.first or part.first, part.last or self.last
        for ref, bins in enumerate(part.bins):
            for number, chunks in bins.items():
                for begin, end in chunks:
                    self._chunk(ref, number, begin + (shift << 16), end + (shift << 16))
        for mine, other in zip(self.linear, part.linear, strict=True):
            for w, begin in other.items():
                mine.setdefault(w, begin + (shift << 16))

    def encoded(self) -> bytes:
        """The bytes of a .bai file."""
        if not self.sorted:
            raise ValueError("not in order of place: it can't be indexed")
        out = [b"BAI\1", struct.pack("<i", len(self.bins))]
        for by_bin, by_window in zip(self.bins, self.linear, strict=True):
            out.append(struct.pack("<i", len(by_bin)))
            for number, chunks in sorted(by_bin.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            n, seen = max(by_window, default=-1) + 1, 0
            out.append(struct.pack("<i", n))
            for w in range(n):
                seen = by_window.get(w, seen)
                out.append(struct.pack("<Q", seen))
        return b"".join(out)


def write_part(rows, path: str, header: str, index: bool) -> _Part:
    """Write a task's records as blocks, and beside them (path.idx) their part of the index, with offsets from the part's start."""
    from pyspark import TaskContext

    _, names = encode_header(header)
    place, waiting, size, start = {n: k for k, n in enumerate(names)}, [], 0, 0
    own = PartIndex(len(names))
    files, where = open_path(path)

    def flushed(out) -> int:
        data = b"".join(waiting)
        pieces = [compressed(data[a : a + BLOCK]) for a in range(0, len(data), BLOCK)]
        if index:
            starts = [start, *itertools.accumulate(map(len, pieces), initial=start)][1:]
            # A place at the very end is the start of the block that comes next.
            virtual = lambda p: starts[-1] << 16 if p == len(data) else starts[p // BLOCK] << 16 | p % BLOCK
            at = 0
            for record in waiting:
                own.add(record[4:], virtual(at), virtual(at + len(record)))
                at += len(record)
        for piece in pieces:
            out.write(piece)
        return start + sum(map(len, pieces))

    with files.open_output_stream(where) as out:
        for row in rows:
            waiting.append(encode_record(row, place))
            size += len(waiting[-1])
            if size >= 1 << 20:
                start = flushed(out)
                waiting, size = [], 0
        start = flushed(out)
    if index:
        with files.open_output_stream(f"{where}.idx") as out:
            out.write(pickle.dumps(own))
    return _Part(TaskContext.get().partitionId(), path, start)


class _Writer(DataSourceWriter):
    """Partitions in their order become one file: BGZF files can be put one behind the other."""

    def __init__(self, path: str, header: str):
        self.path, self.header = path, header

    def write(self, rows) -> _Part:
        return write_part(rows, f"{self.path}.{uuid.uuid4().hex}.part", self.header, index=False)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        joined(Whole(self.path, compressed(encode_header(self.header)[0]), [(m.path, m.size) for m in parts], EOF))
        self.abort(messages)

    def abort(self, messages) -> None:
        for m in messages:
            if m:
                files, part = open_path(m.path)
                files.delete_file(part)


class BamSource(DataSource):
    """Options: path (or paths, comma-separated), split (bytes of a file for a task), without, min_mapq, chroms (comma-separated; see Heads).

    To write, header: SAM header lines. A schema of some of the columns, and file, the path, reads no others.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        o = self.options
        conditions = Heads(int(o.get("without", "0")), int(o.get("min_mapq", "0")), frozenset(c for c in o.get("chroms", "").split(",") if c))
        return _Reader(o.get("paths", o.get("path", "")).split(","), schema.names, int(o.get("split", SPLIT)), conditions)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("header", ""))


#: Bytes of a file for a task.
SPLIT = 64 << 20


def write_index(path: str) -> str:
    """The .bai file of a BAM file in order of place, by reading it once. write_bam() needs no such pass."""
    files, where = open_path(path)
    with files.open_input_stream(where, compression=None) as raw:
        stream = _Virtual(raw)
        _, names = read_header(stream)
        own = PartIndex(len(names))
        while True:
            begin = stream.tell()
            head = stream.read(4)
            if not head:
                break
            own.add(stream.read(struct.unpack("<i", head)[0]), begin, stream.tell())
    with files.open_output_stream(f"{where}.bai") as file:
        file.write(own.encoded())
    return f"{path}.bai"


class _Virtual:
    """Reads through BGZF blocks and tells virtual offsets."""

    def __init__(self, raw):
        self.raw, self.block, self.at, self.start, self.next = raw, b"", 0, 0, 0

    def tell(self) -> int:
        if self.at == len(self.block):
            return self.next << 16
        return self.start << 16 | self.at

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at == len(self.block):
                head = self.raw.read(18)
                if not head:
                    break
                size = struct.unpack("<H", head[16:18])[0] + 1
                self.block, self.at, self.start, self.next = zlib.decompress(self.raw.read(size - 18)[:-8], -15), 0, self.next, self.next + size
                continue
            piece = self.block[self.at : self.at + n - len(out)]
            out, self.at = out + piece, self.at + len(piece)
        return out


def read_bam(spark: SparkSession, paths: list[str], columns: list[str] | None = None, without: int = 0, min_mapq: int = 0, chroms: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """Records of BAM files in SCHEMA, or only some columns of it and file (the path); ord orders a file's records.

    without (flag bits that a record must not have), min_mapq and chroms drop records by their heads.
    """
    spark.dataSource.register(BamSource)
    kinds = dict(c.split() for c in SCHEMA.split(", ")) | {"file": "string"}
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or COLUMNS)
    reader = spark.read.format("bam").schema(schema).option("paths", ",".join(paths)).option("split", split)
    return reader.option("without", without).option("min_mapq", min_mapq).option("chroms", ",".join(chroms or [])).load()


def write_bam(reads: DataFrame, path: str, header: str, index: bool = True) -> None:
    """One BAM file of the rows in the order of their partitions (see coordinate_sorted), and its index.

    Each task writes its part, and that part's index with offsets of its own; a part of a task that runs twice is used once. Parts become one
    file as assemble() does it. The index is the parts' shifted and merged: its size is bounded by the genome's bins.
    """
    spark = reads.sparkSession
    known, kinds = dict(reads.dtypes), dict(c.split() for c in SCHEMA.split(", "))
    full = reads.select(*[F.col(c).cast(k) if c in known else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    files, where = open_path(folder)
    files.create_dir(where, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        part = write_part(rows, f"{folder}/{uuid.uuid4().hex}.part", header, index)
        yield pa.RecordBatch.from_pydict({"number": pa.array([part.number], pa.int32()), "path": [part.path], "size": pa.array([part.size], pa.int64())})

    # A row for each task, sorted here: ordering them in Spark would write them once more to find ranges.
    parts = sorted((_Part(*r) for r in full.mapInArrow(write, "number int, path string, size long").collect()), key=lambda p: p.number)
    whole = Whole(path, compressed(encode_header(header)[0]), [(p.path, p.size) for p in parts], EOF)
    assemble(spark, [whole])
    try:
        if index:
            own = PartIndex(len(encode_header(header)[1]))
            for part, start in zip(parts, whole.starts(), strict=False):
                with files.open_input_stream(open_path(part.path)[1] + ".idx") as data:
                    own.merge(pickle.loads(data.read()), start)
            with files.open_output_stream(f"{open_path(path)[1]}.bai") as out:
                out.write(own.encoded())
    finally:
        files.delete_dir(where)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text. ord is a pair (block of the file, line in it), in order."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("ord")).where(~F.col("value").startswith("@"))
    star = lambda k, other=None: F.when(parts[k] == "*", other).otherwise(parts[k])
    place = lambda k: F.when(parts[k].cast("long") > 0, parts[k].cast("long") - 1)
    return rows.select(parts[0].alias("qname"), parts[1].cast("int").alias("flag"), star(2).alias("chrom"), place(3).alias("pos"), parts[4].cast("int").alias("mapq"), parts[5].alias("cigar"), F.when(parts[6] == "=", star(2)).otherwise(star(6)).alias("rnext"), place(7).alias("pnext"), parts[8].cast("int").alias("tlen"), parts[9].alias("seq"), parts[10].alias("qual"), F.concat_ws("\t", F.slice(parts, 12, 1000)).alias("tags"), "ord")


def sam_line() -> F.Column:
    """A record as a line of SAM text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    place = lambda c: F.coalesce(F.col(c) + 1, F.lit(0)).cast("string")
    fields = [text("qname"), F.col("flag").cast("string"), text("chrom"), place("pos"), F.coalesce("mapq", F.lit(0)).cast("string"), text("cigar"), text("rnext"), place("pnext"), F.coalesce("tlen", F.lit(0)).cast("string"), text("seq"), text("qual")]
    return F.concat_ws("\t", *fields, F.when(F.coalesce("tags", F.lit("")) != "", F.col("tags")))
