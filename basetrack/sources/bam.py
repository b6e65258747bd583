"""BAM files as a Spark data source in pure Python: BGZF blocks are found by their size fields and inflated one by one.

A partition is a range of blocks.  Records run on across blocks, so a partition begins at the first record that starts in it: the driver
walks the block headers, and the ranges are cut where a block begins with a record (writers flush at record ends; where none does, the
file is one partition).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, ordinal long, qname string, flag int, chrom string, start long, mapq int, cigar string, seq string, tags map<string,string>"
# Fixed values of the file format.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def block_places(path: str) -> list[tuple[int, int]]:
    """(offset, size) of the BGZF blocks of a file, by their headers."""
    out, at = [], 0
    with open(path, "rb") as f:
        while head := f.read(18):
            if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
                raise ValueError(f"{path}: no BGZF block at {at}")
            extra = struct.unpack("<H", head[10:12])[0]
            f.seek(at + 12)
            fields, size, k = f.read(extra), 0, 0
            while k + 4 <= len(fields):
                n = struct.unpack("<H", fields[k + 2 : k + 4])[0]
                if fields[k : k + 2] == b"BC":
                    size = struct.unpack("<H", fields[k + 4 : k + 6])[0] + 1
                k += 4 + n
            if not size:
                raise ValueError(f"{path}: the block at {at} has no size")
            out.append((at, size))
            at += size
            f.seek(at)
    return out


def inflate(path: str, blocks: list[tuple[int, int]]) -> Iterator[bytes]:
    with open(path, "rb") as f:
        for at, size in blocks:
            f.seek(at)
            yield zlib.decompress(f.read(size), 31)


def read_header(path: str, blocks: list[tuple[int, int]]) -> tuple[list[tuple[str, int]], int]:
    """Reference names and lengths, and the header's length in inflated bytes."""
    data = b""
    for piece in inflate(path, blocks):
        data += piece
        if data[:4] != b"BAM\1"[: len(data[:4])]:
            raise ValueError(f"{path} is not a BAM file")
        try:
            text = struct.unpack_from("<i", data, 4)[0]
            n = struct.unpack_from("<i", data, 8 + text)[0]
            at, out = 12 + text, []
            for _ in range(n):
                k = struct.unpack_from("<i", data, at)[0]
                name = data[at + 4 : at + 3 + k].decode()
                out.append((name, struct.unpack_from("<i", data, at + 4 + k)[0]))
                at += 8 + k
            return out, at
        except struct.error:
            continue
    raise ValueError(f"{path}: the header ends early")


def _tags(data: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            out[name], at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = NUMBERS[chr(data[at])], struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{sub}", data, at + 5)
            out[name], at = ",".join(map(str, values)), at + 5 + struct.calcsize(f"<{n}{sub}")
        else:
            sub = NUMBERS[kind]
            out[name], at = str(struct.unpack_from("<" + sub, data, at)[0]), at + struct.calcsize("<" + sub)
    return out


def parse_record(data: bytes, names: list[str]) -> tuple:
    """(qname, flag, chrom, start, mapq, cigar, seq, tags) of a record without its size field."""
    ref, pos, name_size, mapq, _, n_ops, flag, length, _, _, _ = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + name_size
    qname = data[32 : at - 1].decode()
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    packed = data[at : at + (length + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:length]
    at += (length + 1) // 2 + length
    tags = _tags(data[at:])
    if "CG" in tags and n_ops == 2 and ops[0] & 15 == 4:  # a long CIGAR lies in a tag
        ops = tuple(map(int, tags["CG"].split(",")))
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops) or "*"
    return qname, flag, names[ref] if ref >= 0 else None, pos, mapq, cigar, seq, tags


def records(pieces: Iterator[bytes], skip: int = 0) -> Iterator[bytes]:
    """Records of inflated pieces; at most a record and a piece are in memory."""
    data = b""
    for piece in pieces:
        data += piece
        if skip:
            cut = min(skip, len(data))
            data, skip = data[cut:], skip - cut
        at = 0
        while at + 4 <= len(data) and at + 4 + (size := struct.unpack_from("<i", data, at)[0]) <= len(data):
            yield data[at + 4 : at + 4 + size]
            at += 4 + size
        data = data[at:]
    if data:
        raise ValueError("the file ends within a record")


class Span(InputPartition):
    def __init__(self, path: str, number: int, skip: int, blocks: list[tuple[int, int]]) -> None:
        super().__init__(number)
        self.path, self.skip, self.blocks = path, skip, blocks


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p.removeprefix("file://") for p in options["path"].split(",")]
        self.aligned = options.get("aligned", "false").lower() == "true"
        self.run = int(options.get("blocks", "2048"))

    def partitions(self) -> list[Span]:
        out = []
        for path in self.paths:
            blocks = block_places(path)
            _, size = read_header(path, blocks)
            if not self.aligned:
                out.append(Span(path, len(out), size, blocks))
                continue
            first, skip = 0, size  # blocks that the header fills
            for piece in inflate(path, blocks):
                if skip < len(piece):
                    break
                skip -= len(piece)
                first += 1
            for i in range(first, len(blocks), self.run):
                out.append(Span(path, len(out), skip if i == first else 0, blocks[i : i + self.run]))
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in read_header(partition.path, block_places(partition.path))[0]]
        rows, ordinal = [], partition.value << 40
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        labels = [x.split()[0] for x in SCHEMA.replace("map<string,string>", "m").split(", ")]

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=labels)

        for data in records(inflate(partition.path, partition.blocks), partition.skip):
            *fields, tags = parse_record(data, names)
            rows.append((partition.path, ordinal, *fields, list(tags.items())))
            ordinal += 1
            if len(rows) >= 4096:
                yield give()
                rows = []
        if rows:
            yield give()


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``; with the option aligned=true, blocks begin with records and are read by many tasks."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, *paths: str, aligned: bool = False) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("path", ",".join(paths)).option("aligned", str(aligned).lower()).load()
