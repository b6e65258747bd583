"""bigWig files as a Spark data source, read and written in pure Python.

Read: the header, the chromosome tree and the block index are walked on the driver (a few numbers a block); each partition
inflates a run of blocks and yields Arrow batches.  Write: one file is written by one task from rows sorted by chromosome and start.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from basetrack.functions.zoom import Greedy, Records, zoom_sizes

# Fixed values of the file format.
MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BEDGRAPH, VARIABLE_STEP, FIXED_STEP = 1, 2, 3
BLOCK_ITEMS, NODE_ITEMS, MOST_ZOOMS = 1024, 256, 10
SCHEMA = "chrom string, start long, end long, value float"


class Header:
    """Positions in the file, chromosomes and data blocks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            head = f.read(64)
            if len(head) < 64 or struct.unpack("<I", head[:4])[0] != MAGIC:
                raise ValueError(f"{path} is not a little-endian bigWig file")
            self.version, self.zooms, tree, self.data, index, _, _, _, self.summary, self.buffer, _ = struct.unpack("<HHQQQHHQQIQ", head[4:])
            self.chroms = dict(self._chroms(f, tree))
            self.blocks = sorted(self._blocks(f, index))

    def _chroms(self, f, at: int) -> Iterator[tuple[int, tuple[str, int]]]:
        f.seek(at)
        magic, _, key, value, _, _ = struct.unpack("<IIIIQQ", f.read(32))
        if magic != TREE_MAGIC or value != 8:
            raise ValueError("the chromosome tree is damaged")
        nodes = [at + 32]
        while nodes:
            f.seek(nodes.pop())
            leaf, _, n = struct.unpack("<BBH", f.read(4))
            for _ in range(n):
                item = f.read(key + 8)
                if leaf:
                    number, length = struct.unpack("<II", item[key:])
                    yield number, (item[:key].rstrip(b"\0").decode(), length)
                else:
                    nodes.append(struct.unpack("<Q", item[key:])[0])

    def _blocks(self, f, at: int) -> Iterator[tuple[int, int, int, int, int]]:
        f.seek(at)
        if struct.unpack("<I", f.read(48)[:4])[0] != INDEX_MAGIC:
            raise ValueError("the block index is damaged")
        nodes = [at + 48]
        while nodes:
            f.seek(nodes.pop())
            leaf, _, n = struct.unpack("<BBH", f.read(4))
            for _ in range(n):
                if leaf:
                    chrom, start, last, end, offset, size = struct.unpack("<IIIIQQ", f.read(32))
                    if chrom != last:
                        raise ValueError("a block spans chromosomes")
                    yield chrom, start, end, offset, size
                else:
                    nodes.append(struct.unpack("<IIIIQ", f.read(24))[4])


def decode(section: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(chromosome, starts, ends, values) of an inflated block."""
    chrom, start, _, step, span, kind, _, n = struct.unpack("<IIIIIBBH", section[:24])
    body = section[24:]
    if kind == BEDGRAPH:
        items = np.frombuffer(body, "<u4,<u4,<f4", n)
        starts, ends, values = items["f0"].astype(np.int64), items["f1"].astype(np.int64), items["f2"]
    elif kind == VARIABLE_STEP:
        items = np.frombuffer(body, "<u4,<f4", n)
        starts, values = items["f0"].astype(np.int64), items["f1"]
        ends = starts + span
    elif kind == FIXED_STEP:
        values = np.frombuffer(body, "<f4", n)
        starts = start + step * np.arange(n, dtype=np.int64)
        ends = starts + span
    else:
        raise ValueError(f"unknown block kind {kind}")
    if n and ((ends <= starts).any() or (starts[1:] < ends[:-1]).any()):
        raise ValueError("a block's items overlap or are out of order")
    return chrom, starts, ends, values


class Blocks(InputPartition):
    def __init__(self, path: str, names: dict[int, str], compressed: bool, blocks: list[tuple[int, int]]) -> None:
        super().__init__(None)
        self.path, self.names, self.compressed, self.blocks = path, names, compressed, blocks


class BigWigReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = options["path"].split(",")
        self.run = int(options.get("blocks", "512"))

    def partitions(self) -> list[Blocks]:
        out = []
        for path in self.paths:
            path = path.removeprefix("file://")
            h = Header(path)
            places = [(offset, size) for _, _, _, offset, size in h.blocks]
            names = {k: name for k, (name, _) in h.chroms.items()}
            out += [Blocks(path, names, h.buffer > 0, places[i : i + self.run]) for i in range(0, len(places), self.run)]
        return out or [Blocks("", {}, False, [])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        with open(partition.path, "rb") as f:
            for offset, size in partition.blocks:
                f.seek(offset)
                data = f.read(size)
                chrom, starts, ends, values = decode(zlib.decompress(data) if partition.compressed else data)
                name = pa.array([partition.names[chrom]] * len(starts))
                yield pa.RecordBatch.from_arrays([name, pa.array(starts), pa.array(ends), pa.array(values.astype(np.float32))], names=["chrom", "start", "end", "value"])


class BigWigSource(DataSource):
    """``spark.read.format("bigwig").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BigWigReader:
        return BigWigReader(self.options)


def read_bigwig(spark: SparkSession, *paths: str) -> DataFrame:
    spark.dataSource.register(BigWigSource)
    return spark.read.format("bigwig").option("path", ",".join(paths)).load()


def chrom_sizes(path: str) -> list[tuple[str, int]]:
    chroms = Header(path.removeprefix("file://")).chroms
    return [chroms[k] for k in sorted(chroms)]


def _tree(names: list[str], lengths: list[int]) -> bytes:
    """The chromosomes as one leaf; a leaf's count is 16 bits."""
    if len(names) > 0xFFFF:
        raise ValueError(f"{len(names)} chromosomes")
    key = max(len(n.encode()) for n in names)
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    items = [names[i].encode().ljust(key, b"\0") + struct.pack("<II", i, lengths[i]) for i in order]
    return struct.pack("<IIIIQQ", TREE_MAGIC, len(items), key, 8, len(items), 0) + struct.pack("<BBH", 1, 0, len(items)) + b"".join(items)


def _index(blocks: list[tuple[int, int, int, int, int]], at: int, end: int) -> bytes:
    """An R-tree over the blocks (chrom, start, end, offset, size) that begins at ``at`` in the file."""
    spans = [(c, s, c, e, struct.pack("<IIIIQQ", c, s, c, e, o, z)) for c, s, e, o, z in blocks]
    levels = [[(g[0][0], g[0][1], g[-1][2], max(x[3] for x in g if x[2] == g[-1][2]), b"".join(x[4] for x in g), len(g)) for g in (spans[i : i + NODE_ITEMS] for i in range(0, len(spans), NODE_ITEMS))]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([(g[0][0], g[0][1], g[-1][2], g[-1][3], g, len(g)) for g in (below[i : i + NODE_ITEMS] for i in range(0, len(below), NODE_ITEMS))])
    head = struct.pack("<IIQIIIIQII", INDEX_MAGIC, NODE_ITEMS, len(blocks), *(spans[0][:2] if spans else (0, 0)), *((spans[-1][2], spans[-1][3]) if spans else (0, 0)), end, BLOCK_ITEMS, 0)
    where, place = {}, at + 48
    for level in reversed(levels):
        for node in level:
            where[id(node)] = place
            place += 4 + node[5] * (32 if isinstance(node[4], bytes) else 24)
    out = [head]
    for level in reversed(levels):
        for node in level:
            if isinstance(node[4], bytes):
                out.append(struct.pack("<BBH", 1, 0, node[5]) + node[4])
            else:
                out.append(struct.pack("<BBH", 0, 0, node[5]) + b"".join(struct.pack("<IIIIQ", *x[:4], where[id(x)]) for x in node[4]))
    return b"".join(out)


def encode(chrom: int, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> bytes:
    """A block before deflation, of the kind that says the items in the fewest bytes."""
    n, width = len(starts), int(ends[0] - starts[0])
    steps = np.diff(starts)
    if (ends - starts == width).all():
        step = int(steps[0]) if n > 1 else width
        if (steps == step).all():
            kind, body = FIXED_STEP, values.astype("<f4").tobytes()
        else:
            items = np.empty(n, "<u4,<f4")
            items["f0"], items["f1"] = starts, values
            kind, step, body = VARIABLE_STEP, 0, items.tobytes()
    else:
        items = np.empty(n, "<u4,<u4,<f4")
        items["f0"], items["f1"], items["f2"] = starts, ends, values
        kind, step, width, body = BEDGRAPH, 0, 0, items.tobytes()
    return struct.pack("<IIIIIBBH", chrom, int(starts[0]), int(ends[-1]), step, width, kind, 0, n) + body


_ZOOM = np.dtype([("chrom", "<u4"), ("start", "<u4"), ("end", "<u4"), ("bases", "<u4"), ("least", "<f4"), ("most", "<f4"), ("total", "<f4"), ("squares", "<f4")])


class _Level:
    """A zoom level as it is written: blocks of records in order."""

    def __init__(self, f, level: int) -> None:
        self.f, self.deflation, self.at, self.n, self.blocks, self.held, self.largest = f, level, f.tell(), 0, [], [], 0
        f.write(b"\0" * 4)

    def put(self, chrom: int, r: Records) -> None:
        items = np.empty(len(r.start), _ZOOM)
        items["chrom"] = chrom
        for name, column in zip(Records._fields, r, strict=True):
            items[name] = column
        self.held.append(items)
        if sum(map(len, self.held)) >= BLOCK_ITEMS:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        items = np.concatenate(self.held) if self.held else np.empty(0, _ZOOM)
        at = 0
        while at < len(items):
            end = min(at + BLOCK_ITEMS, len(items))
            end = min(end, at + int(np.searchsorted(items["chrom"][at:end], items["chrom"][at], side="right")))  # of one chromosome
            if end == len(items) and not all_of_it and end - at < BLOCK_ITEMS:
                break
            part = items[at:end]
            packed = zlib.compress(part.tobytes(), self.deflation)
            self.largest = max(self.largest, part.nbytes)
            self.blocks.append((int(part["chrom"][0]), int(part["start"][0]), int(part["end"].max()), self.f.tell(), len(packed)))
            self.f.write(packed)
            self.n += len(part)
            at = end
        self.held = [items[at:]] if at < len(items) else []

    def close(self) -> tuple[int, int]:
        """(place of the data, place of the index)."""
        self._flush(True)
        index = self.f.tell()
        self.f.write(_index(self.blocks, index, index))
        end = self.f.tell()
        self.f.seek(self.at)
        self.f.write(struct.pack("<I", self.n))
        self.f.seek(end)
        return self.at, index


def _inflated(f, blocks: list[tuple[int, int, int, int, int]]) -> Iterator[bytes]:
    for *_, offset, size in blocks:
        end = f.tell()
        f.seek(offset)
        data = zlib.decompress(f.read(size))
        f.seek(end)
        yield data


def _zoom_levels(f, sizes: list[int], blocks: list, n_items: int, deflation: int) -> tuple[list[tuple[int, int, int]], int]:
    """Writes zoom levels, each from the one before and the first from the data; one with no fewer records than what it is made from is dropped."""
    out, largest, source, n_source = [], 0, None, n_items
    for size in sizes:
        begin = f.tell()
        level, greedy = _Level(f, deflation), Greedy(size)
        for data in _inflated(f, blocks if source is None else source.blocks):
            if source is None:
                chrom, starts, ends, values = decode(data)
                found = greedy.feed(chrom, Records.of(starts, ends, values))
            else:
                items = np.frombuffer(data, _ZOOM)
                found = greedy.feed(int(items["chrom"][0]), Records(*(items[c].astype(np.int64 if c in ("start", "end", "bases") else np.float64) for c in Records._fields)))
            for chrom, r in found:
                level.put(chrom, r)
        for chrom, r in greedy.close():
            level.put(chrom, r)
        level._flush(True)
        if level.n >= n_source:
            f.seek(begin)
            f.truncate()
            continue
        out.append((size, *level.close()))
        largest, source, n_source = max(largest, level.largest), level, level.n
    return out, largest


def write_file(path: str, chroms: list[tuple[str, int]], batches: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]], level: int = 6, zooms: int = MOST_ZOOMS) -> None:
    """A bigWig with at most ``zooms`` zoom levels from (chromosome number, starts, ends, values) in order; published by a rename.

    Data goes out as it comes; zoom levels are made from the blocks written, so a batch and a block are in memory at a time.
    """
    import os
    import uuid

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    blocks, largest, n_items = [], 0, 0
    bases, least, most, total, squares = 0, np.inf, -np.inf, 0.0, 0.0
    last = (-1, 0)
    top = 64 + 24 * MOST_ZOOMS  # zoom headers have room for all levels
    with open(draft, "w+b") as f:
        f.write(b"\0" * (top + 40) + _tree([n for n, _ in chroms], [k for _, k in chroms]))
        data = f.tell()
        f.write(b"\0" * 8)
        for chrom, starts, ends, values in batches:
            for i in range(0, len(starts), BLOCK_ITEMS):
                s, e, v = starts[i : i + BLOCK_ITEMS], ends[i : i + BLOCK_ITEMS], values[i : i + BLOCK_ITEMS].astype("<f4")
                if (chrom, int(s[0])) < last or (s[1:] < e[:-1]).any() or (e <= s).any() or e[-1] > chroms[chrom][1]:
                    raise ValueError(f"intervals of {chroms[chrom][0]} overlap, are out of order or lie beyond its end")
                last = (chrom, int(e[-1]))
                body = encode(chrom, s, e, v)
                largest = max(largest, len(body))
                packed = zlib.compress(body, level)
                blocks.append((chrom, int(s[0]), int(e[-1]), f.tell(), len(packed)))
                f.write(packed)
                n_items += len(s)
                n = (e - s).astype(np.float64)
                bases += int(n.sum())
                least, most = min(least, float(v.min())), max(most, float(v.max()))
                total += float((n.astype(np.float32) * v).astype(np.float64).sum())
                squares += float((n * v.astype(np.float64) ** 2).sum())
        index = f.tell()
        f.write(_index(blocks, index, index))
        sizes = zoom_sizes(bases / n_items, max(k for _, k in chroms), zooms) if n_items and zooms else []
        levels, widest = _zoom_levels(f, sizes, blocks, n_items, level)
        f.write(struct.pack("<I", MAGIC))
        f.seek(data)
        f.write(struct.pack("<Q", len(blocks)))
        f.seek(0)
        f.write(struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, len(levels), top + 40, data, index, 0, 0, 0, top, max(largest, widest), 0))
        for size, at, of in levels:
            f.write(struct.pack("<IIQQ", size, 0, at, of))
        f.seek(top)
        f.write(struct.pack("<Qdddd", bases, least if bases else 0.0, most if bases else 0.0, total, squares))
    os.replace(draft, path)


def read_zooms(path: str) -> dict[int, np.ndarray]:
    """{reduction size: records} of a file's zoom levels."""
    path = path.removeprefix("file://")
    head, out = Header(path), {}
    with open(path, "rb") as f:
        f.seek(64)
        table = [struct.unpack("<IIQQ", f.read(24)) for _ in range(head.zooms)]
        for size, _, _, index in table:
            out[size] = np.concatenate([np.frombuffer(d, _ZOOM) for d in _inflated(f, sorted(head._blocks(f, index)))])
    return out
