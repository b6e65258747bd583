"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

1. tokenise: a text is cut where the pre-tokeniser always cuts (see ``cuts``); distinct cuts
   are encoded once a task and the ids of whole texts gathered from them.  Texts longer than a sequence are cut into pieces.
2. range-sort: pieces are range-partitioned by length, longest first (ties by document, so that no length is one task's
   burden), and each gets its rank within its partition and length.  Partition counts give its rank among all of its length.
3. match: documents and gaps are sorted runs of equal length, at most ``capacity`` of each, whatever the corpus holds; so
   the counts that the partitions return are all a superstep needs.  Each superstep sweeps the gaps for the successor of the
   longest unplaced length (the least gap that holds it), gives gaps to documents in order of rank, as many to
   a gap as it holds, opens sequences for the rest, and updates the gaps.  The plan is runs of
   (length, ranks, sequences, offset): bounded by the capacity and not by the rows.
4. place: every task looks its pieces' ranks up in the plan.

Edge cases: a null text is empty and takes one place (its end id); repeated rows and doc_ids are packed each; a null doc_id is
kept; an empty table gives an empty result; texts longer than a sequence give a first piece that is the shorter one; other columns
are passed over.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basetrack.llm import text as tx
from basetrack.llm.common import chunks, materialise, shared_dir, ship

CAPACITY = 2048
END_ID = 0
#: Distinct cuts that a worker remembers, from task to task; beyond it starts anew.
REMEMBERED = 1 << 19
#: Texts that the tokenizer gets at once.
AT_ONCE = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), 123, 125, 126]] = True  # not |, which ends added tokens


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the texts may be cut: the pre-tokeniser cuts there too, and each side alone gives the same ids.

    Before a single space between ink; before an ASCII mark after an ASCII letter; before a line break after ink; after a
    single line break before an ASCII letter.
    """
    n = len(data)
    ink = ~tx._SPACE[data]
    cut = np.zeros(n + 1, bool)
    if n > 2:
        cut[1 : n - 1] = (data[1:-1] == 0x20) & ink[:-2] & ink[2:]
        line = data == 0x0A
        cut[1:n] |= (_MARK[data[1:]] & _LETTER[data[:-1]]) | (line[1:] & ink[:-1])
        cut[2:n] |= _LETTER[data[2:]] & line[1:-1] & ink[:-2]
    cut[bounds] = True
    return np.flatnonzero(cut[:-1]) if n else np.zeros(0, np.int64)


class Encoder:
    """Ids of texts, a distinct cut encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), none, none  # by key; ids are in the table
        self.place, self.size = none, none  # and bytes in the store
        self.table, self.store = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the table now has the ids of new texts, and how many."""
        counts, new = [np.zeros(0, np.int64)], [self.table]
        for lo in range(0, len(texts), AT_ONCE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[lo : lo + AT_ONCE], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            new.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts[-1].sum())))
        count = np.concatenate(counts)
        begin = len(self.table) + np.cumsum(count) - count
        self.table = np.concatenate(new)
        return begin, count

    def _learn(self, keys: np.ndarray, own: list[bytes]) -> None:
        begin, count = self._ids([x.decode() for x in own])
        size = np.fromiter(map(len, own), np.int64, len(own))
        place = len(self.store) + np.cumsum(size) - size
        self.store = np.concatenate([self.store, np.frombuffer(b"".join(own), np.uint8)])
        at = np.searchsorted(self.keys, keys)
        for name, new in (("keys", keys), ("begin", begin), ("count", count), ("place", place), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), at, new))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts one after another, and how many each text has."""
        data, bounds = tx.column_bytes(column)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        starts = cuts(data, bounds)
        ends = np.append(starts[1:], n)
        distinct, first, which = np.unique(tx.byte_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = at < len(self.keys)
        fresh[inside] = self.keys[at[inside]] != distinct[inside]
        if fresh.any():
            own = first[fresh]
            self._learn(distinct[fresh], [data[lo:hi].tobytes() for lo, hi in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
        at = np.searchsorted(self.keys, distinct)[which]
        begin, count, size = self.begin[at], self.count[at], ends - starts
        # a cut has the ids of what is remembered if its bytes are the same; others share its hash by accident
        same = self.size[at] == size
        same[same] = tx.equal_spans(data, starts[same], self.store, self.place[at[same]], size[same])
        if not same.all():
            odd = np.flatnonzero(~same)
            begin[odd], count[odd] = self._ids([data[lo:hi].tobytes().decode() for lo, hi in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
        where = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        total = np.concatenate([[0], np.cumsum(count)])
        edges = np.searchsorted(starts, bounds)
        return self.table[where], total[edges[1:]] - total[edges[:-1]]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder: cuts that one task learnt are known to the next."""
    return Encoder(path)


def piece_starts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of a document of ``length`` ids start: only the first may be shorter than the capacity."""
    if length <= capacity:
        return [0]
    return [0, *range(length % capacity or capacity, length, capacity)]


def tokenise(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for part in chunks(batches, "text"):
            ids, counts = encoder.encode(part.column("text"))
            out: list[tuple] = []
            at = 0
            end = np.array([END_ID], "<u4")
            for doc, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], end).astype("<u4")
                at += n
                starts = piece_starts(n + 1, capacity)
                for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], n + 1], strict=True)):
                    out.append((doc, k, lo, hi - lo, zlib.crc32(own[lo:hi])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, PIECES)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan for ``counts`` documents of each length, and the number of sequences.

    A run (length, rank, n, sequence, offset) puts ranks rank..rank+n-1 of a length into the sequences from
    ``sequence`` on, one each, at ``offset``.  Supersteps go from the longest length down.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted gap sizes with sequences
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, how many)
    used = 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            if not runs[gap]:
                bisect.insort(gaps, gap)
            runs[gap].append((first, n))

    def fill(length: int, rank: int, left: int, first: int, n: int, gap: int) -> int:
        """Documents into n sequences with this gap, as many each as it holds; how many found a place."""
        each, placed = gap // length, 0
        full = min(n, left // each)
        for j in range(each if full else 0):
            plan.append((length, rank + placed, full, first, capacity - gap + j * length))
            placed += full
        put(gap - each * length, first, full)
        rest = min(left - placed, each) if full < n else 0
        for j in range(rest):  # the last one, not filled
            plan.append((length, rank + placed, 1, first + full, capacity - gap + j * length))
            placed += 1
        if rest:
            put(gap - rest * length, first + full, 1)
        untouched = full + bool(rest)
        put(gap, first + untouched, n - untouched)
        return placed

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(gaps, length)
            if k == len(gaps):
                break
            gap = gaps.pop(k)
            held = runs.pop(gap)
            for i, (first, n) in enumerate(held):
                if not left:
                    for rest in held[i:]:
                        put(gap, *rest)
                    break
                done = fill(length, rank, left, first, n, gap)
                rank, left = rank + done, left - done
        if left:
            n = -(-left // (capacity // length))
            fill(length, rank, left, used, n, capacity)
            used += n
    return plan, used


def pack(pieces: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """``pieces`` (at least ``length``) with sequence_id and offset."""
    spark = pieces.sparkSession
    ship(spark)
    folder = folder or shared_dir(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ties = [c for c in ("doc_id", "piece") if c in pieces.columns]
    spread = F.xxhash64(*ties, F.monotonically_increasing_id()) if ties else F.monotonically_increasing_id()
    parted = pieces.withColumn("_spread", spread).repartitionByRange(parts, F.col("length").desc(), F.col("_spread")).sortWithinPartitions(F.col("length").desc(), "_spread").drop("_spread")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = np.asarray(batch.column("length"))
            fresh = np.flatnonzero(np.diff(length, prepend=last))
            if len(length) == 0:
                continue
            base = np.full(len(length), -seen)  # a run that goes on from the batch before
            run = np.searchsorted(fresh, np.arange(len(length)), side="right")
            base[run > 0] = fresh[run[run > 0] - 1]
            ranks = np.arange(len(length)) - base
            last, seen = int(length[-1]), int(ranks[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(ranks, pa.int64())], names=[*batch.schema.names, "_part", "_rank"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "_part int", "_rank long"])
    ranked = materialise(parted.mapInArrow(rank, schema), folder, "ranked")
    # contiguous ranges: at most one row for each partition and each length that begins in it
    counted = sorted((-r["length"], r["_part"], r["n"]) for r in ranked.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, totals = {}, defaultdict(int)
    for length, part, n in counted:
        offsets[-length, part] = totals[-length]
        totals[-length] += n
    if totals and max(totals) > capacity:
        raise ValueError(f"a piece of {max(totals)} ids does not fit into {capacity}")
    plan, _ = best_fit(totals, capacity)
    by_length: dict[int, tuple[np.ndarray, ...]] = {}
    grouped = defaultdict(list)
    for length, *run in plan:
        grouped[length].append(run)
    for length, own in grouped.items():
        by_length[length] = tuple(np.array(c, np.int64) for c in zip(*sorted(own), strict=True))
    shared = spark.sparkContext.broadcast((offsets, by_length))  # bounded by capacity and partitions

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, by_length = shared.value
        for batch in batches:
            length, part, own = (np.asarray(batch.column(c)) for c in ("length", "_part", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n, p in set(zip(length.tolist(), part.tolist(), strict=True)):
                at = np.flatnonzero((length == n) & (part == p))
                ranks = own[at] + offsets[n, p]
                first, _, seq, off = by_length[n]
                k = np.searchsorted(first, ranks, side="right") - 1
                sequence[at], offset[at] = seq[k] + ranks - first[k], off[k]
            columns = [batch.column(c) for c in batch.schema.names if c not in ("_part", "_rank")]
            names = [c for c in batch.schema.names if c not in ("_part", "_rank")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long, offset long"])
    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    folder = shared_dir(docs.sparkSession)
    return pack(materialise(tokenise(docs, tokenizer, capacity), folder, "pieces"), capacity, folder)
