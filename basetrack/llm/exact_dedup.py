"""Exact dedup by an extendible-hash index in shared files.

* combine: within a slice of input, rows with byte-equal texts become one row with the largest doc_id and
  the counts, so a text that a third of all rows hold reaches its owner once a slice.
* own: the 64-bit key space is cut into ranges by its top bits, as many as the number of rows asks for.  An owner task gets
  its ranges sorted by key and inserts them into an extendible hash over the following bits: an overfull bucket splits, and
  the directory doubles when the bucket is as deep as the directory.  Rows with one key are chained and compared by their
  bytes; each distinct text of a chain is an entry.  As keys come in order, a bucket is complete once a later one is
  reached; it is then given out, so a task holds one bucket and one chain.
* the index (bucket prefix, depth, key, place in the chain, digest, survivor, size) is written by Spark's
  committer as Parquet in the shared folder; a lost executor's part is written again.
* look up: an owner's entries of more than one row are laid out for each part of its rows (an owner with many rows has
  many parts, so that a text which a third of all rows hold is many tasks' work); a task inserts them into a directory
  again and probes it with its rows, by bucket, key and digest.  Rows without an entry are alone.

Edge cases: a null text is the empty text; a null doc_id is less than any other; of rows with the same
text and the same largest doc_id, one stays; an empty table gives an empty result; other columns are kept or passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basetrack.llm.common import chunks, materialise, shared_dir, ship

#: Entries of a bucket, and bytes of text that are combined at once.
BUCKET_ENTRIES = 512
COMBINE_BYTES = 32 << 20
#: The key's top bits choose the owner's range: at least 2^12 ranges, so that tasks even out, and about so many rows in one.
RANGE_BITS, RANGE_ROWS = 12, 8192
#: An owner with a share of 1 / BUSY of all rows at least (and PART_ROWS) has its rows looked up in parts.
BUSY, PART_ROWS = 4096, 512


class Directory:
    """An extendible hash directory over one owner's range of 64-bit keys, which are inserted in order."""

    def __init__(self, depth: int, capacity: int = BUCKET_ENTRIES) -> None:
        self.base = self.depth = depth  # bits that the range fixes; bits that the directory looks at
        self.capacity = capacity
        self.slots: list[dict] = [{"depth": depth, "entries": []}]
        self.doublings = 0
        self.current: dict | None = None

    def bucket(self, key: int) -> dict:
        return self.slots[(key >> (64 - self.depth)) & ((1 << (self.depth - self.base)) - 1)] if self.depth else self.slots[0]

    def insert(self, key: int, entries: list) -> dict:
        """Put the chain of one key into its bucket; splits it while it is overfull and its keys differ."""
        b = self.bucket(key)
        b["entries"].append((key, entries))
        while sum(len(e) for _, e in b["entries"]) > self.capacity and len(b["entries"]) > 1 and b["depth"] < 64:
            if b["depth"] == self.depth:
                self.slots = [s for s in self.slots for _ in range(2)]
                self.depth += 1
                self.doublings += 1
            deeper = b["depth"] + 1
            halves = [{"depth": deeper, "entries": []}, {"depth": deeper, "entries": []}]
            for k, e in b["entries"]:
                halves[(k >> (64 - deeper)) & 1]["entries"].append((k, e))
            self.slots = [halves[(i >> (self.depth - deeper)) & 1] if s is b else s for i, s in enumerate(self.slots)]
            b = self.bucket(key)
        return b

    def add(self, key: int, entry: tuple) -> None:
        """One more entry of a key's chain, the last key's or a new one's."""
        own = self.bucket(key)["entries"]
        if own and own[-1][0] == key:  # keys come in order
            own[-1][1].append(entry)
        else:
            self.insert(key, [entry])

    def chain(self, key: int) -> list:
        """The entries of a key, through the directory and its bucket."""
        b = self.bucket(key)
        if "by_key" not in b:
            b["by_key"] = dict(b["entries"])
        return b["by_key"].get(key, [])

    def before(self, key: int) -> Iterator[dict]:
        """Buckets left of the key's with entries: complete, as keys come in order.  Looked for only as the bucket changes."""
        now, last = self.bucket(key), None
        if now is self.current:
            return
        self.current = now
        for s in self.slots:
            if s is now:
                return
            if s is not last and s["entries"]:
                yield s
            last = s

    def rest(self) -> Iterator[dict]:
        last = None
        for s in self.slots:
            if s is not last and s["entries"]:
                yield s
            last = s


_ENTRY = [("owner", "int"), ("bucket", "long"), ("depth", "int"), ("chain", "int"), ("key", "long"), ("text_sha256", "string"), ("keep_id", "long"), ("group_size", "long"), ("n_at_keep", "long")]


def _combine(docs: DataFrame, payload: list[str]) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, payload), byte-equal texts of a slice as one: + n, n_at_keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", COMBINE_BYTES):
            text = pc.fill_null(part.column("text"), "")
            codes = np.asarray(text.dictionary_encode().indices)
            known = np.asarray(part.column("doc_id").is_valid())
            ids = np.where(known, np.asarray(pc.fill_null(part.column("doc_id"), 0)), 0)
            order = np.lexsort((ids, known, codes))  # a null is less than any other
            last = np.append(codes[order][1:] != codes[order][:-1], True)
            n = np.diff(np.concatenate([[-1], np.flatnonzero(last)]))
            top = order[last]
            most, some = np.empty(len(top), np.int64), np.empty(len(top), bool)
            most[codes[top]], some[codes[top]] = ids[top], known[top]
            at = np.bincount(codes, (ids == most[codes]) & (known == some[codes])).astype(np.int64)[codes[top]]
            kept = part.set_column(part.schema.get_field_index("text"), "text", text).take(pa.array(top))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n, pa.int64()), pa.array(at, pa.int64())], names=[*kept.schema.names, "n", "n_at_keep"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n", T.LongType()), T.StructField("n_at_keep", T.LongType())])
    return docs.mapInArrow(run, schema)


def range_bits(rows: int) -> int:
    return min(max(RANGE_BITS, (max(rows, 1) // RANGE_ROWS).bit_length()), 30)


def _owner(bits: int):
    return F.shiftrightunsigned("key", 64 - bits).cast("int")


def build_index(docs: DataFrame, payload: list[str] | None = None, bits: int | None = None) -> DataFrame:
    """The index entries of ``docs`` (doc_id, text): _ENTRY, and with ``payload`` the survivor's text and named columns."""
    ship(docs.sparkSession)
    carry = list(payload or [])
    combined = _combine(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *(docs[c].alias(f"p_{c}") for c in carry)), carry)
    bits = range_bits(docs.count()) if bits is None else bits
    keyed = combined.withColumn("key", F.xxhash64("text")).withColumn("owner", _owner(bits))
    # unsigned order of the keys: their halves' order
    parted = keyed.repartition("owner").sortWithinPartitions("owner", F.col("key") < 0, "key", "text")
    out_schema = T.StructType([T.StructField(n, {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType()}[t]) for n, t in _ENTRY])
    if payload is not None:
        out_schema = T.StructType([*out_schema.fields, T.StructField("text", T.StringType()), *(T.StructField(f"p_{c}", docs.schema[c].dataType) for c in carry)])
    with_text = payload is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory: Directory | None = None
        owner = key = None
        chain: list[list] = []  # [text, doc_id, n, n_at_keep, payload]
        ready: list[tuple] = []

        def give(buckets) -> None:
            for b in buckets:
                for k, entries in b["entries"]:
                    signed = k - (1 << 64) if k >> 63 else k
                    prefix = k >> (64 - b["depth"])
                    for place, (_, sha, keep, n, at, *rest) in enumerate(entries):
                        ready.append((owner, prefix - (1 << 64) if prefix >> 63 else prefix, b["depth"], place, signed, sha, keep, n, at, *rest))
                b["entries"] = []

        def close() -> None:
            if chain:
                for e in chain:  # texts are compared; the index keeps their digests
                    e[5] = hashlib.sha256(e[0].encode()).hexdigest()
                unsigned = key & ((1 << 64) - 1)
                directory.insert(unsigned, [(None, e[5], e[1], e[2], e[3], *((e[0], *e[4]) if with_text else ())) for e in chain])
                give(list(directory.before(unsigned)))

        names = None
        for batch in batches:
            names = names or batch.schema.names
            cols = {n: batch.column(n).to_pylist() for n in names}
            rest = [cols[f"p_{c}"] for c in carry]
            for i, (o, k, text, doc, n, at) in enumerate(zip(cols["owner"], cols["key"], cols["text"], cols["doc_id"], cols["n"], cols["n_at_keep"], strict=True)):
                if (o, k) != (owner, key):
                    close()
                    chain = []
                    if o != owner:
                        if directory is not None:
                            give(directory.rest())
                        directory, owner = Directory(bits), o
                    key = k
                for e in chain:
                    if e[0] == text:
                        e[2] += n
                        if doc is not None and (e[1] is None or doc > e[1]):
                            e[1], e[3], e[4] = doc, at, [r[i] for r in rest]
                        elif doc == e[1]:
                            e[3] += at
                        break
                else:
                    chain.append([text, doc, n, at, [r[i] for r in rest], None])
                if len(ready) >= BUCKET_ENTRIES:
                    yield _rows(ready, out_schema)
                    ready.clear()
        close()
        if directory is not None:
            give(directory.rest())
        if ready:
            yield _rows(ready, out_schema)

    return parted.mapInArrow(run, out_schema)


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the text is shuffled once, to its owner."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    index = build_index(docs, others)
    by = {"doc_id": F.col("keep_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text": F.col("text")} | {c: F.col(f"p_{c}").alias(c) for c in others}
    return index.select(*(by[c] for c in docs.columns))


PROBED = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"


def duplicates(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    folder = folder or shared_dir(docs.sparkSession)
    n = docs.count()
    materialise(build_index(docs, bits=range_bits(n)), folder, "index")
    return look_up(docs, read_index(docs.sparkSession, folder), n)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def look_up(docs: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """PROBED of every row of ``docs``, of which there are ``n``, through the written index of their texts."""
    bits, most = range_bits(n), max(PART_ROWS, n // BUSY)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("key")).withColumn("owner", _owner(bits))
    shared = index.where("group_size > 1").select("owner", "key", F.col("text_sha256").alias("sha"), "keep_id", "group_size", "n_at_keep")
    # owners with many rows in groups, BUSY at most, are named with their parts; all others have one
    busy = F.broadcast(shared.groupBy("owner").agg(F.sum("group_size").alias("n")).where(F.col("n") > most).select(F.col("owner").alias("busy"), F.ceil(F.col("n") / F.lit(most)).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    empty = [F.lit(None).cast("long").alias(c) for c in ("keep_id", "group_size", "n_at_keep")]
    # rows with one doc_id and text are in one part, where the first of them is known
    asked = rows.join(busy, F.col("owner") == F.col("busy"), "left").select("owner", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"), F.lit(1).alias("kind"), "doc_id", "key", "sha", *empty)
    laid = shared.join(busy, F.col("owner") == F.col("busy"), "left").select("owner", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), "key", "sha", "keep_id", "group_size", "n_at_keep")
    both = laid.unionAll(asked).repartition("owner", "part").sortWithinPartitions("owner", "part", "kind", F.col("key") < 0, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, directory, seen = None, Directory(bits), set()
        for batch in batches:
            c = batch.to_pydict()
            out: list[tuple] = []
            for owner, part, kind, doc, key, sha, keep, size, n_at_keep in zip(*(c[n] for n in ("owner", "part", "kind", "doc_id", "key", "sha", "keep_id", "group_size", "n_at_keep")), strict=True):
                if (owner, part) != at:
                    at, directory, seen = (owner, part), Directory(bits), set()
                unsigned = key & ((1 << 64) - 1)
                if kind == 0:
                    directory.add(unsigned, (sha, keep, size, n_at_keep))
                    continue
                found = next((e for e in directory.chain(unsigned) if e[0] == sha), None)
                if found is None:
                    out.append((doc, doc, 1, True, sha))
                    continue
                kept = doc == found[1]
                if kept and found[3] > 1:  # of rows with the same text and doc_id the first
                    kept = (key, sha) not in seen
                    seen.add((key, sha))
                out.append((doc, found[1], found[2], kept, sha))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PROBED.split(", ")])

    return both.mapInArrow(run, PROBED)
