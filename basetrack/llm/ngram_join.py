"""Jaccard join of documents on word n-grams by MinHash banding.

1. sign: each text's set of n-gram hashes gives a key of the whole set, MinHash values and their band hashes.  Bands
   and rows are chosen for a target recall at the threshold.  Texts with one set are one class from here on.
2. band: classes shuffle on band hashes; buckets with the same members as another band's are dropped.  In a
   bucket signatures are compared in blocks, and only a spanning forest of those that may be similar is given out: no
   bucket gives more rows than it has members.  Large buckets are dealt into tiles of block pairs over many tasks.
3. group: components of these forests; a true pair that meets in a band is within one group.
4. verify: a small group's full n-gram sets go to one place.  The sets of a large group go once to its base (the set of its
   least node, laid out as often as the group has parts), and what goes on from there is each set's difference from the base, which
   near copies keep short; differences are dealt into blocks by their bytes and members, and pairs of blocks are tiles over many tasks.
   Overlaps of sets follow exactly from those of their differences.  All pairs are compared in blocks; links are counted by
   document, and a spanning forest of true links is given out.  Components of true links are the classes of near duplicates.

Edge cases: a null text has no words; a text with fewer than ``n`` words has one n-gram, all its words; a text without words
links to nothing, not even to its copies; a null doc_id sorts first; repeated rows are documents that are equal; an empty table gives an empty
result; other columns are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basetrack.llm import text as tx
from basetrack.llm.common import chunks, join_hot, materialise, shared_dir, ship, unused
from basetrack.llm.components import components

#: Members of a bucket that are compared as one (256 bytes each); larger ones become tiles of two blocks of half of it.
TILE = 8192
#: Members and bytes of n-grams of a group that are compared as one, and of a block of a larger group.
GROUP, GROUP_BYTES = 2048, 8 << 20
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Rows of a block whose pairs are in memory at once, and columns of a product.
ROWS, STEP = 256, 2048


@dataclass(frozen=True)
class JoinRules:
    n: int = 5
    threshold: float = 0.8
    #: Of pairs at the threshold, the share that meets in a band.
    recall: float = 0.9999
    most_hashes: int = 128
    #: Standard deviations below the threshold at which a signature still is a candidate.
    slack: float = 4.5

    def bands(self) -> tuple[int, int]:
        """(bands, rows): of the choices within the hashes, the one with the most rows, so with the fewest false candidates."""
        for rows in range(self.most_hashes, 0, -1):
            need = math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**rows)) if self.threshold < 1 else 1
            if need * rows <= self.most_hashes:
                return need, rows
        raise ValueError("no bands reach the recall within most_hashes")

    def candidate(self) -> float:
        """The share of equal signature values from which a pair is a candidate."""
        b, r = self.bands()
        return self.threshold - self.slack * math.sqrt(self.threshold * (1 - self.threshold) / (b * r))


def ngram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct n-gram hashes of each text."""
    w = tx.words(column)
    counts = np.diff(w.first)
    hashes, _, rows = tx.window_hashes(w, n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = tx.mix(tx.span_hashes(w.hashes, tx._C, w.first[short], w.first[short + 1]) + counts[short].astype(np.uint64))
        hashes, rows = np.concatenate([hashes, whole]), np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[fresh], rows[fresh]
    return hashes, np.searchsorted(rows, np.arange(len(column) + 1))


def minhashes(hashes: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """(texts, count) uint32 MinHash values; texts without n-grams get zeros."""
    out = np.zeros((len(bounds) - 1, count), np.uint32)
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return out
    starts = bounds[:-1][some]
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    high = hashes.astype(np.uint32)
    for k in range(count):
        a, b = int(tx.mix(np.array([2 * k + 1], np.uint64))[0]), int(tx.mix(np.array([2 * k + 2], np.uint64))[0])
        v = (low ^ np.uint32(a & 0xFFFFFFFF)) * np.uint32((b | 1) & 0xFFFFFFFF)  # multiply-shift, another half added between rounds
        v ^= v >> np.uint32(15)
        v += high * np.uint32(((a >> 32) | 1) & 0xFFFFFFFF)
        v *= np.uint32(0x9E3779B1)
        v ^= v >> np.uint32(13)
        out[some, k] = np.minimum.reduceat(v, starts)
    return out


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A 128-bit key of each whole set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
    more = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    lo, hi = bounds[:-1], bounds[1:]
    return [x.tobytes() for x in np.stack([sums[hi] - sums[lo], more[hi] - more[lo] + (hi - lo).astype(np.uint64)], 1)]


SIGNED = "row long, doc_id long, text_key long, set_key binary, n_ngrams int, signature binary, bands array<long>"


def sign(docs: DataFrame, rules: JoinRules) -> DataFrame:
    """A row per document: set_key (of its whole set), n_ngrams, signature and band hashes."""
    ship(docs.sparkSession)
    b, r = rules.bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for part in chunks(batches, "text"):
            hashes, bounds = ngram_sets(part.column("text"), rules.n)
            size = np.diff(bounds)
            m = minhashes(hashes, bounds, b * r)
            band = np.zeros((len(m), b), np.uint64)
            for i in range(r):
                band = tx.mix(band * np.uint64(31) + m[:, i::r][:, :b].astype(np.uint64) + np.uint64(i + 1))
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)), part.column("doc_id"), part.column("text_key"), pa.array(set_keys(hashes, bounds), pa.binary()), pa.array(size.astype(np.int32)),
                    pa.array([x.tobytes() for x in m.astype(np.uint16)], pa.binary()), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * b, band.view(np.int64).ravel()),
                ],
                names=["row", "doc_id", "text_key", "set_key", "n_ngrams", "signature", "bands"],
            )
            row += n

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"), docs["text"].alias("text")).mapInArrow(run, SIGNED)


class Forest:
    """Trees over 0..n-1 by their labels; a tree's label is its least member."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> list[int]:
        """Joins i's tree with those of ``others``; of each other tree a member, that now is linked to i."""
        labels, first = np.unique(self.label[others], return_index=True)
        apart = labels != self.label[i]
        if not apart.any():
            return []
        all_labels = np.append(labels[apart], self.label[i])
        self.label[np.isin(self.label, all_labels)] = all_labels.min()
        return others[first[apart]].tolist()


def _tiles(rows: DataFrame, blocks, node: str) -> DataFrame:
    """Adds lo and hi: a group is dealt into ``blocks``, and each pair of blocks is a tile; members go to their block's tiles."""
    own = F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = rows.withColumn("_blocks", blocks.cast("int")).withColumn("_own", own).withColumn("_other", each)
    return dealt.withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other")}).drop("_blocks", "_other")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a sorted stream, one at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        fresh = np.zeros(batch.num_rows, bool)
        for c in cols:
            fresh[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cuts = [0, *np.flatnonzero(fresh).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and (lo or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _block_pairs(own: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The members to compare in a tile: all pairs of one block, or all between two."""
    if lo == hi:
        at = np.arange(len(own))
        return at, at, True
    return np.flatnonzero(own == lo), np.flatnonzero(own == hi), False


def candidate_forest(buckets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of a spanning forest of each bucket tile; buckets: bucket, lo, hi, _own, node, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["bucket", "lo", "hi"]):
            node = np.asarray(group.column("node"))
            sign = np.stack([np.frombuffer(x, np.uint16) for x in group.column("signature").to_pylist()])
            left, right, same = _block_pairs(np.asarray(group.column("_own")), group.column("lo")[0].as_py(), group.column("hi")[0].as_py())
            need = least * sign.shape[1]
            forest, out = Forest(len(node)), []
            for k, i in enumerate(left.tolist()):
                others = right[k + 1 :] if same else right
                others = others[forest.label[others] != forest.label[i]]  # not yet in its tree
                for at in range(0, len(others), ROWS * 8):
                    some = others[at : at + ROWS * 8]
                    close = some[(sign[some] == sign[i]).sum(1) >= need]
                    out += [(node[i], node[j]) for j in (forest.join(i, close) if len(close) else ())]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return buckets.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node").mapInArrow(run, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) numbers of common elements of sets, by way of the elements that are on both sides.

    An element that few pairs share is listed by its pairs; others are columns of a product.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    x, y = (np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (left, right))
    i, j = (np.repeat(np.arange(len(side)), [len(v) for v in side]) for side in (left, right))
    by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    x, i, y, j = x[by_x], i[by_x], y[by_y], j[by_y]
    value, first, n = np.unique(x, return_index=True, return_counts=True)
    lo, hi = np.searchsorted(y, value), np.searchsorted(y, value, side="right")
    some = hi > lo
    first, n, lo, m = first[some], n[some], lo[some], (hi - lo)[some]
    rare = n * m * 256 <= out.size
    for at in _slices((n * m)[rare], 1 << 20):
        a, na, b, nb = first[rare][at], n[rare][at], lo[rare][at], m[rare][at]
        pairs = na * nb
        k = np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        width = np.repeat(nb, pairs)
        cell = i[np.repeat(a, pairs) + k // width] * len(right) + j[np.repeat(b, pairs) + k % width]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape).astype(np.float32)
    often = np.flatnonzero(~rare)
    for at in range(0, len(often), STEP):
        part = often[at : at + STEP]
        sides = []
        for begin, count, row, size in ((first, n, i, len(left)), (lo, m, j, len(right))):
            column = np.repeat(np.arange(len(part)), count[part])
            place = np.repeat(begin[part] - (np.cumsum(count[part]) - count[part]), count[part]) + np.arange(len(column))
            dense = np.zeros((size, len(part)), np.float32)
            dense[row[place], column] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of ``sizes`` that sum to at most ``most`` (a larger one is a run of its own)."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = max(int(np.searchsorted(ends, before + most, side="right")), at + 1)
        yield slice(at, end)
        at = end


VERIFIED = "node long, other long, links long, docs long"


def verify_groups(groups: DataFrame, threshold: float) -> DataFrame:
    """For each tile: (node, other: null, links, docs) of each member with links, and (node, other) of a spanning forest of links.

    groups: grp, lo, hi, _own, node, docs (documents of the class), n_ngrams, base (n-grams of the group's base), gone (of these,
    how many the set hasn't), ngrams (the set's difference from the base as bytes; without a base, the set).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["grp", "lo", "hi"]):
            node, docs, size, gone = (np.asarray(group.column(c)) for c in ("node", "docs", "n_ngrams", "gone"))
            base = group.column("base")[0].as_py()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("ngrams")]
            left, right, same = _block_pairs(np.asarray(group.column("_own")), group.column("lo")[0].as_py(), group.column("hi")[0].as_py())
            links, weight = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
            forest, edges = Forest(len(node)), []
            for at in range(0, len(left), ROWS):
                rows = left[at : at + ROWS]
                for to in range(at if same else 0, len(right), BLOCK):  # of one block, each pair once
                    cols = right[to : to + BLOCK]
                    common = overlaps([sets[k] for k in rows], [sets[k] for k in cols]) + (base - gone[rows][:, None] - gone[cols][None, :])
                    # J >= t as common >= t * union, with room for the rounding of t alone
                    hit = common + 1e-9 >= threshold * (size[rows][:, None] + size[cols][None, :] - common)
                    if same:
                        hit &= (to + np.arange(len(cols)))[None, :] > (at + np.arange(len(rows)))[:, None]
                    links[rows] += hit.sum(1)
                    weight[rows] += hit @ docs[cols]
                    links[cols] += hit.sum(0)
                    weight[cols] += docs[rows] @ hit
                    for i in np.flatnonzero(hit.any(1)).tolist():
                        edges += [(node[rows[i]], node[j]) for j in forest.join(rows[i], cols[hit[i]])]
            some = np.flatnonzero(links)
            nodes = [*node[some].tolist(), *(int(a) for a, _ in edges)]
            if nodes:
                none = [None] * len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array([*none, *(int(b) for _, b in edges)], pa.int64()), pa.array([*links[some].tolist(), *[0] * len(edges)], pa.int64()), pa.array([*weight[some].tolist(), *[0] * len(edges)], pa.int64())],
                    names=["node", "other", "links", "docs"],
                )

    return groups.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "node").mapInArrow(run, VERIFIED)


DIFFERENCES = "grp long, node long, docs long, n_ngrams long, base long, gone long, ngrams binary"


def differences(members: DataFrame, folder: str) -> DataFrame:
    """DIFFERENCES of the members of large groups from their group's base, dealt into tiles; members: grp, size, node, docs, n_ngrams, ngrams.

    A group has a part for each GROUP members, and its base goes to every part.
    """
    parts = F.ceil(F.col("size") / F.lit(GROUP)).cast("int")
    dealt = members.withColumns({"part": F.pmod(F.xxhash64("node"), parts).cast("int"), "kind": F.lit(1)})
    bases = members.where("node = grp").withColumns({"part": F.explode(F.sequence(F.lit(0), parts - 1)), "kind": F.lit(0)})
    columns = ["grp", "part", "kind", "node", "docs", "n_ngrams", "ngrams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, of = np.zeros(0, np.uint64), None
        for batch in batches:
            grp, part, kind = (batch.column(c).to_pylist() for c in ("grp", "part", "kind"))
            rows, held = [], 0
            for i, raw in enumerate(batch.column("ngrams")):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if kind[i] == 0:
                    base, of = own.copy(), (grp[i], part[i])
                    continue
                if of != (grp[i], part[i]):
                    raise ValueError(f"group {grp[i]} has no base")
                other = np.setxor1d(base, own, assume_unique=True)
                rows.append((grp[i], batch.column("node")[i].as_py(), batch.column("docs")[i].as_py(), len(own), len(base), (len(base) - len(own) + len(other)) // 2, other.tobytes()))
                held += other.nbytes
                if held > BLOCK_BYTES:
                    yield give(rows)
                    rows, held = [], 0
            if rows:
                yield give(rows)

    def give(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in DIFFERENCES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ngrams" else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)

    both = bases.select(*columns).unionAll(dealt.select(*columns)).repartition("grp", "part").sortWithinPartitions("grp", "part", "kind")
    out = materialise(both.mapInArrow(run, DIFFERENCES), folder, "differences")
    # a row for each large group
    sizes = out.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("ngrams")) / BLOCK_BYTES), F.lit(1)).alias("blocks"))
    return _tiles(out.join(materialise(sizes, folder, "blocks"), "grp"), F.col("blocks"), "node")


def class_sets(docs: DataFrame, carriers: DataFrame, n: int) -> DataFrame:
    """(set_key, ngrams) of the documents that ``carriers`` names by doc_id, one row a set.

    ``carriers`` is a written table, so Spark knows its size: within its broadcast limit no text is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            hashes, bounds = ngram_sets(part.column("text"), n)
            raw = hashes.tobytes()
            sets = [raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(hashes, bounds), pa.binary()), pa.array(sets, pa.binary())], names=["set_key", "ngrams"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    wanted = rows.join(carriers, rows["doc_id"].eqNullSafe(carriers["carrier"]), "left_semi")
    # a doc_id that names several texts can bring a set twice
    return wanted.select("text").mapInArrow(run, "set_key binary, ngrams binary").groupBy("set_key").agg(F.first("ngrams").alias("ngrams"))


def near_duplicates(docs: DataFrame, rules: JoinRules = JoinRules(), folder: str | None = None) -> DataFrame:
    """One row per document: row, doc_id, text_key, set_id (the class of equal sets), class_id (the component of links), n_links, n_class_links.

    n_links counts the other documents at or above the threshold, copies too; n_class_links the linked classes.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    signed = materialise(sign(docs, rules), folder, "signed")
    some = signed.where("n_ngrams > 0")
    classes = materialise(some.groupBy("set_key").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("docs"), F.first("n_ngrams").cast("long").alias("n_ngrams"), F.first("signature").alias("signature"), F.first("bands").alias("bands"), F.min("doc_id").alias("least_doc")), folder, "classes")

    banded = classes.select("node", F.posexplode("bands").alias("band", "h"))
    met = banded.groupBy("band", "h").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("first")).where("size > 1")
    # a bucket with the members of another band's adds nothing
    buckets = materialise(met.groupBy("size", "members", "first").agg(F.min(F.struct("band", "h")).alias("x")).select("x.band", "x.h", "size").withColumn("bucket", F.monotonically_increasing_id()), folder, "buckets")
    inside = banded.join(buckets, ["band", "h"]).select("bucket", "size", "node")
    blocks = F.when(F.col("size") > TILE, F.ceil(F.col("size") / F.lit(TILE // 2))).otherwise(1)
    tiles = _tiles(inside.join(classes.select("node", "signature"), "node"), blocks, "node")
    edges = candidate_forest(tiles.select("bucket", "lo", "hi", "_own", "node", "signature"), rules.candidate())
    grouped = materialise(components(edges, folder, "candidates"), folder, "groups")

    own = grouped.join(classes.select("node", "docs", "set_key", "n_ngrams"), "node")
    sized = own.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n_ngrams").alias("ngrams_in_all"))
    n_rows = signed.count()
    member = materialise(join_hot(own, sized, ["component"], "size", n_rows, "node").select(F.col("component").alias("grp"), "size", ((F.col("size") > GROUP) | (F.col("ngrams_in_all") * 8 > GROUP_BYTES)).alias("large"), "node", "docs", "n_ngrams", "set_key"), folder, "members")
    # the first row of a class carries its set
    carriers = materialise(member.select(F.col("node").alias("row")).join(signed.select("row", "doc_id"), "row").select(F.col("doc_id").alias("carrier")).distinct(), folder, "carriers")
    sets = materialise(member.join(class_sets(docs, carriers, rules.n), "set_key").drop("set_key"), folder, "sets")
    small = sets.where("not large").withColumns({"base": F.lit(0).cast("long"), "gone": F.lit(0).cast("long")} | {c: F.lit(0) for c in ("lo", "hi", "_own")})
    columns = ["grp", "lo", "hi", "_own", "node", "docs", "n_ngrams", "base", "gone", "ngrams"]
    full = small.select(*columns)
    if not member.where("large").isEmpty():
        full = full.unionAll(differences(sets.where("large"), folder).select(*columns))
    verified = materialise(verify_groups(full, rules.threshold), folder, "verified")
    counts = verified.where("other is null").groupBy("node").agg(F.sum("links").alias("n_class_links"), F.sum("docs").alias("linked_docs"))
    linked = components(verified.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), folder, "links")
    # a component goes by the least doc_id in it
    named = materialise(linked.join(classes.select("node", "least_doc"), "node"), folder, "named")
    least = named.groupBy("component").agg(F.min("least_doc").alias("class_id"), F.count(F.lit(1)).alias("size"))
    classed = join_hot(named.select("node", "component"), least, ["component"], "size", n_rows, "node")
    per_class = classes.select("set_key", "node", "docs", "least_doc").join(classed.select("node", "component", "class_id"), "node", "left").join(counts, "node", "left")
    per_class = materialise(per_class.select("set_key", "docs", F.col("least_doc").alias("set_id"), F.coalesce("component", "node").alias("component"), F.coalesce("class_id", "least_doc").alias("class_id"), (F.col("docs") - 1 + F.coalesce("linked_docs", F.lit(0))).alias("n_links"), F.coalesce("n_class_links", F.lit(0)).alias("n_class_links")), folder, "per_class")
    out = join_hot(signed.select("row", "doc_id", "text_key", "set_key", "n_ngrams"), per_class, ["set_key"], "docs", n_rows, "row", "left")
    own = F.col("n_ngrams") > 0
    return out.select("row", "doc_id", "text_key", F.when(own, F.col("set_id")).otherwise(F.col("doc_id")).alias("set_id"), F.when(own, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(own, F.col("component")).otherwise(F.col("row")).alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_class_links", F.lit(0)).cast("long").alias("n_class_links"))


def first_of_groups(docs: DataFrame, rules: JoinRules = JoinRules(), folder: str | None = None) -> DataFrame:
    """``docs`` without the near duplicates: of each component of links the row with the least doc_id stays.

    Rows with one doc_id and one text are one document.
    """
    folder = folder or shared_dir(docs.sparkSession)
    decided = materialise(near_duplicates(docs, rules, folder).select("doc_id", "text_key", "component"), folder, "decided")
    name = F.struct("doc_id", "text_key")
    keeper = decided.groupBy("component").agg(F.min(name).alias("keeper"), F.count(F.lit(1)).alias("size"))
    losers = materialise(join_hot(decided, keeper, ["component"], "size", decided.count(), "text_key").where(~name.eqNullSafe(F.col("keeper"))).select(F.col("doc_id").alias("lost"), F.col("text_key").alias("lost_key")).distinct(), folder, "losers")
    key, lost, lost_key = unused(docs.columns, "key", "lost", "lost_key")
    keyed, gone = docs.withColumn(key, F.xxhash64(docs["text"])), losers.toDF(lost, lost_key)
    kept = keyed.join(gone, keyed["doc_id"].cast("long").eqNullSafe(gone[lost]) & (keyed[key] == gone[lost_key]), "left_anti")
    if not decided.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", key])
    return kept.select(*docs.columns)
