"""Perplexity filter: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

* count: tasks count the packed n-grams of their trusted texts by language; one aggregate sums them.  An n-gram of up to 5
  bytes fits a long, so its history and its suffix are shifts, and everything below is SQL on the counts: lower orders count
  distinct left neighbours, discounts come from the counts of counts, histories give the weights of the lower order.
* shards: log probabilities and log weights, sorted by key, are written to the shared folder in shards by range of the key.
* score: a task takes the distinct n-grams of a slice of whole texts and joins them with the shards one after another, a
  merge of sorted keys; missing ones back off to the next order.  Texts aren't shuffled for it; some shards and a slice are in memory.
* threshold: per language, quantiles of the trusted texts' perplexities, widened by a factor; the upper one is of texts that weren't counted.

Edge cases: a null or empty text has no perplexity and isn't kept; a null language is a language; a language without trusted text is scored by
byte frequencies of none (uniform), and kept, as nothing is known of it; repeated rows are rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basetrack.llm import text as tx
from basetrack.llm.common import chunks, materialise, shared_dir, ship

ORDER = 5
SLICE_BYTES = 4 << 20
SHARD_ROWS = 1 << 21
#: Rows of the model that a task holds from slice to slice; shards beyond them are read again for each slice.
HELD_ROWS = 1 << 23
#: What a key has bits for.
MOST_LANGUAGES = 1 << 19


@dataclass(frozen=True)
class Quantiles:
    low: float = 0.002
    high: float = 0.998
    margin: float = 1.1
    #: A language with fewer held-out texts takes its upper limit from all its trusted texts.
    least_held: int = 100


def packed(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte of the texts, in ORDER bytes of a long; a text begins after line breaks."""
    at = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = np.zeros(len(data), np.int64)
    for k in range(ORDER - 1, -1, -1):
        moved = np.full(len(data), 0x0A, np.int64)
        if k < len(data):
            moved[k:] = data[: len(data) - k]
        out = (out << 8) | np.where(at >= k, moved, 0x0A)
    return out


def count_ngrams(docs: DataFrame, ids: str | None = None) -> DataFrame:
    """(lang_id, g, c) of the texts whose doc_id is a key of the shards ``ids`` (None: of all); docs: doc_id, lang_id, text.

    Tasks look their documents up in the sorted shards, so no text is shuffled to find the trusted ones, however many there are.
    """
    ship(docs.sparkSession)

    def trusted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ids is None:
            yield from batches
            return
        shards = Shards(ids)
        for batch in batches:
            known = np.asarray(batch.column("doc_id").is_valid())
            own, inverse = np.unique(np.asarray(pc.fill_null(batch.column("doc_id"), 0)), return_inverse=True)
            yield batch.filter(pa.array(~np.isnan(shards.find(own))[inverse] & known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_keys, total = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def give() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(total_keys), 1 << 18):
                k, c = total_keys[lo : lo + (1 << 18)], total[lo : lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array((k >> 40).astype(np.int32)), pa.array(k & ((1 << 40) - 1)), pa.array(c)], names=["lang_id", "g", "c"])

        for part in chunks(trusted(batches), "text", SLICE_BYTES):
            data, bounds = tx.column_bytes(part.column("text"))
            lang = np.repeat(np.asarray(part.column("lang_id")).astype(np.int64), np.diff(bounds))
            keys, counts = np.unique((lang << 40) | packed(data, bounds), return_counts=True)
            both = np.concatenate([total_keys, keys])
            total_keys, inverse = np.unique(both, return_inverse=True)
            total = np.bincount(inverse, np.concatenate([total, counts])).astype(np.int64)
            if len(total_keys) > 1 << 21:
                yield from give()
                total_keys, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from give()

    return docs.mapInArrow(run, "lang_id int, g long, c long").groupBy("lang_id", "g").agg(F.sum("c").alias("c"))


def _key(kind: int, order: int, gram):
    """lang_id, kind (0: probability, 1: weight of the lower order), order and bytes in one long."""
    return F.shiftleft(F.col("lang_id").cast("long"), 44) + F.lit((kind << 43) + (order << 40)).cast("long") + gram


def model(counts: DataFrame, folder: str) -> DataFrame:
    """(key, value) of an interpolated modified Kneser-Ney model from highest-order counts (lang_id, g, c)."""
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # distinct left neighbours
        by_order[k] = materialise(by_order[k + 1].select("lang_id", F.col("g").bitwiseAND((1 << 8 * k) - 1).alias("g")).groupBy("lang_id", "g").agg(F.count(F.lit(1)).alias("c")), folder, f"order-{k}")
    out, lower = [], None
    for k in range(1, ORDER + 1):
        grams = by_order[k]
        n = grams.groupBy("lang_id").agg(*(F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        ratio = lambda i: F.when(F.col(f"n{i}") > 0, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(0.5)
        discounts = n.select("lang_id", *(F.greatest(F.least(ratio(i), F.lit(float(i))), F.lit(0.05)).alias(f"d{i}") for i in (1, 2, 3)))
        h = F.shiftright("g", 8)
        amount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        lessened = grams.join(F.broadcast(discounts), "lang_id").select("lang_id", "g", h.alias("h"), F.col("c").cast("double").alias("c"), amount.alias("d"))  # a row a language
        history = lessened.groupBy("lang_id", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
        own = lessened.join(history, ["lang_id", "h"])
        weight = F.col("freed") / F.col("total")
        if lower is None:
            p = own.select("lang_id", "g", ((F.col("c") - F.col("d")) / F.col("total") + weight / 256).alias("p"))
        else:
            short = own.withColumn("s", F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1))
            p = short.join(lower.select("lang_id", F.col("g").alias("s"), F.col("p").alias("q")), ["lang_id", "s"]).select("lang_id", "g", ((F.col("c") - F.col("d")) / F.col("total") + weight * F.col("q")).alias("p"))
        lower = materialise(p, folder, f"p-{k}")
        out.append(lower.select(_key(0, k, F.col("g")).alias("key"), F.log("p").alias("value")))
        out.append(history.select(_key(1, k, F.col("h")).alias("key"), F.log(weight).alias("value")))
    return reduce(DataFrame.unionAll, out)


def write_shards(table: DataFrame, folder: str, name: str = "model") -> str:
    """The place of (key, value) in sorted shards by range of the key."""
    path = f"{folder}/{name}-shards"
    rows = materialise(table, folder, name)
    n = max(1, -(-rows.count() // SHARD_ROWS))
    rows.repartitionByRange(n, "key").sortWithinPartitions("key").write.parquet(path)
    return path


class Shards:
    """Sorted key shards in the shared folder, looked up one after another."""

    def __init__(self, place: str) -> None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.pq = pq
        self.system, root = fs.FileSystem.from_uri(place)
        self.files = sorted(x.path for x in self.system.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet"))
        self.held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.range: dict[str, tuple[int, int]] = {}  # of keys of files that were read

    def _read(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        if path in self.held:
            return self.held[path]
        t = self.pq.read_table(path, filesystem=self.system)
        key, value = np.asarray(t.column("key")), np.asarray(t.column("value"))
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key)
            key, value = key[order], value[order]
        if sum(len(k) for k, _ in self.held.values()) + len(key) <= HELD_ROWS:
            self.held[path] = key, value
        return key, value

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of sorted keys; nan where there is none."""
        out = np.full(len(keys), np.nan)
        for path in self.files if len(keys) else ():
            if path in self.range and (keys[-1] < self.range[path][0] or keys[0] > self.range[path][1]):
                continue
            have, value = self._read(path)
            if not len(have):
                continue
            self.range[path] = int(have[0]), int(have[-1])
            lo, hi = np.searchsorted(keys, have[0]), np.searchsorted(keys, have[-1], side="right")
            at = np.minimum(np.searchsorted(have, keys[lo:hi]), len(have) - 1)
            hit = have[at] == keys[lo:hi]
            out[lo:hi][hit] = value[at[hit]]
        return out


def log_probabilities(lang: np.ndarray, grams: np.ndarray, shards: Shards) -> np.ndarray:
    """Log probability of the last byte of each distinct (language, n-gram) by interpolation and back-off."""
    head = lang.astype(np.int64) << 44
    wanted, where = [], []
    for k in range(1, ORDER + 1):
        short = grams & ((1 << 8 * k) - 1)
        for kind, g in ((0, short), (1, short >> 8)):
            keys, inverse = np.unique(head + (kind << 43) + (k << 40) + g, return_inverse=True)
            wanted.append(keys)
            where.append(inverse)
    every = np.unique(np.concatenate(wanted))
    found = shards.find(every)
    value = [found[np.searchsorted(every, keys)][inverse] for keys, inverse in zip(wanted, where, strict=True)]
    out = np.full(len(grams), -np.log(256.0))
    for k in range(1, ORDER + 1):
        p, weight = value[2 * k - 2], value[2 * k - 1]
        out = np.where(np.isnan(p), np.nan_to_num(weight, nan=0.0) + out, p)
    return out


def score(docs: DataFrame, place: str) -> DataFrame:
    """doc_id, lang_id, n_bytes, perplexity (a byte) of every row; docs: doc_id, lang_id, text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(place)
        for part in chunks(batches, "text", SLICE_BYTES):
            data, bounds = tx.column_bytes(part.column("text"))
            size = np.diff(bounds)
            lang = np.repeat(np.asarray(part.column("lang_id")).astype(np.int64), size)
            keys, inverse = np.unique((lang << 40) | packed(data, bounds), return_inverse=True)
            logs = log_probabilities(keys >> 40, keys & ((1 << 40) - 1), shards)
            total = np.bincount(np.repeat(np.arange(len(size)), size), logs[inverse], len(size))
            value = np.exp(-total / np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang_id"), pa.array(size.astype(np.int64)), pa.array(value, mask=size == 0)], names=["doc_id", "lang_id", "n_bytes", "perplexity"])

    return docs.select("doc_id", "lang_id", "text").mapInArrow(run, "doc_id long, lang_id int, n_bytes long, perplexity double")


def perplexity_filter(docs: DataFrame, trusted_ids: DataFrame, limits: Quantiles = Quantiles(), folder: str | None = None) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, low, high, kept of every row; trusted_ids: doc_id of the texts to learn from.

    A fifth of the trusted texts (by hash of the doc_id) is not counted: a language's upper limit is the quantile of their perplexities.  The
    lower limit, which texts said again and again fall below, is that of all trusted texts, as those that were counted are the lowest.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"))
    named = rows.select("lang").distinct()
    languages = materialise(named.withColumn("lang_id", (F.row_number().over(Window.orderBy("lang")) - 1).cast("int")), folder, "languages")  # a row a language
    if languages.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    by_name = languages.select(F.col("lang").alias("l"), "lang_id")
    known = rows.join(by_name, F.col("lang").eqNullSafe(F.col("l"))).drop("l")
    trusted = materialise(trusted_ids.select(F.col("doc_id").cast("long").alias("trusted")).where("trusted is not null").distinct().withColumn("held", F.crc32(F.concat(F.lit("held|"), F.col("trusted").cast("string"))) % 5 == 0), folder, "trusted")
    learnt = write_shards(trusted.where("not held").select(F.col("trusted").alias("key"), F.lit(1.0).alias("value")), folder, "learnt")
    counts = materialise(count_ngrams(known.select("doc_id", "lang_id", "text"), learnt), folder, "counts")
    place = write_shards(model(counts, folder), folder)
    scored = materialise(score(known, place), folder, "scored")
    own = scored.join(trusted, F.col("doc_id") == F.col("trusted")).where("n_bytes > 0")
    p, held = F.col("perplexity"), F.col("held")
    top = F.when(F.count_if(held) >= limits.least_held, F.percentile_approx(F.when(held, p), limits.high, 10000)).otherwise(F.percentile_approx(p, limits.high, 10000))
    bounds = own.groupBy("lang_id").agg((F.percentile_approx(p, limits.low, 10000) / limits.margin).alias("low"), (top * limits.margin).alias("high"))
    bounds = materialise(languages.join(bounds, "lang_id", "left"), folder, "bounds")
    joined = scored.join(bounds, "lang_id")  # a row a language
    kept = F.coalesce(F.when(F.col("high").isNull(), F.col("n_bytes") > 0).otherwise(F.col("perplexity").between(F.col("low"), F.col("high"))), F.lit(False))
    return joined.select("doc_id", "lang", "n_bytes", "perplexity", "low", "high", kept.alias("kept"))
