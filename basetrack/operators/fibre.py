"""Fibre reads to tracks: five channels a read, placed on the reference, with counts of what was called.

A read becomes spans (a call is a span of one base); spans become bases by ``explode``.  Reads go through Python because their
tags are a format of their own; nothing is shuffled until the caller groups or sorts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basetrack.functions import fibers

CHANNELS = ("m6a", "cpg", "nuc", "msp", "fire")
SPANS = "file string, ordinal long, chrom string, channel string, lo long, hi long, value int"
STATS = "file string, ordinal long, m6a_calls int, m6a_unplaced int, cpg_calls int, cpg_unplaced int, at_bases int, nuc_calls int, msp_calls int, fire_calls int, status int"
_FIELDS = ("file", "ordinal", "chrom", "start", "flag", "cigar", "seq", "tags")


def read_spans(start: int, flag: int, cigar: str, seq: str, tags: dict[str, str], channels: tuple[str, ...] = CHANNELS, threshold: int | None = None) -> tuple[dict[str, list[tuple[int, int, int]]], dict[str, int]]:
    """({channel: spans (lo, hi, value) in order}, statistics) of one read.

    A call of probability 0 is none; with ``threshold`` calls that reach it are 1 and others go.
    """
    places = fibers.reference_positions(start, cigar)
    spans: dict[str, list[tuple[int, int, int]]] = {}
    stats = {"status": 0}
    mm = tags.get("MM", tags.get("Mm"))
    for channel in ("m6a", "cpg"):
        if channel not in channels or mm is None:
            continue
        if not seq or seq == "*" or len(seq) != len(places):
            stats["status"] |= fibers.NO_SEQUENCE
            continue
        ml = [int(x) for x in tags.get("ML", tags.get("Ml", "")).split(",") if x]
        at, probability, status = fibers.read_calls(seq, flag, mm, ml, channel)
        if len(at) and (at[1:] == at[:-1]).any():
            status |= fibers.DUPLICATE
        here = places[at]
        kept = (here >= 0) & (probability >= max(threshold or 1, 1))
        value = np.ones(len(at), np.int64) if threshold is not None else probability
        spans[channel] = sorted((int(p), int(p) + 1, int(v)) for p, v in zip(here[kept], value[kept], strict=True))
        stats |= {f"{channel}_calls": len(at), f"{channel}_unplaced": int((here < 0).sum()), "status": stats["status"] | status}
        stats["at_bases"] = sum(map(seq.upper().count, "AT"))
    if any(c in channels for c in ("nuc", "msp", "fire")):
        for channel, (first, length, value) in fibers.molecule_features(tags).items():
            if channel in channels:
                own = [(fibers.place_interval(int(a), int(n), places, flag), int(v)) for a, n, v in zip(first, length, value, strict=True)]
                spans[channel] = sorted((*s, min(v, 255)) for s, v in own if s is not None)
                if any(b[0] < a[1] for a, b in zip(spans[channel], spans[channel][1:], strict=False)):
                    raise ValueError(f"two {channel} spans of a read share a base")
            stats[f"{channel}_calls"] = len(first) if channel in channels else 0
    return spans, stats


def _mapped(reads: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for fields in zip(*(batch.column(c).to_pylist() for c in _FIELDS), strict=True) for r in rows_of(*fields)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return reads.select(*_FIELDS).mapInArrow(run, schema)


def spans(reads: DataFrame, channels: tuple[str, ...] = CHANNELS, threshold: int | None = None) -> DataFrame:
    """SPANS of all reads; reads have file, ordinal, chrom, start, flag, cigar, seq and tags (a map of SAM tags)."""

    def rows(file, ordinal, chrom, start, flag, cigar, seq, tags):
        found, _ = read_spans(start, flag, cigar, seq, dict(tags or {}), channels, threshold)
        return [(file, ordinal, chrom, c, *s) for c, own in found.items() for s in own]

    return _mapped(reads, SPANS, rows)


def statistics(reads: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """STATS of all reads; null where a channel isn't read or a read has no calls tag."""

    def rows(file, ordinal, chrom, start, flag, cigar, seq, tags):
        _, stats = read_spans(start, flag, cigar, seq, dict(tags or {}), channels)
        return [(file, ordinal, *(stats.get(x.split()[0]) for x in STATS.split(", ")[2:]))]

    return _mapped(reads, STATS, rows)


def modifications(reads: DataFrame, channel: str, threshold: int = 1) -> DataFrame:
    """(file, ordinal, chrom, pos, channel, probability) of calls that are placed and reach the threshold."""
    found = spans(reads, (channel,)).where(F.col("value") >= threshold)
    return found.select("file", "ordinal", "chrom", F.col("lo").alias("pos"), "channel", F.col("value").alias("probability"))


def bases(found: DataFrame) -> DataFrame:
    """Spans as single bases, with ``pos``."""
    return found.withColumn("pos", F.explode(F.sequence("lo", F.col("hi") - 1))).drop("lo", "hi")


def kept(reads: DataFrame, least_mapq: int = 0, primary_only: bool = False, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Reads that are mapped, primary (supplementary ones too, unless ``primary_only``), of that quality, with a tag of a channel."""
    from basetrack.functions.reads import SECONDARY, SUPPLEMENTARY, UNMAPPED, has

    flag = F.col("flag")
    own = reads.where(~has(flag, UNMAPPED) & ~has(flag, SECONDARY) & (F.col("mapq") >= least_mapq) & has_tags(channels))
    return own.where(~has(flag, SUPPLEMENTARY)) if primary_only else own


def has_tags(channels: tuple[str, ...] = CHANNELS) -> Column:
    """Whether a read has any tag that a channel is made from."""
    tags = {"m6a": ("MM", "Mm"), "cpg": ("MM", "Mm"), "nuc": ("ns", "Ma", "MA"), "msp": ("as", "Ma", "MA"), "fire": ("as", "Ma", "MA")}
    out = F.lit(False)
    for tag in sorted({t for c in channels for t in tags[c]}):
        out = out | F.map_contains_key("tags", tag)
    return out


def tracks(reads: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(track_id, file, ordinal, channel, name): a track for each read and channel, in the order of files and reads; names are unique.

    Reads are ranked in ranges, not in one task.
    """
    from basetrack.operators.counting import ranked, unique_names

    named = unique_names(reads.select("file", "ordinal", "qname", "chrom", "start"))
    files = named.select("file").distinct().withColumn("part", F.dense_rank().over(_by("file")).cast("long"))  # a row a file
    own = ranked(named.join(files, "file").withColumn("place", F.shiftleft("part", 40) + F.col("ordinal")), "place", "rank")
    each = own.select("file", "ordinal", "rank", F.col("track").alias("read"), F.posexplode(F.array(*map(F.lit, channels))).alias("k", "channel"))
    return each.select((F.col("rank") * len(channels) + F.col("k")).alias("track_id"), "file", "ordinal", "channel", F.concat_ws(".", "read", "channel").alias("name"))


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def signal(reads: DataFrame, chroms: DataFrame, channels: tuple[str, ...] = CHANNELS, threshold: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(signal, tracks) of fibre reads: runs on the reference within the chromosomes, and the track of each read and channel."""
    from basetrack.operators.counting import clip_runs

    table = tracks(reads, channels)
    found = spans(reads, channels, threshold).select("file", "ordinal", "channel", "chrom", F.col("lo").alias("start"), F.col("hi").alias("end"), F.col("value").cast("double").alias("value"))
    placed = clip_runs(found, chroms).join(table.select("track_id", "file", "ordinal", "channel"), ["file", "ordinal", "channel"])
    return placed.select("chrom", "start", "end", "track_id", "value"), table
