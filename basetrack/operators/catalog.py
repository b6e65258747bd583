"""Catalogue operators: selecting tracks, uniting, re-sorting and splitting datasets, checking axes."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select(tracks: DataFrame, **attributes: object) -> DataFrame:
    """Tracks whose JSON ``attrs`` equal all given values, by type too; an attribute that no track has is an error that names the keys."""
    if attributes:
        keys = {r[0] for r in tracks.select(F.explode(F.json_object_keys("attrs")).alias("k")).distinct().collect()}  # bounded by the attribute names
        unknown = sorted(set(attributes) - keys)
        if unknown:
            raise ValueError(f"no track has {', '.join(unknown)}; there are {', '.join(sorted(keys))}")
    out = tracks
    for name, value in attributes.items():
        path = "$[" + json.dumps(name) + "]"
        found = F.try_variant_get(F.parse_json("attrs"), path, "variant")
        out = out.where(F.to_json(found) == json.dumps(value, separators=(",", ":"), ensure_ascii=False))
    return out


def union_signals(signals: Sequence[DataFrame], sizes: Sequence[int]) -> DataFrame:
    """The tracks of several datasets one after another; ``sizes`` are their numbers of tracks."""
    out, base = None, 0
    for signal, size in zip(signals, sizes, strict=True):
        moved = signal.withColumn("track_id", (F.col("track_id") + base).cast("int"))
        out = moved if out is None else out.unionByName(moved)
        base += size
    return out


def check_names(tables: Sequence[DataFrame]) -> None:
    """Track names of several datasets must be distinct."""
    names = None
    for t in tables:
        names = t.select("name") if names is None else names.unionByName(t.select("name"))
    twice = [r[0] for r in names.groupBy("name").count().where("count > 1").select("name").limit(5).collect()]
    if twice:
        raise ValueError(f"tracks with one name: {', '.join(twice)}")


def same_axes(a: DataFrame, b: DataFrame) -> None:
    """Shared chromosomes must have one length, and some must be shared."""
    both = a.select("chrom", F.col("length").alias("x")).join(b.select("chrom", F.col("length").alias("y")), "chrom", "full_outer")
    s = both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.min(F.when(F.col("x") != F.col("y"), F.col("chrom"))).alias("bad")).first()
    if s["bad"] is not None:
        raise ValueError(f"chromosome {s['bad']} has two lengths")
    if not s["shared"]:
        raise ValueError("no chromosome is shared")


def reordered(signal: DataFrame, order: str) -> DataFrame:
    """Range-partitioned and sorted by position (tile reads) or by track (whole-track reads)."""
    keys = {"positions": ["chrom", "start", "track_id"], "tracks": ["track_id", "chrom", "start"]}
    if order not in keys:
        raise ValueError(f"an order is positions or tracks, not {order!r}")
    return signal.repartitionByRange(*keys[order]).sortWithinPartitions(*keys[order])


def read_attributes(table: DataFrame, paths: DataFrame, key: str = "file") -> DataFrame:
    """Attributes of files from a metadata table: by path, else by base name; a file without a row is an error."""
    from basetrack.functions.reads import base_name

    named = table.withColumnRenamed(key, "_key")
    by_path = paths.join(named, paths["path"] == named["_key"], "left")
    rest = by_path.where(F.col("_key").isNull()).select("path")
    by_name = rest.join(named, base_name(rest["path"]) == named["_key"], "left")
    lost = [r[0] for r in by_name.where(F.col("_key").isNull()).select("path").limit(5).collect()]
    if lost:
        raise ValueError(f"no metadata for {', '.join(lost)}")
    return by_path.where(F.col("_key").isNotNull()).unionByName(by_name).drop("_key")
