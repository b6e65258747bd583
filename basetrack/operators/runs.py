"""Runs: run-length encoding, interval union, checks of order and overlap.

Order-dependent passes cut the axis of a key (chromosome, track) into blocks: each is handled by itself, and only block-edge rows, or
a row a block, meet again.  ``encode`` does so where ``block`` is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def encode(signal: DataFrame, keys: Sequence[str] = ("chrom", "track_id"), block: int | None = None) -> DataFrame:
    """Adjacent runs with equal values as one.  NaN equals NaN."""
    keys = list(keys)
    if block is None:
        return _join_equal(signal, keys)
    own = signal.withColumn("_block", F.floor(F.col("start") / F.lit(block)))
    inner = _join_equal(own, [*keys, "_block"])
    # a run can only go on across an edge if it is the first or last of its block
    w = Window.partitionBy(*keys, "_block")
    edge = (F.col("start") == F.min("start").over(w)) | (F.col("end") == F.max("end").over(w))
    marked = inner.withColumn("_edge", edge)
    rest = marked.where(~F.col("_edge")).select(*keys, "start", "end", "value")
    return rest.unionByName(_join_equal(marked.where("_edge").drop("_block", "_edge"), keys))


def _join_equal(runs: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    fresh = F.lag("end").over(w).isNull() | (F.lag("end").over(w) != F.col("start")) | ~F.lag("value").over(w).eqNullSafe(F.col("value"))
    marked = runs.withColumn("_fresh", fresh.cast("long"))
    islands = marked.withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("value").alias("value")).drop("_island")


#: Bases of a block that is swept by itself in the passes below; a chromosome is many blocks, and only a row a block is ordered as a whole.
BLOCK = 1 << 20


def _reach(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Adds ``_block`` and ``reach``: the furthest end of the rows before, in order of start and end; null for the first."""
    own = rows.withColumn("_block", F.floor(F.col("start") / F.lit(block)))
    furthest = own.groupBy(*keys, "_block").agg(F.max("end").alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = furthest.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_of"), F.max("_end").over(over).alias("_before"))
    w = Window.partitionBy(*keys, "_block").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_block") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = own.withColumn("_within", F.max("end").over(w)).join(before, same)
    return joined.withColumn("reach", F.greatest("_within", "_before")).drop("_within", "_before", "_of", *(f"_{k}" for k in keys))


def union_ranges(ranges: DataFrame, keys: Sequence[str] = ("chrom",), block: int = BLOCK) -> DataFrame:
    """Overlapping or touching ranges merged.

    Within a block an island is numbered from the last one of earlier blocks on, which it may continue.
    """
    keys = list(keys)
    marked = _reach(ranges.where(F.col("end") > F.col("start")).select(*keys, "start", "end"), keys, block)
    marked = marked.withColumn("_fresh", (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("long"))
    w = Window.partitionBy(*keys, "_block").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    # islands of a block first, a row each: those that no earlier row reaches begin one, the first may go on with another block's
    parts = marked.withColumn("_island", F.sum("_fresh").over(w)).groupBy(*keys, "_block", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    fresh = parts.groupBy(*keys, "_block").agg(F.max("_island").alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = fresh.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_of"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_first"))
    same = F.col("_block") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    numbered = parts.join(offset, same).select(*keys, (F.col("_first") + F.col("_island")).alias("_number"), "start", "end")
    return numbered.groupBy(*keys, "_number").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_number")


def overlapping(runs: DataFrame, keys: Sequence[str] = ("chrom", "track_id"), block: int = BLOCK) -> DataFrame:
    """Runs that begin before one that precedes them in order has ended."""
    return _reach(runs, list(keys), block).drop("_block").where(F.col("reach") > F.col("start"))


def points(runs: DataFrame) -> DataFrame:
    """Runs as single bases."""
    return runs.withColumn("pos", F.explode(F.sequence("start", F.col("end") - 1))).drop("start", "end")


def duplicate_entries(entries: DataFrame, keys: Sequence[str] = ("chrom", "track_id", "pos")) -> DataFrame:
    """Keys with more than one entry."""
    return entries.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
