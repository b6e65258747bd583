"""Interval-overlap joins as equi-joins on tiles.

A bare range predicate plans as a nested loop.  Both sides are cut at the edges of a fixed grid instead, so that each
overlapping (window, run) pair meets in one tile per shared tile, the join is an equi-join that shuffles on (keys, tile), and
skewed tiles are split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basetrack.schema import TILE


def tile_of(position: Column, tile: int = TILE) -> Column:
    return F.floor(position / F.lit(tile))


def with_tiles(df: DataFrame, tile: int = TILE, start: str = "start", end: str = "end", name: str = "tile") -> DataFrame:
    """A row for each tile that [start, end) touches; empty intervals give none."""
    some = df.where(F.col(end) > F.col(start))
    return some.withColumn(name, F.explode(F.sequence(tile_of(F.col(start), tile), tile_of(F.col(end) - 1, tile))))


def split_at_tiles(signal: DataFrame, tile: int = TILE) -> DataFrame:
    """Runs cut at tile edges, with their ``tile``: a run and a window then meet at most once a tile."""
    cut = with_tiles(signal, tile)
    return cut.withColumns({"start": F.greatest("start", F.col("tile") * tile), "end": F.least("end", (F.col("tile") + 1) * tile)})


def clip(windows: DataFrame, chroms: DataFrame) -> DataFrame:
    """Windows cut to [0, length) of their chromosome; those of unknown chromosomes, and those left empty, go."""
    known = windows.join(chroms.select("chrom", "length"), "chrom")
    return known.withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", "length")}).where(F.col("end") > F.col("start")).drop("length")


def overlap_pairs(windows: DataFrame, signal: DataFrame, tile: int = TILE, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of a window and a run that share bases: the window's columns, the run's as s_*, and the overlap [lo, hi).

    Windows and runs both have chrom, start, end; ``on`` are further columns that must be equal (a paired join's track).
    A window that spans several tiles meets a run once in each shared tile, with that tile's part of the overlap.
    """
    keys = ["chrom", *on]
    runs = split_at_tiles(signal, tile)
    right = runs.select(*keys, "tile", *(F.col(c).alias(f"s_{c}") for c in runs.columns if c not in (*keys, "tile")))
    left = with_tiles(windows, tile)
    met = left.join(right, [*keys, "tile"]).where((F.col("s_start") < F.col("end")) & (F.col("s_end") > F.col("start")))
    return met.withColumns({"lo": F.greatest("start", "s_start"), "hi": F.least("end", "s_end")}).drop("tile")


def points_in_windows(windows: DataFrame, points: DataFrame, tile: int = TILE) -> DataFrame:
    """(window's columns, point's columns) of each point (chrom, pos) in a window; one tile per point, so no point is cut."""
    left = with_tiles(windows, tile)
    right = points.withColumn("tile", tile_of(F.col("pos"), tile))
    return left.join(right, ["chrom", "tile"]).where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))).drop("tile")
