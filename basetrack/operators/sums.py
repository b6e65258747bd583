"""Sums over intervals: NaN policies, pairs, means, and whole tiles from stored tile sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basetrack.operators.overlap import clip, tile_of
from basetrack.plans.prefix import range_totals
from basetrack.schema import EXACT, TILE

POLICIES = ("propagate", "skip", "count")


def total(policy: str) -> Column:
    """What a NaN policy makes of ``range_totals``: propagate sums NaN, skip leaves them out, count counts them (to be taken from the length)."""
    if policy not in POLICIES:
        raise ValueError(f"nan is one of {', '.join(POLICIES)}, not {policy!r}")
    if policy == "propagate":
        return F.when(F.col("nans") > 0, float("nan")).otherwise(F.col("s"))
    return F.col("s" if policy == "skip" else "nans")


def interval_sums(windows: DataFrame, signal: DataFrame, chroms: DataFrame, nan: str = "propagate", tile: int = TILE) -> DataFrame:
    """(window_id, track_id, total) for every pair that shares a base; pairs without one have the sum 0 and no row.

    With ``nan='count'`` the total is the interval's bases within the chromosome that aren't NaN.
    """
    inside = clip(windows, chroms)
    out = range_totals(inside, signal, tile=tile).select("window_id", "track_id", total(nan).alias("total"))
    if nan != "count":
        return out
    return out.join(inside.select("window_id", (F.col("end") - F.col("start")).alias("bases")), "window_id").select("window_id", "track_id", (F.col("bases") - F.col("total")).alias("total"))


def with_zeros(sums: DataFrame, windows: DataFrame, channels: DataFrame) -> DataFrame:
    """A row for each window and channel, 0 where nothing is stored; duplicate channels repeat their track."""
    every = channels.agg(F.collect_list(F.struct("channel", "track_id")).alias("all"))  # one row: the requested channels
    grid = windows.select("window_id").join(F.broadcast(every)).select("window_id", F.explode("all").alias("x")).select("window_id", "x.channel", "x.track_id")
    return grid.join(sums, ["window_id", "track_id"], "left").select("window_id", "channel", F.coalesce("total", F.lit(0)).alias("total"))


def paired_sums(windows: DataFrame, signal: DataFrame, chroms: DataFrame, tile: int = TILE) -> DataFrame:
    """(window_id, total): each window against its own track_id only."""
    found = range_totals(clip(windows, chroms), signal, tile=tile, on=("track_id",), by=()).select("window_id", total("propagate").alias("total"))
    return windows.select("window_id").join(found, "window_id", "left").select("window_id", F.coalesce("total", F.lit(0.0)).alias("total"))


def interval_means(windows: DataFrame, signal: DataFrame, chroms: DataFrame, tile: int = TILE) -> DataFrame:
    """Mean over the bases within the chromosome that aren't NaN."""
    inside = clip(windows, chroms)
    wide = range_totals(inside, signal, tile=tile).withColumnRenamed("bases", "stored").join(inside.select("window_id", (F.col("end") - F.col("start")).alias("bases")), "window_id")
    n = F.col("bases") - F.col("nans")
    return wide.select("window_id", "track_id", F.when(n > 0, F.col("s") / n).alias("mean"))


def tile_split_sums(windows: DataFrame, signal: DataFrame, tile_sums: DataFrame, chroms: DataFrame, tile: int = TILE) -> DataFrame:
    """The same as ``interval_sums`` with whole tiles taken from their stored sums and only the ragged ends from the signal.

    Right for whole-number tracks whose tile sums are exact; see ``plans.choose_sums``.
    """
    inside = clip(windows, chroms)
    first, last = F.ceil(F.col("start") / F.lit(tile)), tile_of(F.col("end"), tile)  # whole tiles [first, last)
    marked = inside.withColumns({"first": first, "last": last})
    whole = marked.where("last > first").select("window_id", "chrom", F.col("first").alias("start"), F.col("last").alias("end"))
    stored = tile_sums.select("chrom", "track_id", F.col("tile").alias("start"), (F.col("tile") + 1).alias("end"), F.col("sum").cast("double").alias("value"))
    head = marked.select("window_id", "chrom", "start", F.when(F.col("last") > F.col("first"), F.col("first") * tile).otherwise(F.col("end")).alias("end"))
    tail = marked.where("last > first").select("window_id", "chrom", (F.col("last") * tile).alias("start"), "end")
    parts = [range_totals(whole, stored, tile=tile), range_totals(head.unionByName(tail), signal, tile=tile)]
    return parts[0].unionByName(parts[1]).groupBy("window_id", "track_id").agg(F.sum(total("propagate")).alias("total"))


def check_sums(sums: DataFrame, least: int, most: int) -> None:
    """Sums for a whole-number output must lie within it."""
    bad = sums.where((F.col("total") < least) | (F.col("total") > most)).limit(1).collect()
    if bad:
        raise ValueError(f"a sum of {bad[0]['total']} lies outside {least} to {most}")


def exact_total(values: DataFrame) -> bool:
    """Whether the sum of all absolute values is below 2^53, so that any sum of whole numbers is exact."""
    s = values.agg(F.sum(F.abs("value") * (F.col("end") - F.col("start"))).alias("s")).first()["s"]
    return s is None or s < EXACT
