"""Totals over intervals from running sums: the work is windows x tracks, however wide the windows are.

A signal becomes an index, a row for each (chromosome, tile, track) with its runs in order and the running sums before each.  A window
meets the index in the one or two tiles where it begins and ends (an equi-join), and each end's running sum is found by
bisection, unrolled into plain columns, so that it stays inside generated code.  The whole tiles between are a window over tiles, to
which the same is done again, with as many levels as the longest window asks for.

Sums are differences of running sums of one tile: exact for whole numbers up to 2^53, and within rounding of the tile's sum of absolute values else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basetrack.operators.overlap import split_at_tiles, tile_of, with_tiles
from basetrack.schema import TILE

#: What is summed: values that aren't NaN, bases that are NaN, bases that are stored.
TOTALS = ("s", "nans", "bases")


def range_totals(windows: DataFrame, signal: DataFrame, ids: Sequence[str] = ("window_id",), tile: int = TILE, on: Sequence[str] = (), by: Sequence[str] = ("track_id",)) -> DataFrame:
    """(ids, by, s, nans, bases) of every window and track that share a stored base.

    windows: ids, chrom, start, end and the columns ``on`` that must be equal; signal: chrom, start, end, value and
    the columns of ``on`` and ``by``; runs of a track don't overlap, and values are finite or NaN.
    """
    bad = F.isnan("value")
    runs = signal.where(F.col("end") > F.col("start")).select("chrom", *on, *by, "start", "end", F.when(bad, 0.0).otherwise(F.col("value").cast("double")).alias("s"), bad.cast("long").alias("nans"), F.lit(1).cast("long").alias("bases"))
    own = windows.where(F.col("end") > F.col("start")).select(*ids, "chrom", *on, "start", "end")
    longest = own.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    parts, span = [], longest
    while True:
        ends, between = _ends(own, tile, span > 1)
        parts.append(_met(ends, _index(runs, ["chrom", *on], list(by), tile), ["chrom", *on], list(by), list(ids), tile))
        span = span // tile
        if span < 1:
            break
        own, runs = between, _tiles(runs, ["chrom", *on], list(by), tile)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy(*ids, *by).agg(*(F.sum(c).alias(c) for c in TOTALS)).where("bases > 0")


def _ends(windows: DataFrame, tile: int, wide: bool) -> tuple[DataFrame, DataFrame]:
    """The parts of windows in their first and last tile, and the whole tiles between as windows over tiles."""
    first, last = tile_of(F.col("start"), tile), tile_of(F.col("end") - 1, tile)
    marked = windows.withColumns({"first": first, "last": last})
    one = F.struct(F.col("first").alias("tile"), F.col("start").alias("lo"), F.least(F.col("end"), (F.col("first") + 1) * tile).alias("hi"))
    two = F.struct(F.col("last").alias("tile"), (F.col("last") * tile).alias("lo"), F.col("end").alias("hi"))
    each = F.explode(F.when(F.col("last") > F.col("first"), F.array(one, two)).otherwise(F.array(one))) if wide else one
    ends = marked.withColumn("part", each).drop("start", "end", "first", "last").select("*", "part.tile", "part.lo", "part.hi").drop("part")
    between = marked.where(F.col("last") > F.col("first") + 1).withColumns({"start": F.col("first") + 1, "end": F.col("last")}).drop("first", "last")
    return ends, between


def _index(runs: DataFrame, keys: list[str], by: list[str], tile: int) -> DataFrame:
    """(keys, by, tile, runs): the runs of a tile in order, each with the sums before it; one shuffle."""
    cut = split_at_tiles(runs, tile)
    w = Window.partitionBy(*keys, *by, "tile").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("end") - F.col("start")
    summed = cut.withColumns({f"before_{c}": F.coalesce(F.sum(F.col(c) * n).over(w), F.col(c) * 0) for c in TOTALS})
    return summed.groupBy(*keys, *by, "tile").agg(F.array_sort(F.collect_list(F.struct("start", "end", *TOTALS, *(f"before_{c}" for c in TOTALS)))).alias("runs"))


def _tiles(runs: DataFrame, keys: list[str], by: list[str], tile: int) -> DataFrame:
    """Totals of tiles, as runs of one base over tiles."""
    n = F.col("end") - F.col("start")
    sums = split_at_tiles(runs, tile).groupBy(*keys, *by, "tile").agg(*(F.sum(F.col(c) * n).alias(c) for c in TOTALS))
    return sums.select(*keys, *by, F.col("tile").alias("start"), (F.col("tile") + 1).alias("end"), *TOTALS)


def starting_before(rows: DataFrame, position: str, out: str, tile: int) -> DataFrame:
    """Adds ``out``: how many of ``runs`` start before ``position``.

    The steps are columns of their own: as one expression each would hold the one before twice.  For the same reason nothing above
    may be a filter on what comes of them before an aggregate, nor an inner ``explode``, from which Spark infers one.
    """
    rows, step = rows.withColumn(out, F.lit(0)), 1 << max(tile.bit_length() - 1, 0)
    while step:
        rows = rows.withColumn(out, F.col(out) + F.when(F.get("runs", F.col(out) + (step - 1))["start"] < F.col(position), step).otherwise(0))
        step //= 2
    return rows


def _before(rows: DataFrame, position: str, out: str, tile: int) -> DataFrame:
    """Adds ``out``: the last run of ``runs`` that starts before ``position``, or null."""
    k = f"{out}_k"
    return starting_before(rows, position, k, tile).withColumn(out, F.get("runs", F.col(k) - 1)).drop(k)


def window_runs(windows: DataFrame, signal: DataFrame, ids: Sequence[str] = ("window_id",), tile: int = TILE) -> DataFrame:
    """(ids, start, track_id, pieces): for each window, tile and track the stored runs in the window, cut to it; pieces may be empty.

    Runs are found by bisection in their tile's array, so short windows don't meet all runs of a tile.
    """
    runs = split_at_tiles(signal.select("chrom", "track_id", "start", "end", "value"), tile)
    index = runs.groupBy("chrom", "track_id", "tile").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("runs"))
    own = with_tiles(windows.select(*ids, "chrom", "start", "end"), tile)
    parts = own.withColumns({"lo": F.greatest("start", F.col("tile") * tile), "hi": F.least("end", (F.col("tile") + 1) * tile)})
    found = starting_before(starting_before(parts.join(index, ["chrom", "tile"]), "lo", "a", tile), "hi", "b", tile)
    first = F.greatest("a", F.lit(1))  # the last run that starts before the window may reach into it
    near = F.slice("runs", first, F.greatest(F.col("b") - first + 1, F.lit(0)))
    cut = F.transform(F.filter(near, lambda r: r["end"] > F.col("lo")), lambda r: F.struct(F.greatest(r["start"], F.col("lo")).alias("lo"), F.least(r["end"], F.col("hi")).alias("hi"), r["value"].alias("value")))
    return found.select(*ids, "start", "track_id", cut.alias("pieces"))


def _met(ends: DataFrame, index: DataFrame, keys: list[str], by: list[str], ids: list[str], tile: int) -> DataFrame:
    """(ids, by, totals) of the parts of windows and the tracks of their tiles."""
    joined = ends.join(index, [*keys, "tile"])
    found = _before(_before(joined, "lo", "a", tile), "hi", "b", tile)

    def upto(run: str, position: str, c: str) -> Column:
        r = F.col(run)
        return F.coalesce(r[f"before_{c}"] + r[c] * (F.least(r["end"], F.col(position)) - r["start"]), F.lit(0))

    return found.select(*ids, *by, *((upto("b", "hi", c) - upto("a", "lo", c)).alias(c) for c in TOTALS))
