"""Window reads: dense, sparse, entries, bins, labels, and the rules for missing, NaN and out-of-bounds bases."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basetrack.plans.bases import BASES, meet, touched, value_at, window_points
from basetrack.plans.prefix import range_totals, window_runs
from basetrack.schema import LONGEST, TILE

#: Bins of this many bases and more are summed from running sums, smaller ones base by base in their tile.
LEAST_BIN = 8


def check_windows(windows: DataFrame) -> None:
    """Starts at 0 or later, ends not before starts nor beyond the longest chromosome."""
    s = windows.agg(F.min("start").alias("least"), F.max("end").alias("most"), F.count_if(F.col("end") < F.col("start")).alias("turned")).first()
    if s["least"] is not None and s["least"] < 0:
        raise ValueError(f"a window starts at {s['least']}")
    if s["most"] is not None and s["most"] > LONGEST:
        raise ValueError(f"a window ends at {s['most']}, beyond {LONGEST}")
    if s["turned"]:
        raise ValueError(f"{s['turned']} windows end before they start")


def unknown_chroms(windows: DataFrame, chroms: DataFrame) -> DataFrame:
    """Chromosomes of windows that the dataset lacks (left anti)."""
    return windows.select("chrom").distinct().join(chroms, "chrom", "left_anti")


def check_known(windows: DataFrame, chroms: DataFrame, strict: bool = True) -> None:
    """Unknown chromosomes: an error for multi-track datasets, a warning for interval tracks."""
    names = [r[0] for r in unknown_chroms(windows, chroms).limit(6).collect()]
    if names and strict:
        raise ValueError(f"not in the dataset: {', '.join(map(str, names[:5]))}")
    if names:
        warnings.warn(f"not in the file: {', '.join(map(str, names[:5]))}", stacklevel=2)


def repeated_ids(windows: DataFrame) -> bool:
    """Whether windows share an id; what is summed or listed by id is then of all of them."""
    return bool(windows.groupBy("window_id").count().where("count > 1").head(1))


def entries(windows: DataFrame, signal: DataFrame, channels: DataFrame, tile: int = TILE) -> DataFrame:
    """(window_id, channel, offset, value): stored bases of the windows; a track with several channels is read into each."""
    some = signal.join(F.broadcast(channels.select("track_id").distinct()), "track_id", "left_semi")
    bases = window_runs(windows, some, tile=tile).select("window_id", "track_id", F.explode_outer(_bases()).alias("b")).where("b is not null")
    return bases.join(channels, "track_id").select("window_id", "channel", "b.offset", "b.value")


def _bases() -> Column:
    """The bases (offset, value) of ``pieces`` of a window that begins at ``start``."""
    return F.flatten(F.transform("pieces", lambda r: F.transform(F.sequence(r["lo"], r["hi"] - 1), lambda p: F.struct((p - F.col("start")).alias("offset"), r["value"].alias("value")))))


def read_sparse(windows: DataFrame, signal: DataFrame, chroms: DataFrame, channels: DataFrame, tile: int = TILE, ordered: bool = False) -> DataFrame:
    """Nonzero and NaN bases of the windows, within their chromosomes: row, channel, offset, value; ``ordered`` by the first three."""
    found = entries(_clipped(windows, chroms), signal, channels, tile).where((F.col("value") != 0) | F.isnan("value"))
    out = found.select(F.col("window_id").alias("row"), "channel", "offset", "value")
    return out.orderBy("row", "channel", "offset") if ordered else out


def _clipped(windows: DataFrame, chroms: DataFrame) -> DataFrame:
    """Windows without the bases past their chromosome; starts stay, so offsets do."""
    known = windows.join(chroms.select("chrom", "length"), "chrom")
    return known.withColumn("end", F.least("end", "length")).where(F.col("end") > F.col("start")).drop("length")


def fill(value: Column, inside: Column, known: Column, default: float, oob: float | None, keep_nan: bool) -> Column:
    """A base's value: stored; else the default; past the chromosome's end ``oob``.  An unknown chromosome has only the default."""
    stored = value if keep_nan else F.when(~F.isnan(value), value)
    base = F.coalesce(stored, F.lit(float(default)))
    return base if oob is None else F.when(known & ~inside, F.lit(float(oob))).otherwise(base)


def read_dense(windows: DataFrame, signal: DataFrame, chroms: DataFrame, channels: DataFrame, width: int, default: float = 0.0, oob: float | None = float("nan"), keep_nan: bool = True, tile: int = TILE) -> DataFrame:
    """Every base of every window and channel: window_id, channel, offset, value.

    Multi-track datasets have default 0 and NaN past the end (None: 0, for whole-number output); interval tracks have
    ``default`` where no interval is, and NaN intervals count as missing unless ``keep_nan``.
    """
    length, tile = F.col("length"), min(tile, BASES)
    own = windows.join(F.broadcast(chroms.select("chrom", "length")), "chrom", "left")
    # every window is read to its width; what it stores lies within its own end and its chromosome (least passes over an unknown length)
    start, most = F.col("start"), F.greatest("end", F.col("start") + width)
    inside, stored = (F.when(length.isNotNull(), F.greatest(F.least(e, length) - start, F.lit(0))) for e in (most, F.col("end")))
    whole = own.select("window_id", "chrom", "start", most.alias("end"), inside.alias("inside"), F.coalesce(stored, F.lit(0)).alias("stored"))
    some = touched(signal.join(F.broadcast(channels.select("track_id").distinct()), "track_id", "left_semi"), whole, tile)
    met = meet(whole, some, channels.select("channel", "track_id"), "track_id", tile)
    # what a base needs, once a part and channel, as offsets from the window's start
    each = met.select("window_id", "channel", "values", (start + F.col("shift")).cast("int").alias("shift"), "inside", "stored", F.explode_outer(F.sequence(F.col("lo") - start, F.col("hi") - 1 - start)).alias("offset"))
    offset = F.col("offset")
    each = each.withColumn("value", F.when(offset < F.col("stored"), value_at(offset.cast("int")))).where((offset < width) | F.col("value").isNotNull())
    return each.select("window_id", "channel", "offset", fill(F.col("value"), offset < F.col("inside"), F.col("inside").isNotNull(), default, oob, keep_nan).alias("value"))


def points_read(windows: DataFrame, points: DataFrame, tile: int = TILE) -> DataFrame:
    """window_id, track_id, offsets: the sorted offsets of the points (chrom, pos, track_id) in each window; windows without points have no row."""
    found = window_points(windows.select("window_id", "chrom", "start", "end"), points, "track_id", tile)
    out = found.select("window_id", "track_id", F.transform("positions", lambda p: p - F.col("start")).alias("offsets"))
    return out.groupBy("window_id", "track_id").agg(F.array_sort(F.flatten(F.collect_list("offsets"))).alias("offsets")) if repeated_ids(windows) else out


def packed(dense: DataFrame) -> DataFrame:
    """One array a window and channel."""
    cells = F.array_sort(F.collect_list(F.struct("offset", "value")))
    return dense.groupBy("window_id", "channel").agg(F.transform(cells, lambda x: x["value"]).alias("values"))


def batches(arrays: DataFrame, channels: int, width: int, size: int, out: np.ndarray | None = None) -> Iterator[tuple[list[int], np.ndarray]]:
    """(window ids, values of shape (size, channels, width)) of ``packed`` reads in order of window, for training; the last batch may be smaller.

    Partitions come to the driver one after another, so one of them and a batch are in memory.  With ``out`` every batch is
    read into that array, which must have the shape and hold floats.
    """
    if out is not None and (out.shape != (size, channels, width) or out.dtype.kind != "f"):
        raise ValueError(f"out is {out.dtype} of {out.shape}, not floats of {(size, channels, width)}")
    rows = arrays.groupBy("window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "values"))), lambda x: x["values"]).alias("all")).orderBy("window_id")
    ids: list[int] = []
    room = np.empty((size, channels, width)) if out is None else out
    for r in rows.toLocalIterator(prefetchPartitions=True):
        room[len(ids)] = r["all"]
        ids.append(r["window_id"])
        if len(ids) == size:
            yield ids, room if out is not None else room.copy()
            ids = []
    if ids:
        yield ids, room[: len(ids)]


def binned_sums(windows: DataFrame, signal: DataFrame, chroms: DataFrame, channels: DataFrame, width: int, bins: int, by: str = "channel", tile: int = TILE) -> DataFrame:
    """Sums per bin of ``bins`` bases; runs are cut at bin edges, bases are never listed.  ``by``: channel or label."""
    if width % bins:
        raise ValueError(f"bins of {bins} don't divide a width of {width}")
    own = _clipped(windows, chroms)
    if bins < LEAST_BIN:  # a bin is summed in the tile of its first base
        tile = min(tile, BASES)
        own = own.select("window_id", "chrom", "start", "end")
        some = touched(signal.join(F.broadcast(channels.select("track_id", by)), "track_id"), own, tile, bins - 1)
        bases = some.withColumn("start", F.explode_outer(F.sequence("start", F.col("end") - 1))).groupBy("chrom", "tile", by, "start").agg(F.sum("value").alias("value"))
        met = meet(own, bases.withColumn("end", F.col("start") + 1), channels.select(by).distinct(), by, tile).where("values is not null")
        begin = F.col("start")
        bounds = met.withColumns({"first": F.ceil((F.col("lo") - begin) / bins), "last": F.floor((F.col("hi") - 1 - begin) / bins)}).where("first <= last")
        each = bounds.withColumn("bin", F.explode_outer(F.sequence("first", "last")))
        at = begin + F.col("bin") * bins
        values = [value_at(at) if not k else F.when(at + k < F.col("end"), value_at(at + k)) for k in range(bins)]
        total = reduce(add, (F.coalesce(v, F.lit(0.0)) for v in values)) if bins > 1 else values[0]
        sums = each.select("window_id", by, "bin", F.when(F.coalesce(*values).isNotNull(), total).alias("total")).where("total is not null")
        return sums.groupBy("window_id", by, "bin").agg(F.sum("total").alias("total")) if repeated_ids(windows) else sums
    each = own.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - 1 - F.col("start")) / bins))))
    edge = F.col("start") + F.col("bin") * bins
    cells = each.select("window_id", "bin", "chrom", edge.alias("start"), F.least("end", edge + bins).alias("end"))
    found = range_totals(cells, signal, ids=("window_id", "bin"), tile=tile)
    return found.join(F.broadcast(channels), "track_id").groupBy("window_id", by, "bin").agg(F.sum(F.when(F.col("nans") > 0, float("nan")).otherwise(F.col("s"))).alias("total"))


def check_labels(labels: DataFrame) -> int:
    """Number of output channels: labels are -1 (dropped) or more, one a track."""
    s = labels.agg(F.max("label").alias("most"), F.min("label").alias("least"), F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks")).first()
    if s["n"] != s["tracks"]:
        raise ValueError("a track has two labels")
    if s["least"] is not None and s["least"] < -1:
        raise ValueError(f"label {s['least']} is less than -1")
    return (s["most"] if s["most"] is not None else -1) + 1


def label_sums(windows: DataFrame, signal: DataFrame, chroms: DataFrame, labels: DataFrame, width: int, bins: int | None = None, fill_zero: bool = False, tile: int = TILE) -> DataFrame:
    """Pseudobulk: sums over the tracks of each label, per base or bin; ``fill_zero`` gives every label from 0 to the highest a row."""
    kept = labels.where("label >= 0")
    out = binned_sums(windows, signal, chroms, kept, width, bins or 1, "label", tile)
    if not fill_zero:
        return out
    n = check_labels(labels)
    grid = windows.select("window_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("label")).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width // (bins or 1) - 1).cast("long"))))
    return grid.join(out, ["window_id", "label", "bin"], "left").select("window_id", "label", "bin", F.coalesce("total", F.lit(0.0)).alias("total"))


def arrange(tracks: DataFrame, item: str, channel: str) -> DataFrame:
    """Item x channel: the track of each pair, ranks by first appearance; every pair must be filled by exactly one track."""
    from basetrack.operators.counting import ranked

    rank = lambda c, out: ranked(tracks.groupBy(c).agg(F.min("track_id").alias("seen")), "seen", out).drop("seen")
    items, channels = rank(item, "item_rank"), rank(channel, "channel_rank")
    own = tracks.join(items, item).join(channels, channel)
    filled = own.groupBy("item_rank", "channel_rank").agg(F.min("track_id").alias("track_id"), F.count("*").alias("n"))
    sizes = own.agg(F.countDistinct("item_rank").alias("i"), F.countDistinct("channel_rank").alias("c")).first()
    seen = filled.agg(F.count("*").alias("n"), F.max("n").alias("most")).first()
    if seen["n"] != sizes["i"] * sizes["c"] or (seen["most"] or 1) > 1:
        raise ValueError(f"{item} and {channel} don't name each track once")
    return filled.select("item_rank", "channel_rank", "track_id")


def read_entries(signal: DataFrame, chroms: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Every stored nonzero base: chrom_id, position, track_id, value."""
    own = signal if tracks is None else signal.join(tracks.select("track_id"), "track_id", "left_semi")
    bases = own.where((F.col("value") != 0) | F.isnan("value")).withColumn("position", F.explode(F.sequence("start", F.col("end") - 1)))
    return bases.join(chroms.select("chrom", "chrom_id"), "chrom").select("chrom_id", "position", "track_id", "value")


