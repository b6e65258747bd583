"""Multi-resolution summaries: tile sums, zoom levels, track statistics, interval-track totals and zoom records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basetrack.functions.zoom import Greedy, Records, zoom_sizes  # noqa: F401
from basetrack.operators.overlap import split_at_tiles
from basetrack.schema import DTYPES, TILE

MOST_LEVELS = 12
LARGEST_FLOAT = (2 - 2**-23) * 2.0**127
RECORDS = "start long, end long, bases long, least double, most double, total double, squares double"


def tile_sums(signal: DataFrame, tile: int = TILE) -> DataFrame:
    """(chrom, tile, track_id, sum): sums without NaN, rounded to float32; all-zero tiles have no row."""
    cut = split_at_tiles(signal.where(~F.isnan("value")), tile)
    return cut.groupBy("chrom", "tile", "track_id").agg(F.sum(F.col("value") * (F.col("end") - F.col("start"))).cast("float").alias("sum"))


def zooms(sums: DataFrame, levels: int) -> DataFrame:
    """(chrom, track_id, level, bin, sum): sums of the rounded tile sums over 4^level tiles, all levels in one pass."""
    if not 0 <= levels <= MOST_LEVELS:
        raise ValueError(f"at most {MOST_LEVELS} levels")
    each = sums.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    return each.groupBy("chrom", "track_id", "level", F.floor(F.col("tile") / F.pow(F.lit(4.0), F.col("level"))).alias("bin")).agg(F.sum(F.col("sum").cast("double")).alias("sum"))


def track_stats(signal: DataFrame) -> DataFrame:
    """(track_id, total, nonzero, least, most): without NaN, least and most over nonzero bases."""
    some = signal.where((F.col("value") != 0) & ~F.isnan("value"))
    bases = F.col("end") - F.col("start")
    return some.groupBy("track_id").agg(F.sum(F.col("value") * bases).alias("total"), F.sum(bases).alias("nonzero"), F.min("value").alias("least"), F.max("value").alias("most"))


def infer_dtypes(signal: DataFrame) -> DataFrame:
    """(track_id, dtype) by the values' range, as ``schema.infer_dtype`` says."""
    s = signal.groupBy("track_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.bool_or((F.col("value") != F.floor("value")) | F.isnan("value")).alias("fraction"))
    dtype = F.when(F.col("fraction"), "float32")
    for name in ("uint8", "uint16", "uint32", "int8", "int16", "int32"):
        _, lo, hi = DTYPES[name]
        dtype = dtype.when((F.col("lo") >= lo) & (F.col("hi") <= hi) & ((F.col("lo") < 0) == (lo < 0)), name)
    return s.select("track_id", dtype.otherwise("float64").alias("dtype"))


def out_of_range(signal: DataFrame, tracks: DataFrame) -> DataFrame:
    """Tracks (track_id, dtype) whose values don't fit the declared type, with their least and most value."""
    finite = F.when(~F.isnan("value"), F.col("value"))
    s = signal.groupBy("track_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(finite).alias("finite_lo"), F.max(finite).alias("finite_hi"), F.bool_or((F.col("value") != F.floor("value")) | F.isnan("value")).alias("fraction"))
    joined, bad = s.join(tracks.select("track_id", "dtype"), "track_id"), F.lit(False)
    for name, (_, lo, hi) in DTYPES.items():
        if not name.startswith("float"):
            bad = bad | ((F.col("dtype") == name) & (F.col("fraction") | (F.col("lo") < lo) | (F.col("hi") > hi)))
    bad = bad | ((F.col("dtype") == "float32") & (F.greatest(F.abs("finite_lo"), F.abs("finite_hi")) > LARGEST_FLOAT))
    return joined.where(bad)


def interval_total(signal: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each of ``keys``): bases, least, most, total and squares; products are rounded to float32 before they are summed."""
    bases, value = F.col("end") - F.col("start"), F.col("value").cast("float")
    product = (bases.cast("float") * value).cast("float").cast("double")
    return signal.groupBy(*keys).agg(F.sum(bases).alias("bases"), F.min(value.cast("double")).alias("least"), F.max(value.cast("double")).alias("most"), F.sum(product).alias("total"), F.sum((bases * value.cast("double") * value.cast("double"))).alias("squares"))


def grid_zoom(signal: DataFrame, size: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """(keys, bin, bases, least, most, total, squares) over fixed bins of ``size`` bases."""
    cut = split_at_tiles(signal, size)
    bases, value = F.col("end") - F.col("start"), F.col("value")
    return cut.groupBy(*keys, F.col("tile").alias("bin")).agg(F.sum(bases).alias("bases"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value * bases).alias("total"), F.sum(value * value * bases).alias("squares"))


def greedy_zoom(signal: DataFrame, size: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Records that absorb the intervals starting within ``size`` of their own start; order-dependent.

    The intervals of each value of ``keys`` are streamed in order; only the open record is in memory.
    """
    columns = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        greedy = Greedy(size)

        def given(found: list[tuple[object, Records]]) -> Iterator[pd.DataFrame]:
            for key, r in found:
                yield pd.DataFrame({**dict(zip(keys, key, strict=True)), **dict(zip(columns, r, strict=True))})

        for batch in batches:
            for key, own in batch.groupby(list(keys), sort=False, dropna=False):
                yield from given(greedy.feed(key, Records.of(*(own[c].to_numpy() for c in ("start", "end", "value")))))
        yield from given(greedy.close())

    own = signal.select(*keys, "start", "end", "value")
    schema = ", ".join([*(f"{k} {own.schema[k].dataType.simpleString()}" for k in keys), RECORDS])
    return own.repartition(*keys).sortWithinPartitions(*keys, "start", "end", "value").mapInPandas(run, schema)
