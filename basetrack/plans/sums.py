"""The choice between sums from the signal and sums from stored tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basetrack.operators.sums import interval_sums, tile_split_sums
from basetrack.schema import EXACT, TILE

#: Sums up to this are exact in float32.
EXACT_FLOAT = 2**24


def stored_sums_are_exact(stats: DataFrame, tile_sums: DataFrame) -> bool:
    """Whether all values are whole numbers whose tile sums float32 holds and whose totals stay below 2^53."""
    s = tile_sums.agg(F.max(F.abs("sum")).alias("most"), F.bool_or(F.col("sum") != F.floor("sum")).alias("fraction")).first()
    total = stats.agg(F.max(F.greatest(F.abs("most"), F.abs("least")) * F.col("nonzero")).alias("t"), F.bool_or((F.col("least") != F.floor("least")) | (F.col("most") != F.floor("most"))).alias("fraction")).first()
    return (s["most"] or 0) < EXACT_FLOAT and not s["fraction"] and (total["t"] or 0) < EXACT and not total["fraction"]


def choose_sums(windows: DataFrame, signal: DataFrame, chroms: DataFrame, stats: DataFrame, tile_sums: DataFrame, whole: bool, tile: int = TILE, rewrite: str = "auto") -> DataFrame:
    """Interval sums; from whole tiles where that is exact (``whole``: the tracks are of whole-number types) and windows are long."""
    if rewrite not in ("auto", "off"):
        raise ValueError(f"rewrite is auto or off, not {rewrite!r}")
    if rewrite == "off" or not whole or not stored_sums_are_exact(stats, tile_sums):
        return interval_sums(windows, signal, chroms, tile=tile)
    mean = windows.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 0
    return tile_split_sums(windows, signal, tile_sums, chroms, tile) if mean >= 2 * tile else interval_sums(windows, signal, chroms, tile=tile)
