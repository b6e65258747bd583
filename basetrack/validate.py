"""Checks before a write: each finds its first offenders with one aggregate, and a failing call writes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basetrack.operators.runs import overlapping
from basetrack.schema import EXACT


def signal(rows: DataFrame, chroms: DataFrame, n_tracks: int) -> DataFrame:
    """chrom, start, end, track_id, value with zeros dropped and -0 as 0; raises where the rows aren't a signal."""
    own = rows.select(F.col("chrom").cast("string"), F.col("start").cast("long"), F.col("end").cast("long"), F.col("track_id").cast("int"), (F.col("value").cast("double") + F.lit(0.0)).alias("value"))
    known = own.join(chroms.select("chrom", "length"), "chrom", "left")
    v = F.col("value")
    infinite = v.isin(float("inf"), float("-inf"))
    checks = {
        "a chromosome is unknown": F.col("length").isNull(),
        "an interval is empty or turned": F.col("end") <= F.col("start"),
        "a start is negative": F.col("start") < 0,
        "an interval ends beyond its chromosome": (F.col("end") > F.col("length")) & ~(F.isnan(v) | (v == 0)),
        "a track is unknown": ~F.col("track_id").between(0, n_tracks - 1),
        "a value is null or infinite": v.isNull() | infinite,
        "a whole number is beyond 2^53": (F.abs(v) > EXACT) & (v == F.floor(v)),
    }
    found = known.agg(*(F.count_if(F.coalesce(c, F.lit(True))).alias(f"n{i}") for i, c in enumerate(checks.values()))).first()
    for i, what in enumerate(checks):
        if found[f"n{i}"]:
            raise ValueError(f"{what} ({found[f'n{i}']} rows)")
    clash = overlapping(own).limit(1).collect()
    if clash:
        raise ValueError(f"intervals of track {clash[0]['track_id']} overlap at {clash[0]['chrom']}:{clash[0]['start']}")
    return own.where((v != 0) | F.isnan(v))


def sorted_by_start(rows: DataFrame, order: str = "ordinal") -> None:
    """Reads must be in order of start within a chromosome (by ``order``, within files)."""
    from pyspark.sql import Window

    w = Window.partitionBy("file", "chrom").orderBy(order)
    bad = rows.withColumn("_before", F.lag("start").over(w)).where(F.col("_before") > F.col("start")).limit(1).collect()
    if bad:
        raise ValueError(f"reads aren't sorted at {bad[0]['chrom']}:{bad[0]['start']}")
