"""Batches into a signal table by Structured Streaming, and event-time tiles.

The batch-at-a-time writer's rule, later batches come after earlier ones in each (track, chromosome), is kept as a table of high-water marks;
a batch that breaks it raises and writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basetrack.operators.runs import overlapping
from basetrack.operators.summary import track_stats


def _marks(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The high-water marks (chrom, track_id, mark) after the last batch before ``before``: one small table a batch."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/marks")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS"))]
    earlier = [e for e in done if e < before]
    return spark.read.parquet(f"{path}/marks/epoch={max(earlier)}") if earlier else None


def append_batch(batch: DataFrame, epoch: int, path: str, chroms: DataFrame | None = None, tile: int = 1) -> None:
    """Idempotent for an epoch: its rows go to a folder of their own, and the marks after it to another.

    With ``chroms`` its chromosomes must be known and its runs end within them; runs of a batch may not overlap; with ``tile`` the tile
    that a batch ends in is sealed, so that the next one begins at a later tile.
    """
    spark = batch.sparkSession
    own = batch.persist()
    try:
        if chroms is not None:
            known = own.join(chroms.select("chrom", "length"), "chrom", "left").where(F.col("length").isNull() | (F.col("end") > F.col("length"))).limit(1).collect()
            if known:
                raise ValueError(f"{known[0]['chrom']}:{known[0]['start']} is unknown or beyond its end")
        clash = overlapping(own).limit(1).collect()
        if clash:
            raise ValueError(f"track {clash[0]['track_id']}: runs overlap at {clash[0]['chrom']}:{clash[0]['start']}")
        marks = _marks(spark, path, epoch)
        new = own.groupBy("chrom", "track_id").agg((F.ceil(F.max("end") / tile) * tile).cast("long").alias("mark"))
        if marks is not None:
            late = own.join(marks, ["chrom", "track_id"]).where(F.col("start") < F.col("mark")).limit(1).collect()
            if late:
                raise ValueError(f"track {late[0]['track_id']}: {late[0]['chrom']}:{late[0]['start']} lies before what is written")
            new = new.unionByName(marks).groupBy("chrom", "track_id").agg(F.max("mark").alias("mark"))
        own.write.mode("overwrite").parquet(f"{path}/signal/epoch={epoch}")
        new.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/epoch={epoch}")
        partial = track_stats(own)
        partial.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/epoch={epoch}")
    finally:
        own.unpersist()


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """Track statistics of all batches, folded from each batch's own; the signal isn't read again."""
    parts = spark.read.parquet(f"{path}/stats")
    return parts.groupBy("track_id").agg(F.sum("total").alias("total"), F.sum("nonzero").alias("nonzero"), F.min("least").alias("least"), F.max("most").alias("most"))


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """rows: a streaming DataFrame of chrom, start, end, track_id, value."""
    return rows.writeStream.foreachBatch(lambda b, e: append_batch(b, e, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tiles_in_time(events: DataFrame, tile: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and tile of time; events later than the watermark are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", tile), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
