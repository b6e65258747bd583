"""The queries over the driver's tables and the SQL that checks them.

The tables stand in for genomic ones: lineitem for reads, signal and intervals (chromosome l_returnflag, position l_partkey, track
l_linenumber, strand by l_linestatus), orders for windows, events for single-cell fragments, embeddings for dense tracks with labels.
The SQL is written as direct range joins, never as tiles, so that it is an independent check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basetrack.operators import catalog, counting, overlap, read, runs, sums, summary
from basetrack.functions import reads as rf

TILE = 256
WIDTH = 100
SHORT = 4


class Tables:
    """Adapters from the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def reads(self) -> DataFrame:
        q = F.col("l_quantity").cast("long")
        return self.get("lineitem").select(F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + q).alias("end"), (F.col("l_linestatus") != "F").alias("reverse"), F.col("l_linenumber").alias("track_id"), F.col("l_suppkey").alias("supp"), q.alias("q"))

    @property
    def signal(self) -> DataFrame:
        points = self.reads.groupBy("chrom", "start", "track_id").agg(F.sum("q").cast("double").alias("value"))
        return points.select("chrom", "start", (F.col("start") + 1).alias("end"), "track_id", "value")

    @property
    def nan_signal(self) -> DataFrame:
        """The signal with NaN where the value is a multiple of 7."""
        return self.signal.withColumn("value", F.when(F.col("value") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))

    @property
    def chroms(self) -> DataFrame:
        return self.reads.groupBy("chrom").agg((F.max("end") + 1).alias("length"))

    def windows(self, width: int = WIDTH) -> DataFrame:
        chrom = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("o_custkey") % 3 + 1).cast("int"))
        return self.get("orders").select(F.col("o_orderkey").alias("window_id"), chrom.alias("chrom"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + width).alias("end"))

    @property
    def channels(self) -> DataFrame:
        return self.spark.range(1, 8).select(F.col("id").cast("int").alias("track_id"), F.col("id").cast("int").alias("channel"))

    @property
    def labels(self) -> DataFrame:
        """Tracks 1 to 7: label track % 3, track 7 dropped."""
        return self.spark.range(1, 8).select(F.col("id").cast("int").alias("track_id"), F.when(F.col("id") == 7, -1).otherwise(F.col("id") % 3).cast("int").alias("label"))

    @property
    def fragments(self) -> DataFrame:
        minute = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / 60)
        return self.get("events").select(F.col("event_type").alias("chrom"), minute.alias("start"), (minute + 1 + F.col("user_id") % 30).alias("end"), F.col("user_id").alias("cell"), F.col("event_id").alias("ordinal"), F.lit(False).alias("reverse"))


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

_COMMON = """
WITH sig AS (SELECT l_returnflag AS chrom, l_partkey AS pos, l_linenumber AS track_id, sum(l_quantity::BIGINT)::DOUBLE AS value FROM lineitem GROUP BY ALL),
reads AS (SELECT l_returnflag AS chrom, l_partkey AS start, l_partkey + l_quantity::BIGINT AS stop, l_linestatus <> 'F' AS reverse, l_linenumber AS track_id, l_suppkey AS supp, l_quantity::BIGINT AS q FROM lineitem),
chroms AS (SELECT chrom, max(stop) + 1 AS length FROM reads GROUP BY chrom),
win AS (SELECT o_orderkey AS window_id, CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom, o_custkey AS start, o_custkey + 100 AS stop FROM orders),
win4 AS (SELECT window_id, chrom, start, start + 4 AS stop FROM win),
frag AS (SELECT event_type AS chrom, floor((epoch(ts) - 1704067200) / 60)::BIGINT AS start, floor((epoch(ts) - 1704067200) / 60)::BIGINT + 1 + user_id % 30 AS stop, user_id AS cell, event_id AS ordinal FROM events)
"""


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _ORACLES[f.__name__] = _COMMON + sql
        return f

    return register


_SUMS = "SELECT window_id, track_id, sum(value)::DOUBLE AS total FROM win JOIN sig ON win.chrom = sig.chrom AND pos >= start AND pos < stop GROUP BY ALL"


@query(_SUMS)
def interval_sums(t: Tables) -> DataFrame:
    return sums.interval_sums(t.windows(), t.signal, t.chroms, tile=TILE)


@query(_SUMS)
def tile_split_sums(t: Tables) -> DataFrame:
    stored = summary.tile_sums(t.signal, 16)
    return sums.tile_split_sums(t.windows(), t.signal, stored, t.chroms, 16)


_NAN = "nsig AS (SELECT chrom, pos, track_id, CASE WHEN value % 7 = 0 THEN 'nan'::DOUBLE ELSE value END AS value FROM sig)"


@query(f", {_NAN} SELECT window_id, track_id, sum(value)::DOUBLE AS total FROM win JOIN nsig ON win.chrom = nsig.chrom AND pos >= start AND pos < stop GROUP BY ALL")
def interval_sums_nan_propagate(t: Tables) -> DataFrame:
    return sums.interval_sums(t.windows(), t.nan_signal, t.chroms, "propagate", TILE)


@query(f", {_NAN} SELECT window_id, track_id, sum(CASE WHEN isnan(value) THEN 0 ELSE value END)::DOUBLE AS total FROM win JOIN nsig ON win.chrom = nsig.chrom AND pos >= start AND pos < stop GROUP BY ALL")
def interval_sums_nan_skip(t: Tables) -> DataFrame:
    return sums.interval_sums(t.windows(), t.nan_signal, t.chroms, "skip", TILE)


@query(f", {_NAN} SELECT window_id, track_id, (any_value(least(stop, length) - start) - sum(CASE WHEN isnan(value) THEN 1 ELSE 0 END))::BIGINT AS total FROM win JOIN nsig ON win.chrom = nsig.chrom AND pos >= start AND pos < stop JOIN chroms ON win.chrom = chroms.chrom GROUP BY ALL")
def interval_sums_nan_count(t: Tables) -> DataFrame:
    return sums.interval_sums(t.windows(), t.nan_signal, t.chroms, "count", TILE)


@query(f", {_NAN} SELECT window_id, track_id, round(sum(CASE WHEN isnan(value) THEN 0 ELSE value END) / nullif(any_value(least(stop, length) - start) - sum(CASE WHEN isnan(value) THEN 1 ELSE 0 END), 0), 9) AS mean FROM win JOIN nsig ON win.chrom = nsig.chrom AND pos >= start AND pos < stop JOIN chroms ON win.chrom = chroms.chrom GROUP BY ALL")
def interval_mean(t: Tables) -> DataFrame:
    return sums.interval_means(t.windows(), t.nan_signal, t.chroms, TILE).withColumn("mean", F.round("mean", 9))


@query("SELECT window_id, track_id AS channel, ((pos - start) // 25)::BIGINT AS bin, sum(value)::DOUBLE AS total FROM win JOIN sig ON win.chrom = sig.chrom AND pos >= start AND pos < stop GROUP BY ALL")
def binned_sums(t: Tables) -> DataFrame:
    return read.binned_sums(t.windows(), t.signal, t.chroms, t.channels, WIDTH, 25, tile=TILE)


@query("SELECT window_id, (track_id % 3)::INT AS label, (pos - start)::BIGINT AS bin, sum(value)::DOUBLE AS total FROM win4 win JOIN sig ON win.chrom = sig.chrom AND pos >= start AND pos < stop WHERE track_id < 7 GROUP BY ALL")
def label_sums(t: Tables) -> DataFrame:
    return read.label_sums(t.windows(SHORT), t.signal, t.chroms, t.labels, SHORT, tile=TILE)


@query("""SELECT w.window_id, l.label, b.bin, coalesce(s.total, 0)::DOUBLE AS total
FROM win w CROSS JOIN (SELECT range::INT AS label FROM range(3)) l CROSS JOIN (SELECT range AS bin FROM range(2)) b
LEFT JOIN (SELECT window_id, (track_id % 3)::INT AS label, ((pos - start) // 50)::BIGINT AS bin, sum(value) AS total FROM win JOIN sig ON win.chrom = sig.chrom AND pos >= start AND pos < stop WHERE track_id < 7 GROUP BY ALL) s
ON w.window_id = s.window_id AND l.label = s.label AND b.bin = s.bin""")
def label_bin_sums(t: Tables) -> DataFrame:
    return read.label_sums(t.windows(), t.signal, t.chroms, t.labels, WIDTH, 50, True, TILE)


@query("SELECT window_id, coalesce(sum(value), 0)::DOUBLE AS total FROM (SELECT *, (window_id % 7 + 1)::INT AS track_id FROM win) w LEFT JOIN sig ON w.chrom = sig.chrom AND w.track_id = sig.track_id AND pos >= start AND pos < stop GROUP BY window_id")
def paired_sums(t: Tables) -> DataFrame:
    return sums.paired_sums(t.windows().withColumn("track_id", (F.col("window_id") % 7 + 1).cast("int")), t.signal, t.chroms, TILE)


@query("SELECT w.window_id, c.channel, coalesce(s.total, 0)::DOUBLE AS total FROM win w CROSS JOIN (SELECT unnest([0, 1, 2])::INT AS channel, unnest([3, 1, 3])::INT AS track_id) c LEFT JOIN (" + _SUMS + ") s ON w.window_id = s.window_id AND c.track_id = s.track_id")
def interval_sums_channels(t: Tables) -> DataFrame:
    channels = t.spark.createDataFrame([(0, 3), (1, 1), (2, 3)], "channel int, track_id int")
    return sums.with_zeros(interval_sums(t), t.windows(), channels).withColumn("total", F.col("total").cast("double"))


_DENSE = """SELECT w.window_id, c.range::INT AS channel, o.range AS "offset", {value} AS value
FROM win w CROSS JOIN range(1, 8) c CROSS JOIN range(4) o LEFT JOIN chroms ON {known}
LEFT JOIN sig ON {known2} AND sig.track_id = c.range AND sig.pos = w.start + o.range"""


@query(_DENSE.format(value="coalesce(value, 0)", known="w.chrom = chroms.chrom", known2="w.chrom = sig.chrom"))
def window_read_dense(t: Tables) -> DataFrame:
    return read.read_dense(t.windows(SHORT), t.signal, t.chroms, t.channels, SHORT, tile=TILE)


@query("SELECT window_id AS row, track_id AS channel, (pos - start)::BIGINT AS \"offset\", value FROM win4 win JOIN sig ON win.chrom = sig.chrom AND pos >= start AND pos < stop")
def window_read_sparse(t: Tables) -> DataFrame:
    return read.read_sparse(t.windows(SHORT), t.signal, t.chroms, t.channels, TILE)


@query("""SELECT w.window_id, c.range::INT AS channel, o.range AS "offset", CASE WHEN w.start + o.range >= 1000 THEN -2.0 ELSE coalesce(value, -1.0) END::DOUBLE AS value
FROM win w CROSS JOIN range(1, 8) c CROSS JOIN range(4) o LEFT JOIN sig ON w.chrom = sig.chrom AND sig.track_id = c.range AND sig.pos = w.start + o.range""")
def window_read_oob(t: Tables) -> DataFrame:
    """Chromosomes of 1,000 bases; missing is -1 and bases past the end are -2."""
    return read.read_dense(t.windows(SHORT), t.signal, t.chroms.withColumn("length", F.lit(1000).cast("long")), t.channels, SHORT, -1.0, -2.0, tile=TILE)


@query("""SELECT w.window_id, c.range::INT AS channel, o.range AS "offset", coalesce(value, -1.0)::DOUBLE AS value
FROM win w CROSS JOIN range(1, 8) c CROSS JOIN range(4) o LEFT JOIN sig ON w.chrom = sig.chrom AND w.chrom <> 'R' AND sig.track_id = c.range AND sig.pos = w.start + o.range""")
def window_missing_chrom(t: Tables) -> DataFrame:
    """Chromosome R is unknown: the default everywhere."""
    return read.read_dense(t.windows(SHORT), t.signal, t.chroms.where("chrom <> 'R'"), t.channels, SHORT, -1.0, None, tile=TILE)


@query("SELECT window_id, track_id AS channel, list(pos - start ORDER BY pos)::VARCHAR AS offsets FROM win4 win JOIN sig ON win.chrom = sig.chrom AND pos >= start AND pos < stop GROUP BY ALL")
def points_in_windows(t: Tables) -> DataFrame:
    return _points(t, SHORT)


def _points(t: Tables, width: int) -> DataFrame:
    points = t.signal.select("chrom", F.col("start").alias("pos"), "track_id")
    return read.points_read(t.windows(width), points, TILE).select("window_id", F.col("track_id").alias("channel"), F.col("offsets").cast("string").alias("offsets"))


# The reads above over whole windows and all channels.  They have no SQL; the tests hold them against brute force.


@query()
def label_sums_wide(t: Tables) -> DataFrame:
    return read.label_sums(t.windows(), t.signal, t.chroms, t.labels, WIDTH, tile=TILE)


@query()
def window_read_dense_wide(t: Tables) -> DataFrame:
    return read.read_dense(t.windows(), t.signal, t.chroms, t.channels, WIDTH, tile=TILE)


@query()
def window_read_sparse_wide(t: Tables) -> DataFrame:
    return read.read_sparse(t.windows(), t.signal, t.chroms, t.channels, TILE)


@query()
def window_read_oob_wide(t: Tables) -> DataFrame:
    """As window_read_oob."""
    return read.read_dense(t.windows(), t.signal, t.chroms.withColumn("length", F.lit(1000).cast("long")), t.channels, WIDTH, -1.0, -2.0, tile=TILE)


@query()
def window_missing_chrom_wide(t: Tables) -> DataFrame:
    """As window_missing_chrom."""
    return read.read_dense(t.windows(), t.signal, t.chroms.where("chrom <> 'R'"), t.channels, WIDTH, -1.0, None, tile=TILE)


@query()
def points_in_windows_wide(t: Tables) -> DataFrame:
    return _points(t, WIDTH)


@query("SELECT (CASE chrom WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT AS chrom_id, pos AS position, track_id, value FROM sig")
def entries_scan(t: Tables) -> DataFrame:
    ids = F.when(F.col("chrom") == "A", 0).when(F.col("chrom") == "N", 1).otherwise(2)
    return read.read_entries(t.signal, t.chroms.withColumn("chrom_id", ids))


@query("SELECT chrom, (pos // 256)::BIGINT AS tile, track_id, sum(value)::FLOAT::DOUBLE AS sum FROM sig GROUP BY ALL")
def tile_sums(t: Tables) -> DataFrame:
    return summary.tile_sums(t.signal, TILE).withColumn("sum", F.col("sum").cast("double"))


@query("SELECT chrom, (pos // 256)::BIGINT AS tile, sum(value)::DOUBLE AS sum FROM sig WHERE chrom = 'A' GROUP BY ALL")
def tile_sums_chrom(t: Tables) -> DataFrame:
    return summary.tile_sums(t.signal.where("chrom = 'A'"), TILE).groupBy("chrom", "tile").agg(F.sum(F.col("sum").cast("double")).alias("sum"))


@query("SELECT chrom, track_id, level, bin, sum(s) AS sum FROM (SELECT chrom, track_id, l.range::INT AS level, (tile // (4 ** l.range)::BIGINT)::BIGINT AS bin, s FROM (SELECT chrom, (pos // 16)::BIGINT AS tile, track_id, sum(value)::FLOAT::DOUBLE AS s FROM sig GROUP BY ALL) x CROSS JOIN range(1, 4) l) GROUP BY ALL")
def zoom_levels(t: Tables) -> DataFrame:
    return summary.zooms(summary.tile_sums(t.signal, 16), 3)


@query("SELECT track_id, sum(value)::DOUBLE AS total, count(*) AS nonzero, min(value) AS least, max(value) AS most FROM sig GROUP BY ALL")
def track_stats(t: Tables) -> DataFrame:
    return summary.track_stats(t.signal)


@query("SELECT count(*)::BIGINT AS bases, min(value) AS least, max(value) AS most, sum(value)::DOUBLE AS total, sum(value * value)::DOUBLE AS squares FROM sig")
def bigwig_summary(t: Tables) -> DataFrame:
    return summary.interval_total(t.signal)


@query("SELECT chrom, (pos // 40)::BIGINT AS bin, count(*)::BIGINT AS bases, min(value) AS least, max(value) AS most, sum(value)::DOUBLE AS total, sum(value * value)::DOUBLE AS squares FROM sig GROUP BY ALL")
def grid_zoom_stats(t: Tables) -> DataFrame:
    """Bins of all tracks together."""
    return summary.grid_zoom(t.signal, 40)


@query()
def greedy_zoom_records(t: Tables) -> DataFrame:
    return summary.greedy_zoom(t.signal, 40, ("chrom", "track_id"))


@query("SELECT track_id, count(*)::BIGINT AS bases, min(value) AS least, max(value) AS most, sum(value)::DOUBLE AS total, sum(value * value)::DOUBLE AS squares FROM sig GROUP BY ALL")
def bigwig_summary_tracks(t: Tables) -> DataFrame:
    return summary.interval_total(t.signal, ("track_id",))


@query("SELECT chrom, track_id, (pos // 40)::BIGINT AS bin, count(*)::BIGINT AS bases, min(value) AS least, max(value) AS most, sum(value)::DOUBLE AS total, sum(value * value)::DOUBLE AS squares FROM sig GROUP BY ALL")
def grid_zoom_stats_tracks(t: Tables) -> DataFrame:
    return summary.grid_zoom(t.signal, 40, ("chrom", "track_id"))


@query("SELECT track_id, CASE WHEN max(value) <= 255 THEN 'uint8' WHEN max(value) <= 65535 THEN 'uint16' ELSE 'uint32' END AS dtype FROM sig GROUP BY ALL")
def dtype_infer(t: Tables) -> DataFrame:
    return summary.infer_dtypes(t.signal)


_STRAND = "CASE WHEN reverse THEN '-' ELSE '+' END"


@query(f"SELECT chrom, {_STRAND} AS strand, CASE WHEN reverse THEN stop - 1 ELSE start END AS pos, count(*) AS n FROM reads GROUP BY ALL")
def count_five_prime(t: Tables) -> DataFrame:
    return counting.count_positions(t.reads)


@query(f"SELECT chrom, {_STRAND} AS strand, CASE WHEN reverse THEN start ELSE stop - 1 END AS pos, count(*) AS n FROM reads GROUP BY ALL")
def count_three_prime(t: Tables) -> DataFrame:
    return counting.count_positions(t.reads, "three")


@query(f"SELECT chrom, {_STRAND} AS strand, pos, count(*) AS n FROM (SELECT *, unnest([start, stop - 1]) AS pos FROM reads) GROUP BY ALL")
def count_both_ends(t: Tables) -> DataFrame:
    return counting.count_positions(t.reads, "both")


@query(f"SELECT chrom, {_STRAND} AS strand, CASE WHEN reverse THEN stop - 1 - 5 ELSE start + 4 END AS pos, count(*) AS n FROM reads GROUP BY ALL")
def count_shifted(t: Tables) -> DataFrame:
    return counting.count_positions(t.reads, plus=4, minus=-5)


@query("SELECT chrom, CASE WHEN reverse THEN stop - 1 ELSE start END AS pos, count(*) AS n FROM reads GROUP BY ALL")
def count_unstranded(t: Tables) -> DataFrame:
    return counting.count_positions(t.reads, stranded=False)


@query("SELECT chrom, CASE WHEN reverse THEN stop - 1 ELSE start END AS pos, count(*) AS n FROM reads GROUP BY ALL")
def pool_counts(t: Tables) -> DataFrame:
    """Four files by supplier, pooled."""
    return counting.pool(*(counting.count_positions(t.reads.where(F.col("supp") % 4 == k), stranded=False) for k in range(4)))


@query("SELECT chrom, pos, round(n * 1000000.0::DOUBLE / sum(n) OVER (), 6) AS value FROM (SELECT chrom, CASE WHEN reverse THEN stop - 1 ELSE start END AS pos, count(*) AS n FROM reads GROUP BY ALL)")
def scaled_counts(t: Tables) -> DataFrame:
    return counting.scaled(counting.count_positions(t.reads, stranded=False), 1e6, True).select("chrom", "pos", F.round("value", 6).alias("value"))


@query("SELECT chrom, sum(CASE WHEN pos < 0 OR pos >= length THEN 1 ELSE 0 END)::BIGINT AS lost FROM (SELECT chrom, CASE WHEN reverse THEN stop - 1 + 30 ELSE start - 30 END AS pos FROM reads) JOIN chroms USING (chrom) GROUP BY chrom")
def discard_report(t: Tables) -> DataFrame:
    return counting.discarded(counting.count_positions(t.reads, plus=-30, minus=30), t.chroms)


_COVER = """, ev AS (SELECT {k}, pos, sum(d) AS d FROM (SELECT {k}, start AS pos, 1 AS d FROM src UNION ALL SELECT {k}, stop, -1 FROM src) GROUP BY ALL HAVING sum(d) <> 0),
rn AS (SELECT {k}, pos AS start, lead(pos) OVER w AS stop, sum(d) OVER w AS depth FROM ev WINDOW w AS (PARTITION BY {k} ORDER BY pos))
SELECT {k}, start, stop AS "end", depth::BIGINT AS depth FROM rn WHERE depth <> 0"""


@query(", src AS (SELECT chrom, start, stop FROM reads)" + _COVER.format(k="chrom"))
def coverage_runs(t: Tables) -> DataFrame:
    return counting.coverage(t.reads.select("chrom", "start", "end"), region=512)


@query(f", src AS (SELECT chrom, {_STRAND} AS strand, start, stop FROM reads)" + _COVER.format(k="chrom, strand"))
def coverage_stranded(t: Tables) -> DataFrame:
    own = t.reads.select("chrom", F.when(F.col("reverse"), "-").otherwise("+").alias("strand"), "start", "end")
    return counting.coverage(own, ("chrom", "strand"), region=512)


@query("SELECT chrom, cell, pos, count(*) AS n FROM (SELECT chrom, cell, unnest([start, stop - 1]) AS pos FROM frag) GROUP BY ALL")
def cell_counts(t: Tables) -> DataFrame:
    return counting.count_positions(t.fragments, "both", stranded=False, keys=("cell",))


@query("SELECT cell, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS track_id FROM (SELECT cell, min(ordinal) AS first FROM frag GROUP BY cell)")
def cells_first_seen(t: Tables) -> DataFrame:
    return counting.cells_first_seen(t.fragments).select("cell", F.col("track_id").cast("long").alias("track_id"))


@query("SELECT s_suppkey AS track_id FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) AND s_nationkey % 2 = 0")
def select_tracks(t: Tables) -> DataFrame:
    joined = t.get("supplier").join(t.get("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t.get("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tracks = joined.select(F.col("s_suppkey").alias("track_id"), F.to_json(F.struct(F.col("r_name").alias("region"), (F.col("s_nationkey") % 2).alias("odd"))).alias("attrs"))
    first = t.get("region").agg(F.min("r_name")).first()[0]
    return catalog.select(tracks, region=first, odd=0).select("track_id")


@query("SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY ALL")
def track_attributes(t: Tables) -> DataFrame:
    return t.get("events").select(F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT chrom, pos, (track_id + CASE WHEN half = 1 THEN 7 ELSE 0 END)::INT AS track_id, sum(q)::DOUBLE AS value FROM (SELECT chrom, start AS pos, track_id, supp % 2 AS half, q FROM reads) GROUP BY ALL")
def track_union(t: Tables) -> DataFrame:
    part = lambda k: t.reads.where(F.col("supp") % 2 == k).groupBy("chrom", "start", "track_id").agg(F.sum("q").cast("double").alias("value")).withColumn("end", F.col("start") + 1)
    return catalog.union_signals([part(0), part(1)], [7, 7]).select("chrom", F.col("start").alias("pos"), "track_id", "value")


@query("SELECT chrom, pos AS start, pos + 1 AS \"end\", track_id, value FROM sig")
def reorder_tracks(t: Tables) -> DataFrame:
    return catalog.reordered(t.signal, "tracks").select("chrom", "start", "end", "track_id", "value")


@query("""SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", any_value(v) AS value FROM (
SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY pos) AS g FROM (
SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(v) OVER w = v THEN 0 ELSE 1 END AS f FROM (SELECT chrom, pos, (sum(value)::BIGINT % 2)::DOUBLE AS v FROM sig GROUP BY ALL) WINDOW w AS (PARTITION BY chrom ORDER BY pos)))
GROUP BY chrom, g""")
def rle_runs(t: Tables) -> DataFrame:
    one = t.signal.groupBy("chrom", "start").agg((F.sum("value").cast("long") % 2).cast("double").alias("value")).withColumn("end", F.col("start") + 1)
    return runs.encode(one, ("chrom",), block=512)


@query("""SELECT chrom, track_id, min(start) AS start, max(stop) AS "end" FROM (
SELECT *, sum(f) OVER (PARTITION BY chrom, track_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM (
SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY chrom, track_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM reads))
GROUP BY chrom, track_id, g""")
def merge_ranges(t: Tables) -> DataFrame:
    return runs.union_ranges(t.reads.select("chrom", "track_id", "start", "end"), ("chrom", "track_id"))


@query("SELECT DISTINCT chrom FROM win WHERE chrom NOT IN (SELECT chrom FROM chroms WHERE chrom <> 'N')")
def chrom_anti(t: Tables) -> DataFrame:
    return read.unknown_chroms(t.windows(), t.chroms.where("chrom <> 'N'"))


@query("SELECT chrom, count(*) AS n FROM reads WHERE chrom IN (SELECT chrom FROM chroms WHERE chrom <> 'N') GROUP BY chrom")
def read_filter_semi(t: Tables) -> DataFrame:
    return t.reads.join(t.chroms.where("chrom <> 'N'"), "chrom", "left_semi").groupBy("chrom").agg(F.count("*").alias("n"))


@query("""SELECT a.l_orderkey AS qname, a.l_partkey AS a_start, b.l_partkey AS b_start FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2
WHERE (a.l_orderkey, a.l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) = 1) AND (b.l_orderkey, b.l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) = 1)""")
def mate_pairs(t: Tables) -> DataFrame:
    number = F.col("l_linenumber")
    flag = F.when(number == 1, rf.PAIRED + rf.PROPER + rf.FIRST).when(number == 2, rf.PAIRED + rf.PROPER + rf.SECOND).otherwise(rf.UNMAPPED)
    own = t.get("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_partkey").alias("start")).where("n = 1")
    named = own.select(F.lit("f").alias("file"), F.col("l_orderkey").alias("qname"), number.alias("ordinal"), flag.alias("flag"), "start")
    return counting.mates(named).select("qname", "a_start", "b_start")


@query("""SELECT a.l_orderkey AS qname, CASE WHEN a.l_linestatus <> 'F' THEN a.l_partkey + a.l_quantity::BIGINT - 1 ELSE a.l_partkey END AS far,
CASE WHEN b.l_linestatus <> 'F' THEN b.l_partkey + b.l_quantity::BIGINT - 1 ELSE b.l_partkey END AS anchor, a.l_linestatus <> 'F' AS reverse
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2
WHERE (a.l_orderkey, a.l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) = 1) AND (b.l_orderkey, b.l_linenumber) IN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) = 1)""")
def mate_anchors(t: Tables) -> DataFrame:
    """The 5' end in the second read, the strand of the first."""
    number, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    flag = F.when(number == 1, rf.PAIRED + rf.PROPER + rf.FIRST).when(number == 2, rf.PAIRED + rf.PROPER + rf.SECOND).otherwise(rf.UNMAPPED)
    read = F.struct(F.col("l_partkey").alias("start"), (F.col("l_partkey") + q).alias("end"), (F.col("l_linestatus") != "F").alias("reverse"))
    own = t.get("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.first(read).alias("read")).where("n = 1")
    named = own.select(F.lit("f").alias("file"), F.col("l_orderkey").alias("qname"), number.alias("ordinal"), flag.alias("flag"), "read.start", "read.end", "read.reverse")
    return counting.mate_anchors(counting.mates(named), "second", True).select("qname", "far", "anchor", "reverse")


@query("SELECT (supp % 4)::VARCHAR AS file, chrom, pos, n, round(n * 1000000.0::DOUBLE / sum(n) OVER (PARTITION BY supp), 6) AS value FROM (SELECT supp % 4 AS supp, chrom, CASE WHEN reverse THEN stop - 1 ELSE start END AS pos, count(*) AS n FROM reads GROUP BY ALL)")
def counts_by_file(t: Tables) -> DataFrame:
    """Four files by supplier, each scaled by its own depth."""
    own = t.reads.withColumn("file", (F.col("supp") % 4).cast("string"))
    return counting.counts_by_file(own, t.chroms, stranded=False, factor=1e6, by_depth=True)[0].select("file", "chrom", "pos", "n", F.round("value", 6).alias("value"))


@query("SELECT CASE WHEN cell % 2 = 0 THEN cell // 2 END::BIGINT AS track_id, chrom, pos, count(*) AS n FROM (SELECT chrom, cell, unnest([start, stop - 1]) AS pos FROM frag) WHERE cell % 2 = 0 AND pos < 20000 GROUP BY ALL")
def counts_by_listed_cell(t: Tables) -> DataFrame:
    """Even cells are listed; chromosomes end at 20,000."""
    barcodes = t.fragments.select("cell").distinct().where("cell % 2 = 0").withColumn("track_id", F.floor(F.col("cell") / 2))
    chroms = t.fragments.select("chrom").distinct().withColumn("length", F.lit(20000).cast("long"))
    return counting.counts_by_cell(t.fragments, chroms, barcodes)[0]


@query("SELECT chrom, track_id, count(*) AS n FROM (SELECT *, max(stop) OVER (PARTITION BY chrom, track_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM reads) WHERE reach > start GROUP BY ALL")
def running_max_overlap(t: Tables) -> DataFrame:
    return runs.overlapping(t.reads.select("chrom", "track_id", "start", "end")).groupBy("chrom", "track_id").agg(F.count("*").alias("n"))


@query("SELECT chrom, track_id, start AS pos, count(*) AS n FROM reads GROUP BY ALL HAVING count(*) > 1")
def dup_entries(t: Tables) -> DataFrame:
    return runs.duplicate_entries(t.reads.withColumnRenamed("start", "pos"))


@query("SELECT (s_nationkey)::BIGINT AS nation, (parity)::BIGINT AS parity, track_id FROM (SELECT s_nationkey, s_suppkey % 2 AS parity, min(s_suppkey) AS track_id FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 2) = 2) GROUP BY ALL)")
def item_channel(t: Tables) -> DataFrame:
    """The least supplier of each nation and parity is its track; nations with both parities are the items."""
    s = t.get("supplier").withColumn("parity", F.col("s_suppkey") % 2)
    both = s.groupBy("s_nationkey").agg(F.countDistinct("parity").alias("n")).where("n = 2").select("s_nationkey")
    tracks = s.join(both, "s_nationkey").groupBy("s_nationkey", "parity").agg(F.min("s_suppkey").alias("track_id"))
    placed = read.arrange(tracks, "s_nationkey", "parity")
    return placed.join(tracks, "track_id").select(F.col("s_nationkey").cast("long").alias("nation"), F.col("parity").cast("long").alias("parity"), "track_id")


@query("SELECT i, j, sum(n)::BIGINT AS n FROM (SELECT least(a, b) AS i, greatest(a, b) AS j, n FROM px UNION ALL SELECT greatest(a, b), least(a, b), n FROM px WHERE a <> b) GROUP BY ALL".replace("FROM px", "FROM (SELECT l_partkey % 100 AS a, l_suppkey % 100 AS b, count(*) AS n FROM lineitem GROUP BY ALL)"))
def hic_mirror(t: Tables) -> DataFrame:
    pixels = t.get("lineitem").groupBy((F.col("l_partkey") % 100).alias("bin1"), (F.col("l_suppkey") % 100).alias("bin2")).agg(F.count("*").alias("n"))
    return counting.mirrored(pixels)


@query("SELECT (l_partkey - 1) * 1000 + (l_suppkey - 1) AS cell, count(*) AS n FROM lineitem GROUP BY ALL")
def pair_linearise(t: Tables) -> DataFrame:
    return t.get("lineitem").groupBy(rf.pair_index(F.col("l_partkey"), F.col("l_suppkey"), 1, 1, 1000).alias("cell")).agg(F.count("*").alias("n"))


@query("SELECT ((r - 1) // 1024)::BIGINT AS block, count(*) AS n, min(ordinal) AS first FROM (SELECT ordinal, row_number() OVER (ORDER BY ordinal) AS r FROM frag) GROUP BY ALL")
def group_blocks(t: Tables) -> DataFrame:
    own = counting.ranked(t.fragments.select("ordinal"), "ordinal", "rank")
    return own.groupBy(F.floor(F.col("rank") / 1024).alias("block")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))


@query("SELECT label, i AS bin, round(sum(v), 6) AS total FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL")
def dense_label_sums(t: Tables) -> DataFrame:
    e = t.get("embeddings").select(F.col("vec_id").cast("int").alias("track_id"), "label", F.posexplode("embedding").alias("start", "v"))
    signal = e.select(F.lit("x").alias("chrom"), F.col("start").cast("long").alias("start"), (F.col("start") + 1).cast("long").alias("end"), "track_id", F.col("v").cast("double").alias("value"))
    width = 64
    chroms = t.spark.createDataFrame([("x", width)], "chrom string, length long")
    window = t.spark.createDataFrame([(0, "x", 0, width)], "window_id long, chrom string, start long, end long")
    labels = t.get("embeddings").select(F.col("vec_id").cast("int").alias("track_id"), "label")
    out = read.label_sums(window, signal, chroms, labels, width, tile=TILE)
    return out.select("label", "bin", F.round("total", 6).alias("total"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
