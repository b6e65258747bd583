"""Reads by the places of bases in their tiles: nothing is shuffled by window, and odd windows are read whole."""

import re
from collections import defaultdict

import pytest
from basetrack import entrypoints
from basetrack.operators import read

RUNS = [("c", 0, 9, 0, 2.0), ("c", 14, 40, 0, 3.0), ("c", 15, 16, 1, 5.0), ("c", 40, 41, 70, float("nan")), ("c", 47, 49, 70, 1.0)]
WINDOWS = [(1, "c", 3, 33), (2, "c", 14, 44), (1, "c", 30, 60), (3, "d", 0, 30)]


@pytest.fixture(scope="module")
def frames(spark):
    return (
        spark.createDataFrame(WINDOWS, "window_id long, chrom string, start long, end long"),
        spark.createDataFrame(RUNS, "chrom string, start long, end long, track_id int, value double"),
        spark.createDataFrame([("c", 50)], "chrom string, length long"),
        spark.createDataFrame([(0, 0), (1, 0), (70, 65)], "track_id int, channel int"),
    )


def stored(channel):
    """Sums by base of the tracks of a channel."""
    out = {}
    for _, s, e, t, v in RUNS:
        if (65 if t == 70 else 0) == channel:
            for p in range(s, e):
                out[p] = out.get(p, 0.0) + v
    return out


def sums(bins):
    out = defaultdict(float)
    for w, c, s, e in WINDOWS:
        for ch in (0, 65):
            for p, v in stored(ch).items():
                if c == "c" and s <= p < min(e, 50):
                    out[w, ch, (p - s) // bins] += v
    return {k: repr(v) for k, v in out.items()}


def by_window(spark, name):
    """Whether the query's plan shuffles by window."""
    return "hashpartitioning(window_id" in entrypoints.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["label_sums_wide", "label_sums"])
def test_label_sums_are_not_shuffled_by_window(spark, name):
    assert not by_window(spark, name)


@pytest.mark.parametrize("bins", [1, 2, 3, 5])
def test_small_bins_across_tiles_and_repeated_ids(frames, bins):
    windows, signal, chroms, channels = frames
    rows = read.binned_sums(windows, signal, chroms, channels, 30, bins, tile=16).collect()
    assert len(rows) == len({(r.window_id, r.channel, r.bin) for r in rows})
    assert {(r.window_id, r.channel, r.bin): repr(r.total) for r in rows} == sums(bins)


@pytest.mark.parametrize("name", ["window_read_dense_wide", "window_read_dense"])
def test_dense_reads_are_not_shuffled_by_window(spark, name):
    assert not by_window(spark, name)


@pytest.mark.parametrize("tile", [16, 1024])
def test_dense_read_of_repeated_ids_and_unknown_chromosomes(spark, frames, tile):
    windows, signal, chroms, _ = frames
    channels = spark.createDataFrame([(70, 0), (70, 1), (5, 2)], "track_id int, channel int")
    rows = read.read_dense(windows, signal, chroms, channels, 30, -1.0, -2.0, tile=tile).collect()
    own = stored(65)
    want = [(w, ch, p - s, -1.0 if c == "d" else -2.0 if p >= 50 else own.get(p, -1.0) if ch < 2 else -1.0) for w, c, s, e in WINDOWS for ch in range(3) for p in range(s, e)]
    assert sorted(map(repr, ((r.window_id, r.channel, r.offset, r.value) for r in rows))) == sorted(map(repr, want))


def test_reads_of_missing_chromosomes_are_not_shuffled_by_window(spark):
    assert not by_window(spark, "window_missing_chrom_wide")


def test_shuffled_windows_have_no_bounds_of_their_parts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entrypoints.queries()["window_missing_chrom_wide"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sent = [plan[i + 1] for i, line in enumerate(plan[:-1]) if "Exchange hashpartitioning" in line and "window_id" in plan[i + 1]]
    assert len(sent) == 1
    assert not re.search(r" AS (lo|hi)#|\b(start|end|stop|lo|hi)#\d+L?, ", sent[0])


@pytest.mark.parametrize("name", ["points_in_windows_wide", "points_in_windows"])
def test_points_are_not_shuffled_by_window(spark, name):
    assert not by_window(spark, name)


@pytest.mark.parametrize("longest", [30, 100_000])
def test_points_of_repeated_ids_repeated_places_and_long_windows(spark, longest):
    at = [3, 3, 15, 16, 29, 31, 32, 32, 33, 90, 99_999, 100_000]
    points = spark.createDataFrame([("c", p, t) for p in at for t in (0, 1)] + [("d", 1, 0)], "chrom string, pos long, track_id int")
    windows = [(1, "c", 3, 33), (2, "c", 32, 33), (3, "c", 50, 60), (1, "c", 70, 100), (4, "c", 0, longest)]
    want = defaultdict(list)
    for w, _, s, e in windows:
        for p in at:
            if s <= p < e:
                want[w].append(p - s)
    got = read.points_read(spark.createDataFrame(windows, "window_id long, chrom string, start long, end long"), points, 16).collect()
    assert {(r.window_id, r.track_id): r.offsets for r in got} == {(w, t): sorted(v) for w, v in want.items() for t in (0, 1)}
    assert len(got) == 2 * len(want)
