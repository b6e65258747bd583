"""Reads, sums, summaries and runs against a dense numpy cube."""

import numpy as np
import pytest
from basetrack import schema
from basetrack.operators import counting, read, runs, sums, summary
from pyspark.sql import functions as F

AXES = [("chr1", 700), ("chr2", 301), ("chrM", 70)]
TRACKS, WIDTH, TILE = 4, 24, 16


@pytest.fixture(scope="module")
def cube(spark):
    """Dense values by chromosome, the same as runs, and windows, some of which run past an end."""
    g = np.random.default_rng(7)
    dense, rows = {}, []
    for chrom, length in AXES:
        d = np.zeros((TRACKS, length))
        for t in range(TRACKS - 1):  # the last track is empty
            at = 0
            while at < length:
                n = int(g.integers(1, 40))
                if g.random() < 0.4:
                    d[t, at : at + n] = float(g.integers(1, 400)) * (-1 if t == 2 else 1)
                    rows.append((chrom, at, min(at + n, length), t, float(d[t, at])))
                at += n
        dense[chrom] = d
    windows = [(i, c, int(s), int(s) + WIDTH) for i, (c, s) in enumerate(zip(g.choice([c for c, _ in AXES], 60), g.integers(0, 720, 60), strict=True))]
    windows = [(i, str(c), s, e) for i, c, s, e in windows]
    frame = {
        "signal": spark.createDataFrame(rows, schema.SIGNAL).cache(),
        "chroms": spark.createDataFrame(schema.chrom_rows(AXES, TILE), schema.CHROMS),
        "windows": spark.createDataFrame(windows, "window_id long, chrom string, start long, end long"),
        "channels": spark.createDataFrame([(t, t) for t in range(TRACKS)], "channel int, track_id int"),
    }
    return dense, windows, frame


def expected(dense, window, oob):
    _, chrom, start, end = window
    d = dense[chrom]
    out = np.full((TRACKS, end - start), oob)
    n = max(min(end, d.shape[1]) - start, 0)
    out[:, :n] = d[:, start : start + n]
    return out


@pytest.mark.parametrize("tile", [16, 64, 1024])
def test_dense_read(cube, tile):
    dense, windows, f = cube
    got = np.full((len(windows), TRACKS, WIDTH), 9e9)
    for r in read.read_dense(f["windows"], f["signal"], f["chroms"], f["channels"], WIDTH, oob=float("nan"), tile=tile).collect():
        got[r.window_id, r.channel, r.offset] = r.value
    np.testing.assert_array_equal(got, np.stack([expected(dense, w, np.nan) for w in windows]))


def test_duplicate_channels_and_sparse(spark, cube):
    dense, windows, f = cube
    twice = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "channel int, track_id int")
    got = np.zeros((len(windows), 3, WIDTH))
    for r in read.read_sparse(f["windows"], f["signal"], f["chroms"], twice, TILE).collect():
        got[r.row, r.channel, r.offset] = r.value
    want = np.stack([expected(dense, w, 0.0) for w in windows])[:, [2, 0, 2]]
    np.testing.assert_array_equal(got, want)


@pytest.mark.parametrize("split", [False, True])
def test_sums(cube, split):
    dense, windows, f = cube
    if split:
        out = sums.tile_split_sums(f["windows"], f["signal"], summary.tile_sums(f["signal"], TILE), f["chroms"], TILE)
    else:
        out = sums.interval_sums(f["windows"], f["signal"], f["chroms"], tile=TILE)
    got = np.zeros((len(windows), TRACKS))
    for r in sums.with_zeros(out, f["windows"], f["channels"]).collect():
        got[r.window_id, r.channel] = r.total
    np.testing.assert_array_equal(got, np.stack([expected(dense, w, 0.0).sum(1) for w in windows]))


def test_bins_and_labels(spark, cube):
    dense, windows, f = cube
    labels = spark.createDataFrame([(0, 0), (1, 2), (2, 0), (3, -1)], "track_id int, label int")
    got = np.zeros((len(windows), 3, 4))
    for r in read.label_sums(f["windows"], f["signal"], f["chroms"], labels, WIDTH, 6, True, TILE).collect():
        got[r.window_id, r.label, r.bin] = r.total
    base = np.stack([expected(dense, w, 0.0) for w in windows]).reshape(len(windows), TRACKS, 4, 6).sum(3)
    np.testing.assert_array_equal(got, np.stack([base[:, 0] + base[:, 2], np.zeros_like(base[:, 0]), base[:, 1]], 1))
    with pytest.raises(ValueError, match="divide"):
        read.binned_sums(f["windows"], f["signal"], f["chroms"], f["channels"], WIDTH, 7)
    with pytest.raises(ValueError, match="two labels"):
        read.check_labels(labels.unionAll(labels))


def test_nan_policies(cube):
    dense, windows, f = cube
    nan = f["signal"].withColumn("value", F.when(F.col("start") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    skip = {(r.window_id, r.track_id): r.total for r in sums.interval_sums(f["windows"], nan, f["chroms"], "skip", TILE).collect()}
    propagate = {(r.window_id, r.track_id): r.total for r in sums.interval_sums(f["windows"], nan, f["chroms"], "propagate", TILE).collect()}
    count = {(r.window_id, r.track_id): r.total for r in sums.interval_sums(f["windows"], nan, f["chroms"], "count", TILE).collect()}
    for k, total in propagate.items():
        inside = min(windows[k[0]][3], dict(AXES)[windows[k[0]][1]]) - windows[k[0]][2]
        assert np.isnan(total) == (count[k] < inside)
        assert np.isnan(total) or total == skip[k]
    with pytest.raises(ValueError, match="nan is one of"):
        sums.interval_sums(f["windows"], nan, f["chroms"], "drop")


def test_summaries(cube):
    dense, _, f = cube
    tiles = {(r.chrom, r.tile, r.track_id): r.sum for r in summary.tile_sums(f["signal"], TILE).collect()}
    for (chrom, tile, track), total in tiles.items():
        assert total == np.float32(dense[chrom][track, tile * TILE : (tile + 1) * TILE].sum())
    for r in summary.zooms(summary.tile_sums(f["signal"], TILE), 2).collect():
        size = TILE * 4**r.level
        assert r.sum == dense[r.chrom][r.track_id, r.bin * size : (r.bin + 1) * size].sum()
    for r in summary.track_stats(f["signal"]).collect():
        every = np.concatenate([d[r.track_id] for d in dense.values()])
        some = every[every != 0]
        assert (r.total, r.nonzero, r.least, r.most) == (some.sum(), len(some), some.min(), some.max())


def test_runs_round_trip(cube):
    _, _, f = cube
    joined = runs.encode(f["signal"]).orderBy("chrom", "track_id", "start")
    blocks = runs.encode(runs.points(f["signal"]).withColumns({"start": F.col("pos"), "end": F.col("pos") + 1}).drop("pos"), block=32).select(*joined.columns).orderBy("chrom", "track_id", "start")
    assert joined.collect() == blocks.collect()
    assert runs.overlapping(f["signal"]).isEmpty()


def test_greedy_zoom(spark):
    rows = [("a", 0, 5, 0, 1.0), ("a", 9, 12, 0, 3.0), ("a", 10, 11, 0, 2.0), ("b", 3, 4, 0, 5.0)]
    out = summary.greedy_zoom(spark.createDataFrame(rows, schema.SIGNAL), 10).orderBy("chrom", "start").collect()
    assert [(r.chrom, r.start, r.end, r.bases) for r in out] == [("a", 0, 12, 8), ("a", 10, 11, 1), ("b", 3, 4, 1)]


def test_coverage_equals_sweep(spark):
    g = np.random.default_rng(2)
    depth, rows = np.zeros(3000, int), []
    for s, n in zip(g.integers(0, 2900, 300), g.integers(0, 90, 300), strict=True):
        depth[s : s + n] += 1
        rows.append(("c", int(s), int(s + n)))
    for region in (64, 1000, 1 << 20):
        got, ends = np.zeros(3000, int), set()
        for r in counting.coverage(spark.createDataFrame(rows, "chrom string, start long, end long"), region=region).collect():
            got[r.start : r.end] = r.depth
            ends |= {r.start, r.end}
        np.testing.assert_array_equal(got, depth)
        assert ends == set((np.flatnonzero(np.diff(depth, prepend=0, append=0))).tolist())


def test_missing_and_unknown(spark, cube):
    _, _, f = cube
    w = spark.createDataFrame([(0, "chrM", 68, 72), (1, "chrX", 0, 4)], f["windows"].schema)
    one = f["channels"].where("channel = 0")
    got = {(r.window_id, r.offset): r.value for r in read.read_dense(w, f["signal"].limit(0), f["chroms"], one, 4, -1.0, -2.0).collect()}
    assert got == {(0, 0): -1, (0, 1): -1, (0, 2): -2, (0, 3): -2, **{(1, i): -1 for i in range(4)}}
    with pytest.raises(ValueError, match="chrX"):
        read.check_known(w, f["chroms"])
    with pytest.warns(UserWarning, match="chrX"):
        read.check_known(w, f["chroms"], strict=False)
    with pytest.raises(ValueError, match="starts at"):
        read.check_windows(w.withColumn("start", F.lit(-1).cast("long")))


def test_types():
    assert schema.infer_dtype(0, 255, False) == "uint8" and schema.infer_dtype(-1, 255, False) == "int16" and schema.infer_dtype(0, 2**33, False) == "float64"
    assert schema.infer_dtype(0, 1, True) == "float32" and schema.infer_dtype(None, None, False) == "uint8"
    assert schema.promote(["uint8", "int8"]) == "int16" and schema.promote(["uint32", "float32"]) == "float64" and schema.promote(["float32"], True) == "float32"
    for bad in ([], [("a", 0)], [("a", 1), ("a", 2)], [("", 1)]):
        with pytest.raises(ValueError):
            schema.check_chroms(bad)
    for bad in (["a", "a"], [{"name": "a", "group": 1}], [{"name": "a", "dtype": "int7"}], [{"name": "a", "x": float("nan")}]):
        with pytest.raises(ValueError):
            schema.check_tracks(bad)


def test_ranges_in_blocks(spark):
    """Union and overlap against plain loops, with ranges that span blocks and none that do."""
    import random

    from basetrack.operators import runs

    r = random.Random(6)
    rows = [(c, s, s + r.choice([1, 2, 3, 9, 70]), None if c == "b" else 1) for c in "ab" for s in r.sample(range(600), 60)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, track_id int")
    for block in (16, 64, 1 << 20):
        union, over = [], set()
        for c in "ab":
            reach, own = None, sorted(x for x in rows if x[0] == c)
            for x in own:
                if reach is None or x[1] > reach:
                    union.append([c, x[1], x[2]])
                union[-1][2] = max(union[-1][2], x[2])
                if reach is not None and reach > x[1]:
                    over.add((c, x[1], reach))
                reach = x[2] if reach is None else max(reach, x[2])
        assert sorted((x.chrom, x.start, x.end) for x in runs.union_ranges(df, ("chrom",), block).collect()) == sorted(map(tuple, union))
        assert {(x.chrom, x.start, x.reach) for x in runs.overlapping(df, ("chrom", "track_id"), block).collect()} == over
