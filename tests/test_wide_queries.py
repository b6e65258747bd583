"""The reads of whole windows and all tracks against brute force, on a few rows."""

import datetime
import math
from collections import defaultdict

import pytest
from basetrack import entrypoints

LINES = [(c, pos, track, 1.0 + (pos * 7 + track) % 9) for c, pos in (("A", 5), ("A", 104), ("N", 40), ("N", 41), ("N", 139), ("R", 90), ("R", 980), ("R", 1010)) for track in range(1, 8)]
ORDERS = [(1, 3), (2, 40), (3, 950), (4, 90), (5, 20)]  # key, customer: A, N, R, A and R
WIDTH = 100


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, c, pos, track, q, "F", 1) for i, (c, pos, track, q) in enumerate([*LINES, LINES[0]])]
    spark.createDataFrame(rows, "l_orderkey long, l_returnflag string, l_partkey long, l_linenumber int, l_quantity double, l_linestatus string, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(*o, datetime.date(2024, 1, 1)) for o in ORDERS], "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{d}/orders.parquet")
    return d


@pytest.fixture(scope="module")
def signal():
    out = defaultdict(float)
    for c, pos, track, q in [*LINES, LINES[0]]:
        out[c, pos, track] += q
    return out


def windows():
    return [(key, "ANR"[at % 3], at) for key, at in ORDERS]


def ends(signal):
    out = defaultdict(int)
    for c, pos, _, q in LINES:
        out[c] = max(out[c], pos + int(q) + 1)
    return out


def dense(signal, lengths, default, oob):
    out = {}
    for key, c, at in windows():
        for track in range(1, 8):
            for k in range(WIDTH):
                known = c in lengths
                past = known and at + k >= lengths[c]
                v = oob if past and oob is not None else default if past or not known else signal.get((c, at + k, track), default)
                out[key, track, k] = "nan" if math.isnan(v) else v
    return out


def got(df, *keys, value="value"):
    rows = df.collect()
    out = {tuple(r[k] for k in keys): "nan" if isinstance(r[value], float) and math.isnan(r[value]) else r[value] for r in rows}
    assert len(out) == len(rows)
    return out


def run(spark, sf_dir, name):
    return entrypoints.queries()[name](spark, sf_dir)


def test_dense_reads(spark, sf_dir, signal):
    at = ("window_id", "channel", "offset")
    lengths = ends(signal)
    assert got(run(spark, sf_dir, "window_read_dense_wide"), *at) == dense(signal, lengths, 0.0, float("nan"))
    assert got(run(spark, sf_dir, "window_read_oob_wide"), *at) == dense(signal, dict.fromkeys("ANR", 1000), -1.0, -2.0)
    assert got(run(spark, sf_dir, "window_missing_chrom_wide"), *at) == dense(signal, {c: n for c, n in lengths.items() if c != "R"}, -1.0, None)


def test_sparse_reads(spark, sf_dir, signal):
    lengths = ends(signal)
    found = {(key, track, pos - at): v for key, c, at in windows() for (c2, pos, track), v in signal.items() if c == c2 and at <= pos < min(at + WIDTH, lengths[c])}
    assert any(k >= 4 for _, _, k in found)
    assert got(run(spark, sf_dir, "window_read_sparse_wide"), "row", "channel", "offset") == found
    points = defaultdict(list)
    for key, track, k in sorted(found):
        points[key, track].append(k)
    assert got(run(spark, sf_dir, "points_in_windows_wide"), "window_id", "channel", value="offsets") == {k: str(v) for k, v in points.items()}
    labels = defaultdict(float)
    for (key, track, k), v in found.items():
        if track < 7:
            labels[key, track % 3, k] += v
    assert got(run(spark, sf_dir, "label_sums_wide"), "window_id", "label", "bin", value="total") == labels


def test_greedy_zoom_records_of_all_tracks(spark, sf_dir, signal):
    want, last = defaultdict(list), {}
    for (c, pos, track), v in sorted(signal.items()):
        if (c, track) not in last or pos >= last[c, track] + 40:
            last[c, track] = pos
            want[c, track].append([pos, pos + 1, 0, v, v, 0.0, 0.0])
        r = want[c, track][-1]
        want[c, track][-1] = [r[0], pos + 1, r[2] + 1, min(r[3], v), max(r[4], v), r[5] + v, r[6] + v * v]
    rows = run(spark, sf_dir, "greedy_zoom_records").collect()
    assert sorted((r.chrom, r.track_id, r.start, r.end, r.bases, r.least, r.most, r.total, r.squares) for r in rows) == sorted((*k, *r) for k, v in want.items() for r in v)
