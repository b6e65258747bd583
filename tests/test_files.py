"""Sources, sinks, datasets, streams and fibre reads."""

import struct
import zlib

import numpy as np
import pytest
from basetrack import schema
from basetrack.functions import fibers
from basetrack.functions import reads as rf
from basetrack.operators import catalog, counting
from basetrack.plans.sums import choose_sums
from basetrack.sinks.bigwig import write_bigwigs
from basetrack.sources import bam, bigwig, dataset, text
from basetrack.streaming.append import append_stream, tiles_in_time
from pyspark.sql import functions as F

AXES = [("chr2", 500), ("chr1", 9000)]
ROWS = [("chr1", 0, 10, 0, 1.5), ("chr1", 20, 25, 0, 2.0), ("chr2", 5, 6, 0, 3.0), ("chr1", 3, 8, 1, 7.0)]


@pytest.fixture
def signal(spark):
    return spark.createDataFrame(ROWS, schema.SIGNAL)


def test_bigwig_round_trip(spark, signal, tmp_path):
    paths = {t: str(tmp_path / f"{t}.bw") for t in (0, 1)}
    assert write_bigwigs(signal, AXES, paths) == sorted(paths.values())
    assert bigwig.chrom_sizes(paths[0]) == AXES
    for t in paths:
        got = sorted(tuple(r) for r in bigwig.read_bigwig(spark, paths[t]).collect())
        assert got == sorted((c, s, e, v) for c, s, e, k, v in ROWS if k == t)


def test_bigwig_with_many_blocks(spark, tmp_path):
    path = str(tmp_path / "many.bw")
    starts = np.arange(0, 900_000, 2)
    bigwig.write_file(path, [("c", 1_000_000)], iter([(0, starts, starts + 1, np.ones(len(starts)))]))
    assert len(bigwig.Header(path).blocks) > bigwig.NODE_ITEMS
    out = bigwig.read_bigwig(spark, path).agg(F.count("*"), F.sum("start"), F.sum("value")).first()
    assert tuple(out) == (450_000, int(starts.sum()), 450_000.0)
    with pytest.raises(ValueError, match="overlap"):
        bigwig.write_file(path, [("c", 10)], iter([(0, np.array([0, 1]), np.array([2, 3]), np.ones(2))]))
    (tmp_path / "bad.bw").write_bytes(b"x" * 100)
    with pytest.raises(ValueError, match="not a little-endian"):
        bigwig.Header(str(tmp_path / "bad.bw"))


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam_record(name, flag, ref, pos, cigar, seq, tags=b""):
    import re

    ops = [(int(n) << 4) | bam.OPERATIONS.index(o) for n, o in re.findall(r"(\d+)(.)", cigar)]
    codes = [bam.BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
    packed = bytes((codes[i] << 4) | codes[i + 1] for i in range(0, len(codes), 2))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


@pytest.mark.parametrize("aligned", [False, True])
def test_bam(spark, tmp_path, aligned):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + b"\0" + struct.pack("<i", k) for n, k in ((b"chr2", 500), (b"chr1", 9000)))
    one = bam_record("r1", 16, 1, 100, "3S10M2D5M", "ACGTACGTACGTACGTAC", b"MMZA+a,0;\0MLBC" + struct.pack("<i", 1) + b"\xc8")
    two = bam_record("r2", 4, -1, -1, "", "")
    if aligned:
        data = block(head) + block(one) + block(two) + block(b"")
    else:
        whole = head + one + two
        data = block(whole[:50]) + block(whole[50:90]) + block(whole[90:]) + block(b"")
    path = tmp_path / "a.bam"
    path.write_bytes(data)
    rows = {r.qname: r for r in bam.read_bam(spark, str(path), aligned=aligned).collect()}
    r = rows["r1"]
    assert (r.flag, r.chrom, r.start, r.cigar, r.seq, r.tags) == (16, "chr1", 100, "3S10M2D5M", "ACGTACGTACGTACGTAC", {"MM": "A+a,0;", "ML": "200"})
    assert rows["r2"].chrom is None and rows["r2"].cigar == "*"


def test_cigar(spark):
    df = spark.createDataFrame([(10, "3S10M2D5M1I4=3N2X")], "start long, cigar string")
    r = df.select(rf.reference_length(F.col("cigar")).alias("n"), rf.aligned_blocks(F.col("start"), F.col("cigar")).alias("b")).first()
    assert r.n == 26 and [tuple(x) for x in r.b] == [(10, 20), (22, 31), (34, 36)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#head\n\nchr1\t5.0\t9\tx\t0\t-\r\nchr2 1 2\n")
    rows = text.read_intervals(spark, str(tmp_path / "a.bed"), 6).orderBy("chrom").collect()
    assert [(r.chrom, r.start, r.end, r.reverse) for r in rows] == [("chr1", 5, 9, True), ("chr2", 1, 2, False)]
    (tmp_path / "b.bed").write_text("chr1\t5\n")
    with pytest.raises(Exception, match="fewer than three"):
        text.read_intervals(spark, str(tmp_path / "b.bed")).collect()
    (tmp_path / "f.tsv").write_text("chr1\t1\t5\tAA\t2\nchr1\t2\t6\tBB\t1\nchr1\t3\t7\tAA\t1\n")
    fragments = text.read_fragments(spark, str(tmp_path / "f.tsv"))
    assert [(r.cell, r.track_id) for r in counting.cells_first_seen(fragments).orderBy("track_id").collect()] == [("AA", 0), ("BB", 1)]
    (tmp_path / "s.fa").write_text(">b one\nACGT\nAC\n>a\nA\n")
    assert text.read_chrom_sizes(spark, str(tmp_path / "s.fa")) == [("b", 6), ("a", 1)]
    (tmp_path / "m.tsv").write_text("file\tassay\nx.bam\tATAC\ny.bam\t\n")
    table = text.read_metadata(spark, str(tmp_path / "m.tsv"))
    paths = spark.createDataFrame([("/d/x.bam",), ("y.bam",)], "path string")
    assert {r.path: r.assay for r in catalog.read_attributes(table, paths).collect()} == {"/d/x.bam": "ATAC", "y.bam": None}
    with pytest.raises(ValueError, match="no metadata"):
        catalog.read_attributes(table, spark.createDataFrame([("z",)], "path string"))


def test_dataset(spark, signal, tmp_path):
    path = f"file://{tmp_path}/ds"
    ds = dataset.write_dataset(spark, path, AXES, [{"name": "a", "assay": "ATAC"}, "b"], signal, tile=16)
    assert dataset.is_dataset(spark, path) and not dataset.is_dataset(spark, f"file://{tmp_path}")
    assert [r.track_id for r in ds.select(assay="ATAC").collect()] == [0]
    with pytest.raises(ValueError, match="no track has x"):
        ds.select(x=1)
    assert {r.name: (r.dtype, r.total) for r in ds.info().collect()} == {"a": ("float32", 28.0), "b": ("uint8", 35.0)}
    with pytest.raises(FileExistsError):
        dataset.write_dataset(spark, path, AXES, ["a"], signal.where("track_id = 0"))
    more = dataset.append_tracks(ds, ["c"], signal.where("track_id = 1").withColumn("track_id", F.lit(0)))
    assert more.tracks.count() == 3 and ds.tracks.count() == 2  # the old snapshot stays
    other = dataset.reorder(ds, f"file://{tmp_path}/r", "tracks")
    cells = lambda d: sorted(tuple(r) for r in d.signal.select("chrom", "start", "end", "track_id", "value").collect())
    assert cells(other) == cells(ds) == sorted(ROWS)
    with pytest.raises(ValueError, match="one name"):
        dataset.merge(f"file://{tmp_path}/m", ds, ds)
    windows = spark.createDataFrame([(0, "chr1", 0, 9000)], "window_id long, chrom string, start long, end long")
    whole = ds.signal.where("track_id = 1")
    for rewrite in ("auto", "off"):
        out = choose_sums(windows, whole, ds.chroms, ds.stats.where("track_id = 1"), ds.tile_sums.where("track_id = 1"), True, 16, rewrite)
        assert [r.total for r in out.collect()] == [35.0]


@pytest.mark.parametrize("row,message", [(("chr1", 5, 5, 0, 1.0), "empty"), (("chr1", 8995, 9001, 0, 1.0), "beyond"), (("x", 1, 2, 0, 1.0), "unknown"), (("chr1", 1, 2, 5, 1.0), "track"), (("chr1", 1, 2, 0, float("inf")), "infinite"), (("chr1", 9, 12, 0, 1.0), "overlap")])
def test_bad_signals(spark, signal, tmp_path, row, message):
    with pytest.raises(ValueError, match=message):
        dataset.write_dataset(spark, f"file://{tmp_path}/d", AXES, ["a", "b"], signal.unionAll(spark.createDataFrame([row], schema.SIGNAL)))
    assert not dataset.is_dataset(spark, f"file://{tmp_path}/d")


def test_streams(spark, signal, tmp_path):
    signal.where("start < 10").write.parquet(f"{tmp_path}/in/1")
    rows = spark.readStream.schema(signal.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for _ in range(2):
        append_stream(rows, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/signal").count() == 3
    spark.createDataFrame([("chr1", 2, 4, 0, 1.0)], signal.schema).write.parquet(f"{tmp_path}/in/2")
    with pytest.raises(Exception, match="before what is written"):
        append_stream(rows, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    events = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as event_type, 2.0D as value union all select timestamp'2024-01-01 00:50:00', 'a', 3.0D")
    assert [(r.n, r.total) for r in tiles_in_time(events).collect()] == [(2, 5.0)]


def test_mates_names_and_reasons(spark):
    schema_ = "file string, ordinal long, qname string, flag int, chrom string, start long, mapq int"
    rows = [("f", 0, "a", 67, "c", 5, 9), ("f", 1, "a", 67, "c", 6, 9), ("f", 2, "a", 131, "c", 50, 9), ("f", 3, "b", 67, "c", 7, 9), ("f", 4, "d", 4, "c", 0, 0), ("f", 5, "e", 256, "c", 0, 0), ("f", 6, "g", 0, "c", 0, 1)]
    reads = spark.createDataFrame(rows, schema_)
    assert [(r.qname, r.a_start, r.b_start) for r in counting.mates(reads).collect()] == [("a", 6, 50)]
    assert {r.reason: r.n for r in counting.skip_reasons(reads, 5).collect()} == {None: 4, "unmapped": 1, "secondary": 1, "low_mapq": 1}
    assert sorted(r.track for r in counting.unique_names(reads.where("qname = 'a'")).collect()) == ["a", "a@c:50#3", "a@c:6"]


def test_fibers(spark):
    places = fibers.reference_positions(100, "2S3M1D2M1I1M")
    assert places.tolist() == [-1, -1, 100, 101, 102, 104, 105, -1, 106]
    assert fibers.modification_calls("AACAA", 0, "A+a,1,0;C+m,0;", [10, 20, 30], "m6a") == [(1, 10), (3, 20)]
    assert fibers.modification_calls("TTGTT", 16, "A+a,1,0;", [10, 20], "m6a") == [(1, 20), (3, 10)]
    assert fibers.place_interval(0, 4, places, 0) == (100, 102) and fibers.place_interval(0, 2, places, 16) == (106, 107)
    with pytest.raises(ValueError, match="more bases"):
        fibers.modification_calls("AC", 0, "A+a,3;", [1], "m6a")
    reads = spark.createDataFrame([("f", 1, "c", 10, 0, "5M", "AACAA", {"MM": "A+a,1,0;", "ML": "10,200"})], "file string, ordinal long, chrom string, start long, flag int, cigar string, seq string, tags map<string,string>")
    assert [(r.pos, r.probability) for r in fibers.modifications(reads, "m6a", 100).collect()] == [(13, 200)]


def plain_greedy(rows, size):
    """Zoom records by a plain loop; rows: (key, start, end, bases, least, most, total, squares) in order."""
    out = []
    for key, start, end, bases, least, most, total, squares in rows:
        if not out or out[-1][0] != key or start >= out[-1][1] + size:
            out.append([key, start, end, bases, least, most, total, squares])
        else:
            r = out[-1]
            out[-1] = [key, r[1], max(r[2], end), r[3] + bases, min(r[4], least), max(r[5], most), r[6] + total, r[7] + squares]
    return out


def test_bigwig_sections_and_zooms(tmp_path):
    g = np.random.default_rng(3)
    pieces, rows = [], []
    for chrom in (0, 1):
        starts = np.cumsum(g.integers(3, 60, 5000))
        ends = starts + g.integers(1, 3, 5000)
        values = g.integers(0, 90, 5000).astype(float)
        pieces += [(chrom, starts[i : i + 700], ends[i : i + 700], values[i : i + 700]) for i in range(0, 5000, 700)]
        rows += [(chrom, int(s), int(e), int(e - s), v, v, (e - s) * v, (e - s) * v * v) for s, e, v in zip(starts, ends, values, strict=True)]
    path, chroms = str(tmp_path / "z.bw"), [("a", 400_000), ("b", 300_000)]
    bigwig.write_file(path, chroms, iter(pieces))
    found = bigwig.read_zooms(path)
    sizes = sorted(found)
    assert sizes[0] == max(10, int(16 * sum(r[3] for r in rows) / len(rows))) and len(sizes) > 3 and all(b == 4 * a for a, b in zip(sizes, sizes[1:], strict=False))
    want = rows
    for size in sizes:
        want = plain_greedy(want, size)
        assert len(found[size]) == len(want) and [tuple(x) for x in found[size].tolist()] == [tuple(np.float32(v) if i > 3 else v for i, v in enumerate(r)) for r in want]
    header = bigwig.Header(path)
    assert header.zooms == len(sizes) and sum(len(x[1]) for x in map(bigwig.decode, blocks_of(path, header))) == len(rows)
    bigwig.write_file(path, chroms, iter([(0, np.arange(5), np.arange(5) + 1, np.ones(5))]), zooms=0)
    assert bigwig.Header(path).zooms == 0


def blocks_of(path, header):
    import zlib

    with open(path, "rb") as f:
        for *_, offset, size in header.blocks:
            f.seek(offset)
            yield zlib.decompress(f.read(size))


def test_section_kinds():
    at, v = np.arange(4) * 10, np.array([1.0, 2, 3, 4])
    ragged = np.array([0, 5, 30, 31])
    for starts, ends, kind in ((at, at + 3, bigwig.FIXED_STEP), (ragged, ragged + 1, bigwig.VARIABLE_STEP), (at, at + np.array([1, 2, 1, 3]), bigwig.BEDGRAPH), (at[:1], at[:1] + 7, bigwig.FIXED_STEP)):
        body = bigwig.encode(2, starts, ends, v[: len(starts)])
        chrom, s, e, got = bigwig.decode(body)
        assert body[20] == kind and chrom == 2 and s.tolist() == starts.tolist() and e.tolist() == ends.tolist() and got.tolist() == v[: len(starts)].tolist()


def test_files_are_not_overwritten(spark, signal, tmp_path):
    path = {0: str(tmp_path / "a.bw")}
    write_bigwigs(signal, AXES, path)
    with pytest.raises(FileExistsError):
        write_bigwigs(signal, AXES, path)
    write_bigwigs(signal, AXES, path, force=True)


def test_mates_wait_for_their_partners(spark):
    """Against a plain loop: repeats, also after the partner, and several pairs of one name."""
    import random

    from basetrack.functions import reads as rf
    from basetrack.operators import counting

    r = random.Random(4)
    rows = [("f", i, f"q{r.randrange(12)}", rf.PAIRED + rf.PROPER + r.choice([rf.FIRST, rf.SECOND]), i, i + 5, r.random() < 0.5) for i in range(120)]
    waiting, want = {}, []
    for _, i, name, flag, *_ in rows:
        first = bool(flag & rf.FIRST)
        if name in waiting and waiting[name][0] != first:
            other = waiting.pop(name)[1]
            want.append((name, i, other) if first else (name, other, i))
        else:
            waiting[name] = (first, i)
    got = counting.mates(spark.createDataFrame(rows, "file string, ordinal long, qname string, flag int, start long, end long, reverse boolean"))
    assert sorted((x.qname, x.a_start, x.b_start) for x in got.collect()) == sorted(want)
    by = {i: (s, e, rev) for _, i, _, _, s, e, rev in rows}
    five = lambda i: by[i][1] - 1 if by[i][2] else by[i][0]
    for which, opposite in (("first", False), ("second", True)):
        out = {(x.a_start, x.b_start): (x.anchor, x.far, x.reverse) for x in counting.mate_anchors(got, which, opposite).collect()}
        near = lambda a, b: (a, b) if which == "first" else (b, a)  # noqa: B023, E731
        assert out == {(a, b): (five(near(a, b)[0]), five(near(a, b)[1]), by[near(a, b)[1 if opposite else 0]][2]) for _, a, b in want}


def test_counts_by_file_and_by_cell(spark):
    from basetrack.operators import counting

    chroms = spark.createDataFrame([("c", 20), ("d", 5)], "chrom string, length long")
    reads = spark.createDataFrame([("x", "c", 3, 9, False), ("x", "c", 3, 8, False), ("x", "c", 25, 30, False), ("y", "d", 1, 9, True), ("y", "z", 1, 2, False)], "file string, chrom string, start long, end long, reverse boolean")
    kept, report = counting.counts_by_file(reads, chroms, factor=3.0, by_depth=True)
    assert [(r.file, r.strand, r.pos, r.n, r.value) for r in kept.collect()] == [("x", "+", 3, 2, 2.0)]
    assert {(r.file, r.chrom): r.lost for r in report.collect()} == {("x", "c"): 1, ("y", "d"): 1}
    rows = [("c", 2, 6, "b", 0), ("c", 2, 9, "a", 1), ("d", 3, 9, "a", 2), ("z", 0, 4, "a", 3), ("c", 5, 6, "b", 4)]
    fragments = spark.createDataFrame(rows, "chrom string, start long, end long, cell string, ordinal long")
    counts, cells, report = counting.counts_by_cell(fragments, chroms)
    assert {(r.cell, r.track_id) for r in cells.collect()} == {("b", 0), ("a", 1)}
    assert {(r.track_id, r.chrom, r.pos): r.n for r in counts.collect()} == {(0, "c", 2): 1, (0, "c", 5): 3, (1, "c", 2): 1, (1, "c", 8): 1, (1, "d", 3): 1}
    assert report.first().asDict() == {"dropped": 1, "skipped": 0, "unknown": 1}
    listed = spark.createDataFrame([("b", 0)], "cell string, track_id long")
    counts, _, report = counting.counts_by_cell(fragments, chroms, listed)
    assert counts.count() == 2 and report.first().skipped == 3
    with pytest.raises(ValueError, match="twice"):
        counting.counts_by_cell(fragments, chroms, listed.unionAll(listed))


def test_fibre_reads_to_tracks(spark):
    from basetrack.operators import fibre

    assert fibers.modification_calls("AATAC", 0, "A-a,0;T-a,0;A+a,1;", [9, 8, 7], "m6a") == [(1, 7), (2, 8)]  # A-a is no 6mA call
    tags = {"MM": "A+a,0,0;C+m,0;", "ML": "200,0,90", "ns": "0,6", "nl": "2,2", "as": "2,8", "al": "3,1", "aq": "0,7"}
    found, stats = fibre.read_spans(100, 0, "10M", "AACCGGTTAC", tags)
    assert found == {"m6a": [(100, 101, 200)], "cpg": [(102, 103, 90)], "nuc": [(100, 102, 1), (106, 108, 1)], "msp": [(102, 105, 1), (108, 109, 1)], "fire": [(108, 109, 7)]}
    assert stats == {"status": 0, "m6a_calls": 2, "m6a_unplaced": 0, "cpg_calls": 1, "cpg_unplaced": 0, "at_bases": 5, "nuc_calls": 2, "msp_calls": 2, "fire_calls": 1}
    other = {"MA": "10;nuc+:1-2,7-2;msp+:3-3,9-1;fire+Q:9-1", "AQ": "7"}
    assert {k: v for k, v in found.items() if k in ("nuc", "msp", "fire")} == fibre.read_spans(100, 0, "10M", "AACCGGTTAC", other)[0]
    assert fibre.read_spans(100, 16, "10M", "AACCGGTTAC", other)[0]["nuc"] == [(102, 104, 1), (108, 110, 1)]
    assert fibre.read_spans(100, 0, "10M", "AACCGGTTAC", tags, ("m6a",), 100)[0] == {"m6a": [(100, 101, 1)]}
    wrong = {"MM": "A+a,9;T+?x;", "ML": ""}
    assert fibre.read_spans(0, 0, "5M", "AACCG", wrong, ("m6a",))[1]["status"] == fibers.PAST_SEQUENCE | fibers.BAD_MM
    assert fibre.read_spans(0, 0, "5M", "AACCG", {"MM": "A+a,0,0;", "ML": "3"}, ("m6a",))[1]["status"] == fibers.SHORT_ML
    assert fibre.read_spans(0, 0, "5M", "AACCG", {"MM": "A+a,0;A+a,0;", "ML": "3,4"}, ("m6a",))[1]["status"] == fibers.DUPLICATE
    assert fibre.read_spans(0, 0, "5M", "*", {"MM": "A+a,0;", "ML": "3"}, ("m6a",))[1]["status"] == fibers.NO_SEQUENCE
    schema_ = "file string, ordinal long, qname string, chrom string, start long, flag int, mapq int, cigar string, seq string, tags map<string,string>"
    rows = [("f", 0, "r", "c", 100, 0, 60, "10M", "AACCGGTTAC", tags), ("f", 1, "r", "c", 104, 0, 60, "10M", "AACCGGTTAC", other), ("f", 2, "s", "c", 0, 4, 0, "*", "A", tags), ("g", 0, "t", "c", 0, 0, 9, "1M", "A", {})]
    reads = fibre.kept(spark.createDataFrame(rows, schema_))
    chroms = spark.createDataFrame([("c", 110)], "chrom string, length long")
    signal, tracks = fibre.signal(reads, chroms)
    assert [r.name for r in tracks.orderBy("track_id").collect()] == [f"{n}.{c}" for n in ("r", "r@c:104") for c in fibre.CHANNELS]
    assert {(r.track_id, r.start, r.end, r.value) for r in signal.collect()} == {(0, 100, 101, 200.0), (1, 102, 103, 90.0), (2, 100, 102, 1.0), (2, 106, 108, 1.0), (3, 102, 105, 1.0), (3, 108, 109, 1.0), (4, 108, 109, 7.0), (7, 104, 106, 1.0), (8, 106, 109, 1.0)}
    assert {(r.ordinal, r.m6a_calls, r.nuc_calls) for r in fibre.statistics(reads).collect()} == {(0, 2, 2), (1, None, 2)}
    assert fibre.bases(fibre.spans(reads)).count() == 4 + 4 + 4 + 1 + 2 + 4 + 1 - 0
    assert fibers.tag_attributes({"HP": "1", "rq": "nan", "ec": "2.5", "RG": "g", "B1": "1,2"}, {"HP": "i", "rq": "f", "ec": "f", "B1": "B"}, ("HP", "RG", "rq", "ec", "B1", "zz")) == {"HP": 1, "RG": "g", "ec": 2.5, "B1": [1, 2]}


def test_command_line(spark, tmp_path, capsys):
    from basetrack import cli

    (tmp_path / "sizes").write_text("chr1\t100\nchr2\t50\n")
    (tmp_path / "a.bed").write_text("chr1\t5\t9\tx\t0\t-\nchr1\t5\t19\tx\t0\t+\nchr2\t48\t52\tx\t0\t-\n")
    out = f"file://{tmp_path}/ds"
    cli.main(["count", str(tmp_path / "a.bed"), "-s", str(tmp_path / "sizes"), "-o", out])
    assert "chr2: 1 entries" in capsys.readouterr().out
    ds = dataset.open_dataset(spark, out)
    assert sorted((r.chrom, r.start, r.track_id) for r in ds.signal.collect()) == [("chr1", 5, 0), ("chr1", 8, 1)]
    cli.main(["info", out])
    assert "signal+" in capsys.readouterr().out
    cli.main(["count", str(tmp_path / "a.bed"), "-s", str(tmp_path / "sizes"), "-o", f"file://{tmp_path}/cov", "--coverage", "--unstranded"])
    assert sorted((r.start, r.end, r.value) for r in dataset.open_dataset(spark, f"file://{tmp_path}/cov").signal.collect()) == [(5, 9, 2.0), (9, 19, 1.0), (48, 50, 1.0)]
    cli.main(["count", str(tmp_path / "a.bed"), "-s", str(tmp_path / "sizes"), "-o", str(tmp_path / "w"), "--bigwig"])
    cli.main(["import", f"{tmp_path}/w.signal+.bw", f"{tmp_path}/w.signal-.bw", "-o", f"file://{tmp_path}/back"])
    assert dataset.open_dataset(spark, f"file://{tmp_path}/back").tracks.count() == 2


def test_converters(spark, signal, tmp_path):
    """Files to tracks one by one, cells, append, selection and the metadata table."""
    from basetrack import cli

    (tmp_path / "sizes").write_text("chr1\t100\nchr2\t50\n")
    (tmp_path / "a.bed").write_text("chr1\t5\t9\tx\t0\t+\nchr1\t5\t19\tx\t0\t+\nchr2\t60\t62\tx\t0\t+\n")
    (tmp_path / "b.bed").write_text("chr2\t7\t9\tx\t0\t+\n")
    (tmp_path / "meta.tsv").write_text("file\tassay\na.bed\tatac\nb.bed\t\n")
    out = f"file://{tmp_path}/files"
    cli.main(["count", str(tmp_path / "a.bed"), str(tmp_path / "b.bed"), "-s", str(tmp_path / "sizes"), "-o", out, "--per-file", "--unstranded", "--metadata", str(tmp_path / "meta.tsv")])
    ds = dataset.open_dataset(spark, out)
    assert [(r["name"], r["attrs"]) for r in ds.tracks.orderBy("track_id").collect()] == [("a+", '{"file": "a.bed", "assay": "atac"}'), ("b+", '{"file": "b.bed"}')]
    assert sorted((r.chrom, r.start, r.track_id, r.value) for r in ds.signal.collect()) == [("chr1", 5, 0, 2.0), ("chr2", 7, 1, 1.0)]
    cli.main(["export", out, "-o", str(tmp_path / "bw"), "--select", "assay=atac"])
    assert [tuple(r) for r in text.read_metadata(spark, f"{tmp_path}/bw/metadata.tsv").collect()] == [("a+.bw", "a+", "atac")]
    with pytest.raises(FileExistsError):
        cli.main(["export", out, "-o", str(tmp_path / "bw"), "-t", "a+"])
    with pytest.raises(ValueError, match="no track"):
        cli.main(["export", out, "-o", str(tmp_path / "bw2"), "-t", "zz"])
    (tmp_path / "bw" / "more.bw").write_bytes((tmp_path / "bw" / "a+.bw").read_bytes())
    cli.main(["import", f"{tmp_path}/bw/more.bw", "-o", out, "--append"])
    more = dataset.open_dataset(spark, out)
    assert more.number == ds.number + 1 and more.tracks.count() == 3 and ds.tracks.count() == 2
    assert sorted((r.chrom, r.start, r.track_id, r.value) for r in more.signal.collect()) == [("chr1", 5, 0, 2.0), ("chr1", 5, 2, 2.0), ("chr2", 7, 1, 1.0)]
    assert [(r.track_id, r["sum"]) for r in more.tile_sums_within("chr1", 0, 9).orderBy("track_id").collect()] == [(0, 2.0), (2, 2.0)] and more.zooms.where("level = 1").count() == 3
    (tmp_path / "f.tsv").write_text("chr1\t5\t9\tBB\nchr1\t5\t7\tAA\nchr2\t8\t99\tBB\n")
    (tmp_path / "cells").write_text("AA\nCC\nBB\n")
    cli.main(["cells", str(tmp_path / "f.tsv"), "-s", str(tmp_path / "sizes"), "-o", f"file://{tmp_path}/cells_out", "--cells", str(tmp_path / "cells")])
    got = dataset.open_dataset(spark, f"file://{tmp_path}/cells_out")
    assert sorted((r.chrom, r.start, r.track_id) for r in got.signal.collect()) == [("chr1", 5, 0), ("chr1", 5, 2), ("chr1", 6, 0), ("chr1", 8, 2), ("chr2", 8, 2)]


def test_writers_at_once_and_loader(spark, signal, tmp_path):
    from basetrack.operators import read

    path = f"file://{tmp_path}/d"
    ds = dataset.write_dataset(spark, path, AXES, ["a", "b"], signal)
    dataset.append_tracks(ds, ["c"], signal.where("track_id = 0"))
    with pytest.raises(OSError, match="another"):
        dataset.append_tracks(ds, ["d"], signal.where("track_id = 0"))
    windows = spark.createDataFrame([(i, AXES[0][0], i, i + 8) for i in range(5)], "window_id long, chrom string, start long, end long")
    channels = spark.createDataFrame([(0, 0), (1, 1)], "channel int, track_id int")
    dense = read.packed(read.read_dense(windows, ds.signal, ds.chroms, channels, 8))
    got = list(read.batches(dense, 2, 8, 2))
    assert [ids for ids, _ in got] == [[0, 1], [2, 3], [4]] and [v.shape for _, v in got] == [(2, 2, 8), (2, 2, 8), (1, 2, 8)]
    want = {(r.window_id, r.channel): r["values"] for r in dense.collect()}
    assert all(np.array_equal(v[k, c], want[i, c], equal_nan=True) for ids, v in got for k, i in enumerate(ids) for c in (0, 1))
    with pytest.raises(ValueError, match="shape|not floats"):
        next(read.batches(dense, 2, 8, 2, np.zeros((1, 2, 8))))


def test_batches_keep_marks(spark, tmp_path):
    from basetrack.streaming import append

    path = f"file://{tmp_path}/s"
    rows = lambda *r: spark.createDataFrame(list(r), "chrom string, start long, end long, track_id int, value double")
    chroms = spark.createDataFrame([("c", 100)], "chrom string, length long")
    append.append_batch(rows(("c", 0, 5, 0, 1.0), ("c", 9, 12, 0, 2.0)), 0, path, chroms, 16)
    append.append_batch(rows(("c", 0, 5, 0, 1.0), ("c", 9, 12, 0, 2.0)), 0, path, chroms, 16)  # again, as after a lost driver
    for bad, what in (((("c", 12, 13, 0, 1.0),), "before"), ((("c", 20, 30, 0, 1.0), ("c", 25, 31, 0, 1.0)), "overlap"), ((("z", 20, 30, 0, 1.0),), "unknown"), ((("c", 90, 101, 0, 1.0),), "unknown")):
        with pytest.raises(ValueError, match=what):
            append.append_batch(rows(*bad), 1, path, chroms, 16)
    append.append_batch(rows(("c", 16, 17, 0, 3.0), ("c", 1, 2, 1, 4.0)), 1, path, chroms, 16)
    assert {r.track_id: (r.total, r.nonzero, r.most) for r in append.statistics(spark, path).collect()} == {0: (14.0, 9, 3.0), 1: (4.0, 1, 4.0)}
    assert spark.read.parquet(f"{path}/signal").count() == 4


def test_fasta_lengths(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nACGT\nAC\n>b\n>c\n" + "ACGTACGTAC\n" * 9000)
    assert_lengths = [("a", 6), ("c", 90_000)]
    with pytest.raises(ValueError):
        text.read_chrom_sizes(spark, str(tmp_path / "x.fa"))  # b is empty
    (tmp_path / "y.fa").write_text(">a one\nACGT\nAC\n>c\n" + "ACGTACGTAC\n" * 9000)
    assert text.read_chrom_sizes(spark, str(tmp_path / "y.fa")) == assert_lengths
