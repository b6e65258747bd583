"""Command line: counts and coverage to datasets, datasets to files, reorder, merge and info."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basetrack.functions import reads as rf
from basetrack.operators import counting
from basetrack.sinks.bigwig import write_bigwigs
from basetrack.sources import bam, bigwig, dataset, text


def load_reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """chrom, start, end, reverse (and cigar, file) of mapped reads or intervals."""
    if all(p.endswith((".bam", ".sam")) for p in paths):
        own = bam.read_bam(spark, *paths) if paths[0].endswith(".bam") else text.read_sam(spark, paths)
        mapped = own.where(~rf.has(F.col("flag"), rf.UNMAPPED))
        length = F.greatest(rf.reference_length(F.col("cigar")), F.lit(1))
        return mapped.select("chrom", "start", (F.col("start") + length).alias("end"), rf.has(F.col("flag"), rf.REVERSE).alias("reverse"), "cigar", "file")
    return text.read_intervals(spark, paths, 6).select("chrom", "start", "end", "reverse", F.lit(None).cast("string").alias("cigar"), "file")


def count(spark: SparkSession, a: argparse.Namespace) -> None:
    sizes = text.read_chrom_sizes(spark, a.sizes)
    axes = spark.createDataFrame(dataset.schema.chrom_rows(sizes), dataset.schema.CHROMS)
    reads = load_reads(spark, a.inputs).join(F.broadcast(axes.select("chrom")), "chrom", "left_semi")
    strands = ["+"] if a.unstranded else ["+", "-"]
    if a.per_file:
        if a.coverage or a.bigwig:
            raise ValueError("--per-file is for counts into a dataset")
        counts, report = counting.counts_by_file(reads, axes, a.end, a.plus_shift, a.minus_shift, not a.unstranded, a.scale, a.read_depth)
        for r in report.where("lost > 0").orderBy("file", "chrom").limit(10).collect():
            print(f"{r['file']}, {r['chrom']}: {r['lost']} entries lie outside")
        files = sorted(r[0] for r in reads.select("file").distinct().collect())  # the files that the caller names
        known = _attributes(spark, a.metadata, files)
        names = rf.file_names([rf.plain_stem(f) for f in files])
        records = [{"name": n + s, "file": f.rsplit("/", 1)[-1], **({"strand": s} if len(strands) > 1 else {}), **known.get(f, {})} for n, f in zip(names, files, strict=True) for s in strands]
        place = spark.createDataFrame([(f, s, i * len(strands) + k) for i, f in enumerate(files) for k, s in enumerate(strands)], "file string, of string, track_id int")
        strand = F.lit("+") if a.unstranded else F.col("strand")
        own = counts.withColumn("of", strand).join(F.broadcast(place), ["file", "of"])  # a row a file and strand
        signal = own.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "track_id", "value")
        dataset.write_dataset(spark, a.output, sizes, records, signal, force=a.force)
        return
    if a.coverage:
        blocks = reads.withColumn("b", F.explode(F.when(F.col("cigar").isNull(), F.array(F.struct("start", "end"))).otherwise(rf.aligned_blocks(F.col("start"), F.col("cigar")))))
        own = blocks.select("chrom", F.when(F.col("reverse") & F.lit(not a.unstranded), "-").otherwise("+").alias("strand"), F.col("b.start").alias("start"), F.col("b.end").alias("end"))
        runs = counting.clip_runs(counting.coverage(own, ("chrom", "strand")), axes).select("chrom", "strand", "start", "end", F.col("depth").cast("double").alias("value"))
    else:
        counts = counting.count_positions(reads, a.end, a.plus_shift, a.minus_shift, not a.unstranded)
        for r in counting.discarded(counts, axes).where("lost > 0").orderBy("chrom").limit(10).collect():
            print(f"{r['chrom']}: {r['lost']} entries lie outside")
        kept = counting.scaled(counting.inside(counts, axes), a.scale, a.read_depth)
        runs = kept.select("chrom", *(["strand"] if not a.unstranded else [F.lit("+").alias("strand")]), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    signal = runs.withColumn("track_id", F.when(F.col("strand") == "-", 1).otherwise(0)).drop("strand")
    names = [f"{a.name}{s}" for s in strands]
    if a.bigwig:
        write_bigwigs(signal, sizes, {i: f"{a.output}.{n}.bw" for i, n in enumerate(names)}, force=a.force)
    else:
        dataset.write_dataset(spark, a.output, sizes, names, signal, force=a.force)


def _attributes(spark: SparkSession, path: str | None, files: list[str]) -> dict[str, dict]:
    """{file: attributes} from a metadata table; empty cells are no attributes."""
    if path is None:
        return {}
    from basetrack.operators import catalog

    rows = catalog.read_attributes(text.read_metadata(spark, path), spark.createDataFrame([(f,) for f in files], "path string"))
    return {r["path"]: {k: v for k, v in r.asDict().items() if k not in ("path", "name") and v is not None} for r in rows.collect()}  # a row a file


def cells(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fragments with barcodes to a track a cell."""
    sizes = text.read_chrom_sizes(spark, a.sizes)
    axes = spark.createDataFrame(dataset.schema.chrom_rows(sizes), dataset.schema.CHROMS)
    listed = text.read_barcodes(spark, a.cells) if a.cells else None
    counts, table, report = counting.counts_by_cell(text.read_fragments(spark, a.inputs, a.barcode_column), axes, listed)
    names = [r["cell"] for r in table.orderBy("track_id").collect()]  # a name a track
    signal = counts.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col("track_id").cast("int").alias("track_id"), F.col("n").cast("double").alias("value"))
    dataset.write_dataset(spark, a.output, sizes, names, signal, force=a.force)
    r = report.first()
    print(f"{r['dropped']} ends lie outside, {r['skipped']} fragments are of cells that aren't listed, {r['unknown']} of unknown chromosomes")


def fibres(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fibre reads of BAM files to a track a read and channel."""
    from basetrack.operators import fibre

    sizes = text.read_chrom_sizes(spark, a.sizes)
    axes = spark.createDataFrame(dataset.schema.chrom_rows(sizes), dataset.schema.CHROMS)
    channels = tuple(a.channels.split(","))
    unknown = set(channels) - set(fibre.CHANNELS)
    if unknown:
        raise ValueError(f"no channel {', '.join(sorted(unknown))}")
    reads = bam.read_bam(spark, *a.inputs)
    for r in counting.skip_reasons(reads, a.min_mapq, a.primary_only, fibre.has_tags(channels)).where("reason is not null").orderBy("reason").collect():
        print(f"{r['n']} reads skipped: {r['reason']}")
    kept = fibre.kept(reads, a.min_mapq, a.primary_only, channels)
    signal, table = fibre.signal(kept, axes, channels, a.threshold)
    stats = {(r["file"], r["ordinal"]): {k: v for k, v in r.asDict().items() if k not in ("file", "ordinal") and v is not None} for r in fibre.statistics(kept, channels).collect()}
    rows = table.orderBy("track_id").collect()  # a record a track, as any dataset has
    records = [{"name": r["name"], "dtype": "uint8", "channel": r["channel"], **stats[r["file"], r["ordinal"]]} for r in rows]
    dataset.write_dataset(spark, a.output, sizes, records, signal.withColumn("track_id", F.col("track_id").cast("int")), groups=len(channels), force=a.force)


def chosen(ds: dataset.Dataset, names: str | None, select: list[str] | None) -> list:
    """The track rows that ``-t`` names or ``--select`` matches, or all."""
    if names and select:
        raise ValueError("give -t or --select, not both")
    rows = ds.tracks.orderBy("track_id")
    if names:
        by_name = {r["name"]: r for r in rows.collect()}
        lost = [n for n in names.split(",") if n not in by_name]
        if lost:
            raise ValueError(f"no track {', '.join(lost)}")
        return [by_name[n] for n in names.split(",")]
    if select:
        pairs = [x.partition("=") for x in select]
        if any(not sep for _, sep, _ in pairs):
            raise ValueError("--select takes KEY=VALUE")
        found = ds.select(**{k: v for k, _, v in pairs}).orderBy("track_id").collect()
        if not found:
            raise ValueError(f"no track has {' '.join(select)}")
        return found
    return rows.collect()


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tracks to bigWig files, with a table of their attributes beside them."""
    ds = dataset.open_dataset(spark, a.input)
    sizes = [(r["chrom"], r["length"]) for r in ds.chroms.orderBy("chrom_id").collect()]
    tracks = chosen(ds, a.tracks, a.select)
    files = rf.file_names([r["name"] for r in tracks])
    noted = ds.meta.get("missing")
    missing = a.missing if a.missing is not None else float(noted) if noted not in (None, "", "None") else 0.0
    write_bigwigs(ds.signal, sizes, {r["track_id"]: f"{a.output}/{f}.bw" for r, f in zip(tracks, files, strict=True)}, missing, a.zooms, a.force)
    rows = [(f"{f}.bw", r["name"], json.loads(r["attrs"])) for r, f in zip(tracks, files, strict=True)]
    text.write_metadata(spark, f"{a.output}/metadata.tsv", rows, a.force)


def load(spark: SparkSession, a: argparse.Namespace) -> None:
    """bigWig files to a dataset, or to further tracks of one."""
    sizes: dict[str, int] = {}
    for path in a.inputs:
        for chrom, length in bigwig.chrom_sizes(path):
            if sizes.setdefault(chrom, length) != length:
                raise ValueError(f"{path}: chromosome {chrom} has another length")
    signal = None
    for k, path in enumerate(a.inputs):
        own = bigwig.read_bigwig(spark, path).withColumn("track_id", F.lit(k))
        signal = own if signal is None else signal.unionByName(own)
    known = _attributes(spark, a.metadata, a.inputs)
    records = [{"name": n, "dtype": "float32", **known.get(f, {})} for n, f in zip((path.rsplit("/", 1)[-1].rsplit(".", 1)[0] for path in a.inputs), a.inputs, strict=True)]
    if a.append:
        ds = dataset.open_dataset(spark, a.output)
        have = {r["chrom"]: r["length"] for r in ds.chroms.collect()}
        other = sorted(c for c, n in sizes.items() if have.get(c) != n)
        if other:
            raise ValueError(f"{a.output} has no such chromosome: {', '.join(other[:5])}")
        dataset.append_tracks(ds, records, signal)
    else:
        dataset.write_dataset(spark, a.output, list(sizes.items()), records, signal, force=a.force, missing=a.missing)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="basetrack")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("count", help="reads or intervals to tracks")
    c.add_argument("inputs", nargs="+")
    c.add_argument("-s", "--sizes", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--name", default="signal")
    c.add_argument("--end", choices=("five", "three", "both"), default="five")
    c.add_argument("-ps", "--plus-shift", type=int, default=0)
    c.add_argument("-ns", "--minus-shift", type=int, default=0)
    c.add_argument("-sf", "--scale", type=float, default=1.0)
    c.add_argument("--metadata")
    for flag in ("--unstranded", "--coverage", "--read-depth", "--bigwig", "--per-file", "--force"):
        c.add_argument(flag, action="store_true")
    e = sub.add_parser("cells", help="fragments with barcodes to a track a cell")
    f = sub.add_parser("fibres", help="fibre reads to a track a read and channel")
    for q in (e, f):
        q.add_argument("inputs", nargs="+")
        q.add_argument("-s", "--sizes", required=True)
        q.add_argument("-o", "--output", required=True)
        q.add_argument("--force", action="store_true")
    e.add_argument("--barcode-column", type=int, default=4)
    e.add_argument("--cells")
    f.add_argument("--channels", default="m6a,cpg,nuc,msp,fire")
    f.add_argument("--threshold", type=int)
    f.add_argument("--min-mapq", type=int, default=0)
    f.add_argument("--primary-only", action="store_true")
    w = sub.add_parser("export", help="tracks to bigWig files")
    w.add_argument("input")
    w.add_argument("-o", "--output", required=True)
    w.add_argument("-t", "--tracks")
    w.add_argument("--select", nargs="+")
    w.add_argument("--missing", type=float)
    w.add_argument("-z", "--zooms", type=int, default=bigwig.MOST_ZOOMS)
    w.add_argument("--force", action="store_true")
    i = sub.add_parser("import", help="bigWig files to a dataset")
    i.add_argument("inputs", nargs="+")
    i.add_argument("-o", "--output", required=True)
    i.add_argument("--metadata")
    i.add_argument("--missing", type=float)
    i.add_argument("--append", action="store_true")
    i.add_argument("--force", action="store_true")
    r = sub.add_parser("reorder")
    r.add_argument("input")
    r.add_argument("output")
    r.add_argument("--order", choices=("positions", "tracks"), required=True)
    m = sub.add_parser("merge")
    m.add_argument("inputs", nargs="+")
    m.add_argument("-o", "--output", required=True)
    n = sub.add_parser("info")
    n.add_argument("input")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("basetrack").getOrCreate()
    if a.command == "count":
        count(spark, a)
    elif a.command == "cells":
        cells(spark, a)
    elif a.command == "fibres":
        fibres(spark, a)
    elif a.command == "export":
        export(spark, a)
    elif a.command == "import":
        load(spark, a)
    elif a.command == "reorder":
        dataset.reorder(dataset.open_dataset(spark, a.input), a.output, a.order)
    elif a.command == "merge":
        dataset.merge(a.output, *(dataset.open_dataset(spark, x) for x in a.inputs))
    else:
        info = dataset.open_dataset(spark, a.input).info().orderBy("track_id")
        print("\t".join(info.columns))
        for r in info.toLocalIterator():
            print("\t".join(rf.printable(str(v)) for v in r))


if __name__ == "__main__":
    main()
