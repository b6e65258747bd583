"""A dataset: tracks over axes as Parquet tables, published by numbered snapshots.

A snapshot is a small file that names the folders (parts) of its tables; the newest number counts.  Each write or append makes a new
part and a new snapshot and leaves older ones to their readers; nothing that a reader may hold is deleted or changed.  A part has ``signal``,
sorted by position or by track, and with it ``tile_sums`` (by chromosome, sorted by tile, so that windows read few row groups),
``zooms`` and ``stats``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basetrack import schema, validate
from basetrack.operators import catalog, summary

SNAPSHOTS = "snapshots"
#: Zoom levels that are stored, each over four times the tiles of the one before.
ZOOM_LEVELS = 6


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/{SNAPSHOTS}")
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _publish(spark: SparkSession, path: str, after: int, text: str) -> None:
    """The snapshot after number ``after``, by one rename; raises if another writer was first."""
    fs, p = _fs(spark, f"{path}/{SNAPSHOTS}/{after + 1:010d}.json")
    draft = p.suffix("." + uuid.uuid4().hex)
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p) or not fs.rename(draft, p):
        fs.delete(draft, False)
        raise OSError(f"{path} was written by another at the same time")


def is_dataset(spark: SparkSession, path: str) -> bool:
    return bool(_numbers(spark, path))


@dataclass(frozen=True)
class Dataset:
    spark: SparkSession
    path: str
    number: int
    meta: dict

    @property
    def parts(self) -> list[str]:
        return [f"{self.path}/{x}" for x in self.meta["parts"]]

    def _table(self, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{x}/{name}") for x in self.parts))

    @property
    def signal(self) -> DataFrame:
        return self._table("signal")

    @property
    def chroms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.parts[0]}/chroms")

    @property
    def tracks(self) -> DataFrame:
        return self._table("tracks")

    @property
    def tile_sums(self) -> DataFrame:
        return self._table("tile_sums")

    @property
    def zooms(self) -> DataFrame:
        return self._table("zooms")

    def tile_sums_within(self, chrom: str, start: int, end: int) -> DataFrame:
        """Tile sums of the tiles that [start, end) touches: one folder a part, and of it the row groups with such tiles."""
        tile = self.meta["tile"]
        return self.tile_sums.where((F.col("chrom") == chrom) & F.col("tile").between(start // tile, (end - 1) // tile))

    @property
    def stats(self) -> DataFrame:
        return self._table("stats")

    def select(self, **attributes: object) -> DataFrame:
        return catalog.select(self.tracks, **attributes)

    def info(self) -> DataFrame:
        """A row a track: name, type, group, attributes and statistics."""
        return self.tracks.join(self.stats, "track_id", "left").na.fill(0, ["total", "nonzero", "least", "most"])


def open_dataset(spark: SparkSession, path: str) -> Dataset:
    """The current snapshot; it stays what it is while newer ones are published."""
    if not is_dataset(spark, path):
        raise ValueError(f"{path} is not a dataset")
    number = _numbers(spark, path)[-1]
    text = spark.read.text(f"{path}/{SNAPSHOTS}/{number:010d}.json", wholetext=True).first()[0]
    return Dataset(spark, path, number, json.loads(text))


def sparse_signal(entries: DataFrame) -> DataFrame:
    """Entries (chrom, pos, track_id, value) as a signal of single bases."""
    return entries.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "track_id", "value")


def write_dataset(spark: SparkSession, path: str, chroms: list[tuple[str, int]], tracks: list[dict | str], signal: DataFrame, tile: int = schema.TILE, order: str = "positions", groups: int = 8, genome: str | None = None, force: bool = False, compression: str = "zstd", missing: float | None = None) -> Dataset:
    """Checks everything, then writes a snapshot; a call that raises publishes nothing.

    ``missing`` notes how bases without an interval were read, for those who write interval files from the dataset.
    """
    schema.check_tile(tile)
    schema.check_genome(chroms, tile)
    numbers = _numbers(spark, path)
    if numbers and not force:
        raise FileExistsError(path)
    meta = {"tile": tile, "order": order, "groups": groups, "genome": genome, "compression": compression, "missing": None if missing is None else str(missing)}
    part = _write_part(spark, path, schema.chrom_rows(chroms, tile), schema.check_tracks(tracks), signal, meta, 0)
    _publish(spark, path, numbers[-1] if numbers else 0, json.dumps({**meta, "parts": [part]}))
    return open_dataset(spark, path)


def _write_part(spark: SparkSession, path: str, rows: list[tuple], records: list[dict], signal: DataFrame, meta: dict, first: int) -> str:
    """Tables of tracks numbered from ``first``, checked; ``signal`` numbers them from 0."""
    c = spark.createDataFrame(rows, schema.CHROMS)
    clean = validate.signal(signal, c, len(records))
    name = uuid.uuid4().hex
    folder = f"{path}/{name}"
    moved = clean.withColumn("track_id", (F.col("track_id") + first).cast("int"))
    keep = {"compression": meta["compression"]}
    catalog.reordered(moved, meta["order"]).write.options(**keep).partitionBy("chrom").parquet(f"{folder}/signal")
    stored = spark.read.schema(moved.schema).parquet(f"{folder}/signal")
    inferred = {r["track_id"]: r["dtype"] for r in summary.infer_dtypes(stored).collect()}  # a row a track
    table = [(i, r["name"], r.get("dtype") or inferred.get(i, "uint8"), i // meta["groups"], json.dumps({k: v for k, v in r.items() if k not in ("name", "dtype")}, ensure_ascii=False)) for i, r in enumerate(records, first)]
    t = spark.createDataFrame(table, schema.TRACKS)
    bad = summary.out_of_range(stored, t).limit(1).collect()
    if bad:
        raise ValueError(f"track {records[bad[0]['track_id'] - first]['name']}: values from {bad[0]['lo']} to {bad[0]['hi']} aren't {bad[0]['dtype']}")
    c.coalesce(1).write.parquet(f"{folder}/chroms")
    t.coalesce(1).write.parquet(f"{folder}/tracks")
    sums = summary.tile_sums(stored, meta["tile"])
    sums.repartitionByRange("chrom", "tile").sortWithinPartitions("chrom", "tile", "track_id").write.options(**keep).partitionBy("chrom").parquet(f"{folder}/tile_sums")
    written = spark.read.schema(sums.schema).parquet(f"{folder}/tile_sums")
    summary.zooms(written, ZOOM_LEVELS).write.options(**keep).parquet(f"{folder}/zooms")
    summary.track_stats(stored).write.parquet(f"{folder}/stats")
    return name


def _records(ds: Dataset) -> list[dict]:
    return [{"name": r["name"], "dtype": r["dtype"], **json.loads(r["attrs"])} for r in ds.tracks.orderBy("track_id").collect()]


def append_tracks(ds: Dataset, tracks: list[dict | str], signal: DataFrame) -> Dataset:
    """A new snapshot with further tracks; ``signal`` numbers them from 0.  The tracks that are there aren't read or written again."""
    old, new = _records(ds), schema.check_tracks(tracks)
    schema.check_tracks([*old, *new])  # names stay distinct
    rows = [tuple(r) for r in ds.chroms.orderBy("chrom_id").collect()]
    part = _write_part(ds.spark, ds.path, rows, new, signal, ds.meta, len(old))
    _publish(ds.spark, ds.path, ds.number, json.dumps({**ds.meta, "parts": [*ds.meta["parts"], part]}))
    return open_dataset(ds.spark, ds.path)


def merge(path: str, *parts: Dataset, force: bool = False) -> Dataset:
    """The tracks of several datasets with one set of axes, tile and order."""
    first = parts[0]
    axes = [(r["chrom"], r["length"]) for r in first.chroms.orderBy("chrom_id").collect()]
    for p in parts[1:]:
        if [(r["chrom"], r["length"]) for r in p.chroms.orderBy("chrom_id").collect()] != axes or any(p.meta[k] != first.meta[k] for k in ("tile", "order", "genome")):
            raise ValueError(f"{p.path} differs from {first.path} in its axes, tile, order or genome")
    catalog.check_names([p.tracks for p in parts])
    records = [_records(p) for p in parts]
    both = catalog.union_signals([p.signal.select("chrom", "start", "end", "track_id", "value") for p in parts], [len(r) for r in records])
    return write_dataset(first.spark, path, axes, [x for r in records for x in r], both, first.meta["tile"], first.meta["order"], first.meta["groups"], first.meta["genome"], force)


def reorder(ds: Dataset, path: str, order: str, force: bool = False) -> Dataset:
    axes = [(r["chrom"], r["length"]) for r in ds.chroms.orderBy("chrom_id").collect()]
    return write_dataset(ds.spark, path, axes, _records(ds), ds.signal, ds.meta["tile"], order, ds.meta["groups"], ds.meta["genome"], force)


