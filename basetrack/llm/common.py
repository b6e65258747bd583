"""Helpers shared by the corpus operators: the shared folder, materialised steps, shipped code."""

from __future__ import annotations

import atexit
import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised kernel takes at once; working arrays are about 40 times this.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch: 10,000 long documents, Spark's own bound, may be gigabytes.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


#: Folders made by this process and not yet removed.
_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors must reach; it goes with ``release`` or at the process's end.

    Where that is unset, a local session (driver and executor in one process, as in tests) sets a folder of its own, and a cluster is refused.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base and not sc._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="basetrack-")
        sc.setCheckpointDir(base)
    if not _folders:
        atexit.register(_forget, sc)
    path = f"{base.rstrip('/')}/basetrack-{uuid.uuid4().hex}"
    _folders.append(path)
    return path


def folders() -> list[str]:
    """The folders that aren't removed yet; those that a call made are the ones added to the list."""
    return list(_folders)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove folders of ``shared_dir``; nothing may read from them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(paths):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in _folders:
            _folders.remove(path)


def _forget(sc) -> None:
    if sc._jsc is not None:
        release(SparkSession(sc), folders())


def unused(names: Iterable[str], *stems: str) -> list[str]:
    """Column names from ``stems`` that none of ``names`` has, whatever their case."""
    have, out = {n.lower() for n in names}, []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in have:
            k += 1
            name = f"{stem}_{k}"
        have.add(name.lower())
        out.append(name)
    return out


def materialise(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a step to the shared folder and go on from there: lineage ends at files that every executor can read."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A hot key has a share of 1 / HOT_KEYS of all rows at least, and HOT_ROWS.
HOT_KEYS, HOT_ROWS = 1024, 256


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, a row for each key, whose ``weight`` is the number of ``rows`` with that key; ``total``: of all rows.

    Keys aren't null.  Rows of hot keys meet them by broadcast, as at most HOT_KEYS keys can be hot, and then go on by the column ``spread``, so that no task gets
    all rows of a key.  Others meet by an ordinary join.  ``rows`` are read once.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    others = [c for c in table.columns if c not in keys]
    value = F.struct(*others)
    hot = table.where(F.col(weight) >= limit).select(*(F.col(k).alias(f"hot_{k}") for k in keys), value.alias("hot_value"))
    # one key of all parts: as a column of its own the spread of the table's side, a constant, would be taken out of the join's keys
    key = lambda parts, away: F.struct(*(x.alias(f"k{i}") for i, x in enumerate(parts)), away.cast("long").alias("spread"))
    cold = table.where(F.col(weight) < limit).select(key(map(F.col, keys), F.lit(0)).alias("cold_key"), value.alias("cold_value"))
    marked = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"hot_{k}") for k in keys], "left")
    away = F.col("hot_value").isNotNull()
    sent = marked.withColumn("sent_key", key((F.when(~away, F.col(k)) for k in keys), F.when(away, F.xxhash64(spread)).otherwise(0)))
    met = sent.join(cold, F.col("sent_key") == F.col("cold_key"), "left")
    out = met.withColumn("got", F.coalesce("hot_value", "cold_value"))
    if how == "inner":
        out = out.where("got is not null")
    return out.select(*rows.columns, *(F.col(f"got.{c}").alias(c) for c in others if c not in rows.columns))


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a session (they need no installed copy), and bound the Arrow batches that they get by bytes."""
    sc = spark.sparkContext
    if sc._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    if getattr(sc, "_basetrack_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="basetrack-code-"), f"basetrack_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._basetrack_shipped = True


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes in ``column`` (one longer row is a slice of its own)."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(np.asarray(pc.fill_null(sizes, 0), dtype=np.int64))
        lo = 0
        while lo < n:
            before = ends[lo - 1] if lo else 0
            hi = max(int(np.searchsorted(ends, before + most, side="right")), lo + 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker is kept for the tasks of later stages, beside theirs."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
