"""Tracks to bigWig files: one task writes one file from its sorted rows, as they come."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basetrack.sources.bigwig import MOST_ZOOMS, write_file

Piece = tuple[int, int, np.ndarray, np.ndarray, np.ndarray]


def write_bigwigs(signal: DataFrame, chroms: list[tuple[str, int]], paths: dict[int, str], missing: float = 0.0, zooms: int = MOST_ZOOMS, force: bool = False) -> list[str]:
    """A file for each track of ``paths`` (on storage that all executors share); values equal to ``missing`` and NaN are left out.

    Files that exist are refused unless ``force``.
    """
    there = sorted(p for p in paths.values() if os.path.exists(p.removeprefix("file://")))
    if there and not force:
        raise FileExistsError(", ".join(there[:5]))
    number = {name: i for i, (name, _) in enumerate(chroms)}
    drop = F.isnan("value") if np.isnan(missing) else F.isnan("value") | (F.col("value") == missing)
    mapped = signal.where(F.col("track_id").isin(list(paths)) & ~drop)
    order = F.element_at(F.create_map(*(x for k, i in number.items() for x in (F.lit(k), F.lit(i)))), F.col("chrom")).alias("chrom_id")

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition's tracks one after another; their rows come sorted, and a batch is in memory."""

        def pieces() -> Iterator[Piece]:
            for b in batches:
                for (track, chrom), own in b.groupby(["track_id", "chrom_id"], sort=False):
                    yield int(track), int(chrom), *(own[c].to_numpy() for c in ("start", "end", "value"))

        for track, own in itertools.groupby(pieces(), key=lambda p: p[0]):
            write_file(paths[track].removeprefix("file://"), chroms, (p[1:] for p in own), zooms=zooms)
            yield pd.DataFrame({"path": [paths[track]]})

    rows = mapped.select("track_id", order, "start", "end", "value")
    written = rows.repartition("track_id").sortWithinPartitions("track_id", "chrom_id", "start").mapInPandas(files, "path string")
    return sorted(r["path"] for r in written.collect())
