"""The data model: axes (chromosomes), tracks, value types and their rules."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

from pyspark.sql import types as T

LONGEST = 2**32 - 1
EXACT = 2**53
TILE = 16_384
LEAST_TILE, MOST_TILE = 16, 65_536
MOST_TILES = 2**26

CHROMS = T.StructType([T.StructField("chrom_id", T.IntegerType()), T.StructField("chrom", T.StringType()), T.StructField("length", T.LongType()), T.StructField("tile_offset", T.LongType())])
TRACKS = T.StructType([T.StructField("track_id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("dtype", T.StringType()), T.StructField("group_id", T.IntegerType()), T.StructField("attrs", T.StringType())])
SIGNAL = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("track_id", T.IntegerType()), T.StructField("value", T.DoubleType())])

#: Track types with the Spark type that holds them and their range of whole numbers.
DTYPES: dict[str, tuple[T.DataType, int, int]] = {
    "uint8": (T.ShortType(), 0, 2**8 - 1),
    "uint16": (T.IntegerType(), 0, 2**16 - 1),
    "uint32": (T.LongType(), 0, 2**32 - 1),
    "int8": (T.ByteType(), -(2**7), 2**7 - 1),
    "int16": (T.ShortType(), -(2**15), 2**15 - 1),
    "int32": (T.IntegerType(), -(2**31), 2**31 - 1),
    "float32": (T.FloatType(), -(2**24), 2**24),
    "float64": (T.DoubleType(), -EXACT, EXACT),
}


def infer_dtype(least: float | None, most: float | None, fraction: bool) -> str:
    """The narrowest type for values in [least, most]; ``fraction``: some aren't whole (or are NaN)."""
    if fraction:
        return "float32"
    if least is None or most is None:
        return "uint8"
    for name in ("uint8", "uint16", "uint32") if least >= 0 else ("int8", "int16", "int32"):
        _, lo, hi = DTYPES[name]
        if lo <= least and most <= hi:
            return name
    return "float64"


def promote(names: Iterable[str], sums: bool = False) -> str:
    """The type of values read from tracks of several types; of their sums if ``sums``."""
    own = list(dict.fromkeys(names))
    if not own:
        return "float64"
    whole = [n for n in own if not n.startswith("float")]
    if sums:
        return "float64" if whole or "float64" in own else "float32"
    if len(own) == 1:
        return own[0]
    if "float64" in own or ("float32" in own and any(DTYPES[n][2] > 2**16 for n in whole)):
        return "float64"
    if "float32" in own:
        return "float32"
    lo, hi = min(DTYPES[n][1] for n in own), max(DTYPES[n][2] for n in own)
    return next((n for n in ("uint8", "uint16", "uint32", "int8", "int16", "int32") if DTYPES[n][1] <= lo and hi <= DTYPES[n][2]), "float64")


def check_chroms(chroms: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """Ordered (name, length) pairs: at least one, distinct non-empty names, lengths 1 to LONGEST."""
    out, seen = [], set()
    for name, length in chroms:
        if not isinstance(name, str) or not name or "\0" in name:
            raise ValueError(f"not a chromosome name: {name!r}")
        if name in seen:
            raise ValueError(f"chromosome {name} is given twice")
        if isinstance(length, bool) or not isinstance(length, int) or not 1 <= length <= LONGEST:
            raise ValueError(f"chromosome {name}: length {length!r} is not within 1 and {LONGEST}")
        seen.add(name)
        out.append((name, length))
    if not out:
        raise ValueError("no chromosomes")
    return out


def check_tile(tile: int) -> int:
    if not LEAST_TILE <= tile <= MOST_TILE or tile & (tile - 1):
        raise ValueError(f"a tile is a power of two within {LEAST_TILE} and {MOST_TILE}, not {tile}")
    return tile


def check_genome(chroms: Iterable[tuple[str, int]], tile: int) -> None:
    """All chromosomes together have at most MOST_TILES tiles."""
    tiles = sum(-(-length // tile) for _, length in chroms)
    if tiles > MOST_TILES:
        raise ValueError(f"{tiles} tiles of {tile} are more than {MOST_TILES}")


def _finite(value: object) -> bool:
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, dict):
        return all(isinstance(k, str) and _finite(v) for k, v in value.items())
    return all(map(_finite, value)) if isinstance(value, (list, tuple)) else True


def check_tracks(tracks: Iterable[dict | str]) -> list[dict]:
    """Track records with distinct names, a dtype or none, and attributes that JSON can hold; ``group`` is reserved."""
    out, seen = [], set()
    for record in tracks:
        record = {"name": record} if isinstance(record, str) else dict(record)
        name = record.get("name")
        if not isinstance(name, str) or not name:
            raise ValueError(f"a track has no name: {record!r}")
        if name in seen:
            raise ValueError(f"track {name} is given twice")
        if "group" in record:
            raise ValueError(f"track {name}: group is reserved")
        if record.get("dtype") is not None and record["dtype"] not in DTYPES:
            raise ValueError(f"track {name}: {record['dtype']!r} is none of {', '.join(DTYPES)}")
        if not _finite({k: v for k, v in record.items() if k != "dtype"}):
            raise ValueError(f"track {name}: an attribute is not finite")
        json.dumps(record)
        seen.add(name)
        out.append(record)
    return out


def chrom_rows(chroms: Iterable[tuple[str, int]], tile: int = TILE) -> list[tuple[int, str, int, int]]:
    """(chrom_id, chrom, length, first global tile) in the given order."""
    out, offset = [], 0
    for i, (name, length) in enumerate(check_chroms(chroms)):
        out.append((i, name, length, offset))
        offset += -(-length // tile)
    return out
