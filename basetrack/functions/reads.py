"""Column functions over reads: positions by strand, CIGAR lengths, blocks, mates, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REVERSE, UNMAPPED, SECONDARY, SUPPLEMENTARY, PAIRED, PROPER, FIRST, SECOND = 16, 4, 256, 2048, 1, 2, 64, 128


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def five_prime(start: Column, end: Column, reverse: Column, plus: int = 0, minus: int = 0) -> Column:
    """The base that a read begins at, shifted by its strand."""
    return F.when(reverse, end - 1 + minus).otherwise(start + plus)


def three_prime(start: Column, end: Column, reverse: Column, plus: int = 0, minus: int = 0) -> Column:
    """The base that a read ends at, shifted by its strand."""
    return F.when(reverse, start + plus).otherwise(end - 1 + minus)


def both_ends(start: Column, end: Column, plus: int = 0, minus: int = 0) -> Column:
    """An array of a fragment's two ends."""
    return F.array(start + plus, end - 1 + minus)


def reference_length(cigar: Column) -> Column:
    """Bases of the reference under a CIGAR string: M, D, N, = and X."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def aligned_blocks(start: Column, cigar: Column) -> Column:
    """Array of (start, end) of aligned bases; M, = and X go together, D and N part blocks."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1)
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    first = F.struct(start.cast("long").alias("at"), start.cast("long").alias("open"), empty.alias("done"))

    def step(s: Column, op: Column) -> Column:
        n, kind = F.regexp_extract(op, r"^(\d+)", 1).cast("long"), F.substring(op, -1, 1)
        moves, parts = kind.isin("M", "=", "X"), kind.isin("D", "N")
        done = F.when(parts & (s["at"] > s["open"]), F.array_append(s["done"], F.struct(s["open"].alias("start"), s["at"].alias("end")))).otherwise(s["done"])
        at = F.when(moves | parts, s["at"] + n).otherwise(s["at"])
        return F.struct(at.alias("at"), F.when(parts, at).otherwise(s["open"]).alias("open"), done.alias("done"))

    return F.aggregate(ops, first, step, lambda s: F.when(s["at"] > s["open"], F.array_append(s["done"], F.struct(s["open"].alias("start"), s["at"].alias("end")))).otherwise(s["done"]))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """A file's name without folders and known extensions."""
    return F.regexp_replace(base_name(path), r"(?i)\.(bam|sam|bed|tsv|txt|bw|bigwig|bigWig)(\.gz)?$", "")


def plain_stem(path: str) -> str:
    """As ``stem``, of one path."""
    return re.sub(r"(?i)\.(bam|sam|bed|tsv|txt|bw|bigwig)(\.gz)?$", "", path.rsplit("/", 1)[-1])


def file_names(names: list[str]) -> list[str]:
    """Names of tracks as names of files: no path separators, and the place of a track appended to a name that is taken."""
    out: list[str] = []
    for i, name in enumerate(names):
        plain = name.replace("/", "_").replace("\\", "_")
        out.append(plain if plain not in out else f"{plain}.{i}")
    return out


def printable(text: str) -> str:
    """Control characters as escapes, for print."""
    return "".join(c if c.isprintable() else c.encode("unicode_escape").decode() for c in text)


def pair_index(i: Column, j: Column, first_i: int, first_j: int, n: int) -> Column:
    """A cell of a window of a contact matrix as one number."""
    return (i - first_i) * n + (j - first_j)
