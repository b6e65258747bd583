"""Text sources: intervals, fragments, SAM, chromosome sizes and metadata tables, by Spark's own readers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basetrack.schema import check_chroms


def _fields(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as white-space fields, with their file and place; blank lines and those beginning with # go."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+$", "")).alias("line"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ordinal"))
    return lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).select("file", "ordinal", F.split("line", r"\s+").alias("f"))


def _whole(field: Column) -> Column:
    """Coordinates may be written as decimals; they are cut towards 0."""
    return field.cast("double").cast("bigint")


def read_intervals(spark: SparkSession, path: str | list[str], strand_column: int | None = None) -> DataFrame:
    """BED-like lines: chrom, start, end, reverse, file, ordinal; a line with fewer than three fields is an error."""
    f = _fields(spark, path)
    ok = F.assert_true(F.size("f") >= 3, F.concat(F.lit("fewer than three fields in "), F.col("file")))
    strand = F.lit(False) if strand_column is None else F.coalesce(F.try_element_at("f", F.lit(strand_column)) == "-", F.lit(False))
    return f.where(ok.isNull()).select(F.col("f")[0].alias("chrom"), _whole(F.col("f")[1]).alias("start"), _whole(F.col("f")[2]).alias("end"), strand.alias("reverse"), "file", "ordinal")


def read_fragments(spark: SparkSession, path: str | list[str], barcode_column: int = 4) -> DataFrame:
    """Fragments with the barcode in a column from the fourth on: chrom, start, end, cell, ordinal."""
    if barcode_column < 4:
        raise ValueError("a barcode's column is the fourth or later")
    f = _fields(spark, path)
    ok = F.assert_true(F.size("f") >= barcode_column, F.concat(F.lit("no barcode in a line of "), F.col("file")))
    return f.where(ok.isNull()).select(F.col("f")[0].alias("chrom"), _whole(F.col("f")[1]).alias("start"), _whole(F.col("f")[2]).alias("end"), F.col("f")[barcode_column - 1].alias("cell"), F.lit(False).alias("reverse"), "ordinal")


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SAM lines: file, ordinal, qname, flag, chrom, start (from 0), mapq, cigar, seq, tags (an array of strings)."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    f = lines.select(F.split("value", "\t").alias("f"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ordinal"))
    return f.select("file", "ordinal", F.col("f")[0].alias("qname"), F.col("f")[1].cast("int").alias("flag"), F.col("f")[2].alias("chrom"), (F.col("f")[3].cast("long") - 1).alias("start"), F.col("f")[4].cast("int").alias("mapq"), F.col("f")[5].alias("cigar"), F.col("f")[9].alias("seq"), F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))).alias("tags"))


def read_chrom_sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(chrom, length) in file order, from two-column sizes, a .fai index or a FASTA file."""
    if path.endswith((".fa", ".fasta", ".fa.gz", ".fasta.gz")):
        lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("i"))
        heads = lines.where(F.col("value").startswith(">")).select(F.split(F.substring("value", 2, 1 << 20), r"\s+")[0].alias("chrom"), "i").orderBy("i").collect()  # the chromosomes
        if not heads:
            return check_chroms([])
        # the name of a line's record is the last head before it: found in ranges of lines, and by the last head of earlier ranges
        head = F.when(F.col("value").startswith(">"), F.col("i"))
        part = F.shiftright("i", 12)
        marked = lines.select("value", "i", head.alias("head"), part.alias("part"))
        last = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        before = marked.groupBy("part").agg(F.max("head").alias("h")).select("part", F.max("h").over(last).alias("before"))  # a row for 4,096 lines
        within = F.max("head").over(Window.partitionBy("part").orderBy("i"))
        owned = marked.join(before, "part").select("value", "head", F.coalesce(within, F.col("before")).alias("of"))
        found = {r["of"]: r["n"] for r in owned.where("head is null").groupBy("of").agg(F.sum(F.length(F.trim("value"))).alias("n")).collect()}
        sizes = {k + 1: found.get(h["i"], 0) for k, h in enumerate(heads)}
        return check_chroms([(h["chrom"], sizes.get(k + 1, 0)) for k, h in enumerate(heads)])
    rows = _fields(spark, path).orderBy("ordinal").collect()  # the chromosomes
    return check_chroms([(r["f"][0], int(float(r["f"][1]))) for r in rows])


def read_metadata(spark: SparkSession, path: str, key: str = "file") -> DataFrame:
    """A table with a header, by commas for .csv and tabs else; empty cells are nulls; the key is unique and never empty."""
    table = spark.read.csv(path, header=True, sep="," if path.endswith(".csv") else "\t", inferSchema=False, mode="FAILFAST")
    table = table.select(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in table.columns))
    if key not in table.columns:
        raise ValueError(f"{path} has no column {key}")
    bad = table.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"{path}: {key} {bad[0][0]!r} is empty or given twice")
    return table


def write_metadata(spark: SparkSession, path: str, rows: list[tuple[str, str, dict]], force: bool = False) -> None:
    """A table of tracks as tab-separated text: file, name and a column for each attribute; rows: (file, name, attributes)."""
    keys = list(dict.fromkeys(k for _, _, a in rows for k in a if k not in ("file", "name")))
    cell = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v)
    table = [(file, name, *(cell(a.get(k)) for k in keys)) for file, name, a in rows]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("file", "name", *keys)])
    spark.createDataFrame(table, schema).coalesce(1).write.mode("overwrite" if force else "errorifexists").csv(path, sep="\t", header=True)


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(cell, track_id) of a list of barcodes, in its order; a barcode that is listed twice is an error."""
    cells = [r[0].split("\t")[0].strip() for r in spark.read.text(path).collect()]  # the cells that a caller lists
    cells = [c for c in cells if c and not c.startswith("#")]
    twice = sorted({c for c in cells if cells.count(c) > 1}) if len(set(cells)) < len(cells) else []
    if twice:
        raise ValueError(f"barcodes listed twice: {', '.join(twice[:5])}")
    return spark.createDataFrame(list(zip(cells, range(len(cells)), strict=True)), "cell string, track_id long")
