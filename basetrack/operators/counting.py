"""Reads to tracks: position counts, coverage, pooling, clipping, depth scaling, cells and mates.

Reads have chrom, start, end (half-open) and reverse; counting is one hash aggregate with map-side partial sums, so a position with
very many reads costs one row a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basetrack.functions.reads import both_ends, five_prime, three_prime

STRAND = "strand"


def count_positions(reads: DataFrame, end: str = "five", plus: int = 0, minus: int = 0, stranded: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """(chrom, [strand], keys, pos, n): reads by the position of an end: five, three or both."""
    start, stop, reverse = F.col("start"), F.col("end"), F.col("reverse")
    if end == "both":
        placed = reads.withColumn("pos", F.explode(both_ends(start, stop, plus, minus)))
    elif end in ("five", "three"):
        placed = reads.withColumn("pos", (five_prime if end == "five" else three_prime)(start, stop, reverse, plus, minus))
    else:
        raise ValueError(f"an end is five, three or both, not {end!r}")
    by = ["chrom", *([STRAND] if stranded else []), *keys, "pos"]
    return placed.withColumn(STRAND, F.when(reverse, "-").otherwise("+")).groupBy(*by).agg(F.count("*").alias("n"))


def pool(*counts: DataFrame) -> DataFrame:
    """Counts of several files as one: sums by all columns but n."""
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out.groupBy(*(c for c in out.columns if c != "n")).agg(F.sum("n").alias("n"))


def inside(counts: DataFrame, chroms: DataFrame) -> DataFrame:
    """Counts within [0, length) of known chromosomes."""
    return counts.join(chroms.select("chrom", "length"), "chrom").where((F.col("pos") >= 0) & (F.col("pos") < F.col("length"))).drop("length")


def discarded(counts: DataFrame, chroms: DataFrame) -> DataFrame:
    """(chrom, lost) for each known chromosome: entries whose position lies outside it."""
    out = (F.col("pos") < 0) | (F.col("pos") >= F.col("length"))
    return counts.join(chroms.select("chrom", "length"), "chrom").groupBy("chrom").agg(F.sum(F.when(out, F.col("n")).otherwise(0)).alias("lost"))


def scaled(counts: DataFrame, factor: float = 1.0, by_depth: bool = False) -> DataFrame:
    """Values n * factor, divided by all entries if ``by_depth``; the depth is one row."""
    if not by_depth:
        return counts.withColumn("value", F.col("n") * F.lit(float(factor)))
    depth = counts.agg(F.sum("n").cast("double").alias("_depth"))
    return counts.join(F.broadcast(depth)).withColumn("value", F.col("n") * F.lit(float(factor)) / F.col("_depth")).drop("_depth")


def coverage(intervals: DataFrame, keys: Sequence[str] = ("chrom",), region: int = 1 << 20) -> DataFrame:
    """Depth runs (keys, start, end, depth) with depth over 0, equal neighbours joined.

    A chromosome is not one task: intervals are cut at the edges of fixed regions, each region is swept by itself, and only runs
    that touch a region's edge are joined with their neighbours.
    """
    keys = list(keys)
    some = intervals.where(F.col("end") > F.col("start"))
    cut = some.withColumn("_region", F.explode(F.sequence(F.floor(F.col("start") / region), F.floor((F.col("end") - 1) / region))))
    cut = cut.withColumns({"start": F.greatest("start", F.col("_region") * region), "end": F.least("end", (F.col("_region") + 1) * region)})
    events = cut.select(*keys, "_region", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy(*keys, "_region", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    w = Window.partitionBy(*keys, "_region").orderBy("pos")
    depth = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = steps.select(*keys, "_region", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), depth.alias("depth")).where("depth <> 0")
    at_edge = (F.col("start") % region == 0) | (F.col("end") % region == 0)
    within = runs.where(~at_edge).select(*keys, "start", "end", "depth")
    e = Window.partitionBy(*keys).orderBy("start")
    edge = runs.where(at_edge).select(*keys, "start", "end", "depth")
    fresh = (F.lag("end").over(e).isNull() | (F.lag("end").over(e) != F.col("start")) | (F.lag("depth").over(e) != F.col("depth"))).cast("long")
    joined = edge.withColumn("_fresh", fresh).withColumn("_i", F.sum("_fresh").over(e.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("depth").alias("depth")).drop("_i")
    return within.unionByName(joined)


def clip_runs(runs: DataFrame, chroms: DataFrame) -> DataFrame:
    """Runs cut to their chromosomes."""
    known = runs.join(chroms.select("chrom", "length"), "chrom")
    return known.withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", "length")}).where("end > start").drop("length")


def cells_first_seen(fragments: DataFrame, cell: str = "cell", ordinal: str = "ordinal") -> DataFrame:
    """(cell, track_id): cells in the order of their first fragment.

    The rank is over distinct cells, after a map-side minimum; ranges of first ordinals are ranked apart and joined by counts.
    """
    first = fragments.groupBy(cell).agg(F.min(ordinal).alias("_first"))
    return ranked(first, "_first", "track_id").drop("_first")


def ranked(rows: DataFrame, order: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Rank from 0 by a distinct whole-number column, without one task for all rows: ranks within ranges, plus the rows of ranges before."""
    part = F.floor(F.col(order) / width)
    own = rows.withColumn("_part", part)
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return own.join(before, "_part").withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1).drop("_part", "_before")


def mates(reads: DataFrame) -> DataFrame:
    """Proper pairs: (file, qname, first read's columns as a_*, second's as b_*), in the order of the file.

    Reads have file, qname, ordinal and flag.  A read waits until its partner comes; a repeat of the waiting mate takes its place; after
    a pair nothing waits, so one name may give several pairs.  The rows of one name are few, and are gone through in order.
    """
    from basetrack.functions.reads import FIRST, PROPER, SECOND, SECONDARY, SUPPLEMENTARY, UNMAPPED, has

    flag, others = F.col("flag"), [c for c in reads.columns if c not in ("file", "qname")]
    own = reads.where(~has(flag, UNMAPPED) & ~has(flag, SECONDARY) & ~has(flag, SUPPLEMENTARY) & has(flag, PROPER)).where(has(flag, FIRST) | has(flag, SECOND))
    row = F.struct("ordinal", has(flag, FIRST).alias("first"), F.struct(*others).alias("read"))
    named = own.groupBy("file", "qname").agg(F.array_sort(F.collect_list(row)).alias("rows")).where(F.size("rows") > 1)
    kind = named.schema["rows"].dataType.elementType
    none, pairs = F.lit(None).cast(kind), F.array().cast(T.ArrayType(T.StructType([T.StructField("a", kind), T.StructField("b", kind)])))

    def step(state: Column, now: Column) -> Column:
        waits, done = state["waits"], state["done"]
        meets = waits.isNotNull() & (waits["first"] != now["first"])
        pair = F.struct(F.when(now["first"], now).otherwise(waits).alias("a"), F.when(now["first"], waits).otherwise(now).alias("b"))
        return F.struct(F.when(~meets, now).alias("waits"), F.when(meets, F.array_append(done, pair)).otherwise(done).alias("done"))

    found = F.aggregate("rows", F.struct(none.alias("waits"), pairs.alias("done")), step, lambda state: state["done"])
    each = named.select("file", "qname", F.explode(found).alias("p"))
    return each.select("file", "qname", *(F.col(f"p.{side}.read.{c}").alias(f"{side}_{c}") for side in "ab" for c in others))


def mate_anchors(pairs: DataFrame, five_is: str = "first", opposite_strand: bool = False) -> DataFrame:
    """Adds anchor (the 5' end of the mate that holds the molecule's 5' end), far (the other mate's 5' end) and reverse.

    pairs: as ``mates`` gives them, with start, end and reverse of both reads; ``five_is``: first or second.
    """
    if five_is not in ("first", "second"):
        raise ValueError(f"the 5' end is in the first or second read, not {five_is!r}")
    near, far = ("a", "b") if five_is == "first" else ("b", "a")
    end = lambda side: five_prime(F.col(f"{side}_start"), F.col(f"{side}_end"), F.col(f"{side}_reverse"))
    return pairs.withColumns({"anchor": end(near), "far": end(far), "reverse": F.col(f"{far if opposite_strand else near}_reverse")})


def counts_by_file(reads: DataFrame, chroms: DataFrame, end: str = "five", plus: int = 0, minus: int = 0, stranded: bool = True, factor: float = 1.0, by_depth: bool = False) -> tuple[DataFrame, DataFrame]:
    """(counts, report) of each file by itself: counts within the chromosomes with ``value``, and (file, chrom, lost) of the others.

    Depth is all entries of the file.
    """
    counted = count_positions(reads, end, plus, minus, stranded, keys=("file",))
    depth = counted.groupBy("file").agg(F.sum("n").cast("double").alias("depth"))
    value = F.col("n") * F.lit(float(factor)) / (F.col("depth") if by_depth else F.lit(1.0))
    known = counted.join(chroms.select("chrom", "length"), "chrom").withColumn("inside", (F.col("pos") >= 0) & (F.col("pos") < F.col("length")))
    kept = known.where("inside").join(depth, "file").withColumn("value", value).drop("inside", "length", "depth")
    report = known.groupBy("file", "chrom").agg(F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("lost"))
    return kept, report


def counts_by_cell(fragments: DataFrame, chroms: DataFrame, barcodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, cells, report): both ends of each cell's fragments; fragments have chrom, start, end, cell and ordinal.

    ``barcodes`` (cell, track_id) names the cells and their order, else they come by their first fragment.  The report has one row: ends outside
    their chromosome are dropped, fragments of cells that aren't listed are skipped, and those of unknown chromosomes are unknown.
    """
    cells = cells_first_seen(fragments) if barcodes is None else barcodes
    if barcodes is not None and not barcodes.groupBy("cell").count().where("count > 1").isEmpty():
        raise ValueError("a barcode is listed twice")
    marked = fragments.join(cells.select(F.col("cell").alias("listed"), "track_id"), F.col("cell") == F.col("listed"), "left").join(chroms.select("chrom", "length"), "chrom", "left")
    placed = marked.withColumn("pos", F.explode(both_ends(F.col("start"), F.col("end"))))
    good = F.col("listed").isNotNull() & F.col("length").isNotNull()
    out = (F.col("pos") < 0) | (F.col("pos") >= F.col("length"))
    counts = placed.where(good & ~out).groupBy("track_id", "chrom", "pos").agg(F.count("*").alias("n"))
    report = placed.agg(F.count_if(good & out).alias("dropped"), (F.count_if(F.col("listed").isNull()) / 2).cast("long").alias("skipped"), (F.count_if(F.col("listed").isNotNull() & F.col("length").isNull()) / 2).cast("long").alias("unknown"))
    return counts, cells, report


def skip_reasons(reads: DataFrame, least_mapq: int = 0, primary_only: bool = False, has_tags: Column | None = None) -> DataFrame:
    """(reason, n): the first reason why a read is skipped; null for those that are used."""
    from basetrack.functions.reads import SECONDARY, SUPPLEMENTARY, UNMAPPED, has

    flag = F.col("flag")
    reason = F.when(has(flag, UNMAPPED), "unmapped").when(has(flag, SECONDARY), "secondary")
    if primary_only:
        reason = reason.when(has(flag, SUPPLEMENTARY), "supplementary")
    reason = reason.when(F.col("mapq") < least_mapq, "low_mapq")
    if has_tags is not None:
        reason = reason.when(~has_tags, "no_tags")
    return reads.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def unique_names(reads: DataFrame) -> DataFrame:
    """Adds ``track``: the second read of a name gets its place, later ones a number too."""
    w = Window.partitionBy("qname").orderBy("ordinal")
    k = F.row_number().over(w)
    place = F.concat_ws("", F.lit("@"), F.col("chrom"), F.lit(":"), F.col("start").cast("string"))
    return reads.withColumn("track", F.when(k == 1, F.col("qname")).when(k == 2, F.concat(F.col("qname"), place)).otherwise(F.concat(F.col("qname"), place, F.lit("#"), k.cast("string"))))


def mirrored(pixels: DataFrame) -> DataFrame:
    """A full contact matrix from one triangle: repeats summed, the diagonal once."""
    one = pixels.select(F.least("bin1", "bin2").alias("i"), F.greatest("bin1", "bin2").alias("j"), "n").groupBy("i", "j").agg(F.sum("n").alias("n"))
    return one.unionByName(one.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))
