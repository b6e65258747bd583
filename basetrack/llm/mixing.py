"""Temperature mixing of sources in DataFrame functions only.

A source's weight is its token share to the power of an exponent, normalised.  The exponent (1: as the corpus is, 0: all alike) is
bisected, a few levels of halving in each pass over the small table of sources, until the weights reach a target entropy or
stay within a repetition limit.  Weights become token budgets, and budgets whole epochs and a remainder.  The order of an epoch is a
block permutation: documents are dealt into blocks by hash, blocks are ordered by a hash of the epoch, and so are documents in their
block.  The remainder's epoch takes the blocks before the one where the budget ends, and of that one the documents
before the budget's end: a source needs only its threshold block, whatever its size, so a source with a third of all rows is
handled by all tasks, and texts are not shuffled.

Edge cases: a null source is a source; a text without words has no tokens and comes in every whole epoch, and in the last one by its
place; a source without tokens has one epoch; repeated rows are rows; an empty table gives an empty result; other columns stay,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basetrack.llm.common import materialise, shared_dir, unused

#: Leading hex digits of a block's order that make a band of blocks: 4,096 bands a source.
BAND_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    #: Either the most epochs of any source, or an entropy in nats; the entropy goes first where given.
    max_repeats: float = 2.0
    target_entropy: float | None = None
    #: Tokens in all; None: as many as give the least repeated source one epoch, so that no document is lost.
    budget: int | None = None
    #: Mean rows in a block.
    block_rows: int = 256
    seed: int = 17
    #: Halvings in a pass, passes.
    levels: int = 4
    passes: int = 5


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_table(rows: DataFrame) -> DataFrame:
    """key, tokens, docs of each source; rows: key, tokens."""
    return rows.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def find_exponent(sources: DataFrame, mix: Mix) -> float:
    """The bisected exponent, to 2^-(levels * passes); each pass returns 2^levels - 1 rows at most."""
    lo, hi = 0.0, 1.0
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(_total(sources))).alias("p"), "tokens")
    n = 1 << mix.levels
    for _ in range(mix.passes):
        step = (hi - lo) / n
        points = [lo + step * i for i in range(1, n)]
        grid = shares.select("p", "tokens", F.explode(F.array(*map(F.lit, points))).alias("x")).withColumn("w", F.pow("p", "x"))
        s = grid.groupBy("x").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") / F.col("p")).alias("most"), F.min(F.col("w") / F.col("p")).alias("least"), F.max(F.col("w") / F.col("tokens")).alias("per_token"))
        if mix.target_entropy is not None:  # falls as the exponent grows: the largest exponent that still reaches the target
            fits = F.log("z") - F.col("wl") / F.col("z") < mix.target_entropy
        elif mix.budget is None:
            fits = F.col("most") / F.col("least") <= mix.max_repeats
        else:
            fits = F.col("per_token") / F.col("z") * F.lit(float(mix.budget)) <= mix.max_repeats
        good = {r["x"] for r in s.where(fits).select("x").collect()}
        first = next((x for x in points if x in good), None)
        lo, hi = (first - step, first) if first is not None else (hi - step, hi)
    return round(hi, 6)


def _total(sources: DataFrame) -> float:
    return float(sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] or 1)


def plan_sources(sources: DataFrame, mix: Mix) -> DataFrame:
    """key, tokens, docs, blocks, weight, budget, epochs, rest: one row per source."""
    exponent, total = find_exponent(sources, mix), _total(sources)
    some = F.col("tokens") > 0
    raw = sources.withColumn("share", F.col("tokens") / F.lit(total)).withColumn("raw", F.when(some, F.pow("share", F.lit(exponent))).otherwise(0.0))
    z = raw.agg(F.sum("raw").alias("z"), F.min(F.when(some, F.col("raw") / F.col("share"))).alias("least")).select(F.coalesce("z", F.lit(1.0)), F.coalesce("least", F.lit(1.0))).first()
    budget = float(mix.budget) if mix.budget is not None else total * float(z[0] or 1.0) / float(z[1] or 1.0)
    weight = F.col("raw") / F.lit(float(z[0] or 1.0))
    quota = F.round(weight * F.lit(budget)).cast("long")
    out = raw.withColumns({"weight": weight, "budget": quota, "blocks": F.ceil(F.col("docs") / F.lit(mix.block_rows)).cast("long")})
    epochs = F.when(some, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long")
    return out.withColumn("epochs", epochs).withColumn("rest", F.when(some, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0)).select("key", "tokens", "docs", "blocks", "weight", "budget", "epochs", "rest")


def _part(*columns: Column) -> Column:
    """The first 15 hex digits of an MD5: an order that any SQL engine can follow."""
    return F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15)


def mix_sources(docs: DataFrame, mix: Mix = Mix(), folder: str | None = None) -> DataFrame:
    """``docs`` as often as the mix takes them, with mix_epoch, mix_block, mix_block_order, mix_row_order, mix_tokens and mix_weight.

    Sorted by epoch, block order and row order, a source's rows are its budgeted block permutation.  Where ``docs`` has a column of such
    a name, the new one gets a number (mix_epoch_1); the six new columns are the last.
    """
    folder = folder or shared_dir(docs.sparkSession)
    names = docs.columns
    # the columns of docs go by numbers until the end, so that no name of theirs meets one from here
    plain = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    doc_id, source, text = (F.col(f"c{[n.lower() for n in names].index(c)}") for c in ("doc_id", "source", "text"))
    doc = F.coalesce(doc_id.cast("string"), F.lit(""))
    keyed = plain.withColumns({"key": _key(source.cast("string")), "mix_tokens": tokens(text)})
    sources = materialise(source_table(keyed.select("key", F.col("mix_tokens").alias("tokens"))), folder, "sources")
    plan = materialise(plan_sources(sources, mix), folder, "plan")
    seed = F.lit(str(mix.seed))
    brief = plan.select("key", "blocks", "epochs", "rest", F.col("weight").alias("mix_weight"))
    block = F.conv(F.substring(F.md5(F.concat_ws("|", seed, doc)), 16, 12), 16, 10).cast("long") % F.col("blocks")

    # the remainder's epoch: where in the order of blocks does each source's budget end?
    slim = keyed.select(doc_id, "key", "mix_tokens").join(brief, "key").where("rest > 0").withColumn("mix_block", block)
    order = _part(seed, F.col("epochs").cast("string"), F.col("key"), F.col("mix_block").cast("string"))
    blocks = materialise(slim.groupBy("key", "mix_block", "epochs", "rest").agg(F.sum("mix_tokens").alias("t")).withColumn("o", order).withColumn("band", F.substring("o", 1, BAND_DIGITS)), folder, "blocks")
    # the order is by hex digits, so a source's blocks are summed by bands of leading digits, and only one band of each source is sorted
    bands = blocks.groupBy("key", "band", "rest").agg(F.sum("t").alias("t"))
    before = F.sum("t").over(Window.partitionBy("key").orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t")
    ending = bands.withColumn("base", before).where((F.col("base") <= F.col("rest")) & (F.col("base") + F.col("t") > F.col("rest"))).select("key", "band", "base")
    inside = F.sum("t").over(Window.partitionBy("key", "band").orderBy("o", "mix_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t") + F.col("base")
    ends = blocks.join(ending, ["key", "band"]).withColumn("before", inside).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest")))
    cut = materialise(ends.groupBy("key").agg(F.max_by("o", "before").alias("cut"), F.max_by("mix_block", "before").alias("cut_block"), F.max("before").alias("cut_before")), folder, "cuts")

    rows = keyed.join(brief, "key").join(cut, "key", "left").withColumn("mix_block", block)
    epochs = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("epochs") - 1 + F.when(F.col("rest") > 0, 1).otherwise(0), F.lit(0)))
    each = rows.where("epochs > 0 or rest > 0").withColumn("mix_epoch", F.explode(epochs))
    each = each.withColumns({"mix_block_order": _part(seed, F.col("mix_epoch").cast("string"), F.col("key"), F.col("mix_block").cast("string")), "mix_row_order": _part(seed, F.col("mix_epoch").cast("string"), doc)})
    last = F.col("mix_epoch") == F.col("epochs")
    earlier = F.col("cut").isNull() | (F.col("mix_block_order") < F.col("cut")) | ((F.col("mix_block_order") == F.col("cut")) & (F.col("mix_block") < F.col("cut_block")))
    new = ("mix_epoch", "mix_block", "mix_block_order", "mix_row_order", "mix_tokens", "mix_weight")
    out = [*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), *(F.col(c).alias(n) for c, n in zip(new, unused(names, *new), strict=True))]
    whole = each.where(~last | earlier).select(*out)
    # the block where a budget ends has about block_rows documents; they alone are sorted
    bound = last & (F.col("mix_block") == F.col("cut_block"))
    running = F.sum("mix_tokens").over(Window.partitionBy("key", "mix_block").orderBy("mix_row_order", doc_id).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    partial = each.where(bound).withColumn("running", running).where(F.col("cut_before") + F.col("running") <= F.col("rest")).select(*out)
    return whole.unionAll(partial)
