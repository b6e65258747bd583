"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two joins and two aggregates over the edges, written to the shared folder; the driver sees one number a
round.  Aggregates are summed on the map side; a node with very many edges is a hot key of a join (``join_hot``).
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basetrack.llm.common import join_hot, materialise

def components(edges: DataFrame, folder: str, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node that it reaches."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, f"{name}-0")
    for i in itertools.count(1):  # as many as the logarithm of the longest path asks for
        n = now.count()
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("edges"))
        large = join_hot(both, least, ["u"], "edges", 2 * n, "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges"))
        small = join_hot(large, low, ["u"], "edges", n, "v").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"), "u", "m")
        star = small.select(F.col("u").alias("u"), F.col("m").alias("v")).unionAll(small.select(F.col("a").alias("u"), F.col("b").alias("v"))).where("u > v").distinct()
        new = materialise(star, folder, f"{name}-{i}")
        # done when every edge leads to a node that leads nowhere
        if new.select("v").distinct().join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = new
