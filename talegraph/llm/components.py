"""Connected components by alternating large-star and small-star steps.

Every step is a minimum by key (combined before the shuffle) and a join whose skewed keys
Spark can split, and is written to the shared folder; nothing is collected but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u long, v long) -> (node, label): label is the least node of the component.

    Nodes without edges to others do not appear; loops and repeated edges are ignored."""
    now = scratch.save(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    )
    rows = now.count()
    while rows:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.save(large, rows)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        small = scratch.save(small, rows)
        scratch.drop(now)
        scratch.drop(large)
        now = small
        # a star forest: each node has one parent, and no parent has one
        unsettled = now.groupBy("a").count().where("count > 1").select("a").union(now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a"))
        if unsettled.limit(1).count() == 0:
            break
    # without edges nothing appears
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
