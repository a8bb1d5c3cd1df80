"""Content of nodes as it was at a revision, and what is different since.

versions: node, rev, field, value: what each revision put; a field that no revision put yet has what the
graph held before the first.  A field is a column, props.path, or edge:rel:dst with 'open' or 'closed'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph, among, cut, head
from .commit import Committed
from .intervals import within

#: What is told and not typed: a change of these alone passes nothing on.
UNTYPED = ("title", "summary", "body")


def versions_of(committed: Committed, ops: DataFrame) -> DataFrame:
    """node, rev, field, value of every revision that a commit made."""
    put = ops.select("proposal", "seq", F.col("verb").alias("did"), "to_val")
    r = committed.revisions.join(put, ["proposal", "seq"])
    edge = F.when(F.col("did") == "LINK", "open").when(F.col("did").isin("UNLINK", "INVALIDATE"), "closed")
    value = F.when(F.col("field").startswith("edge:"), edge).when(F.col("field") == "$invalidate", F.lit("gone")).otherwise(F.col("to_val"))
    return r.select("node", "rev", "field", value.alias("value"))


def base_value(g: Graph, asked: DataFrame) -> DataFrame:
    """asked (node, field) -> node, field, value: what the graph holds."""
    asked = cut(asked)
    n = g.live_node.select(F.col("id").alias("node"), "kind", "title", "summary", "props", "locked", "story_from", "story_to", "reveal_at")
    path = F.col("field")
    value: Column = F.when(path.startswith("props."), F.try_variant_get(F.try_parse_json("props"), F.concat(F.lit("$."), F.substring(path, 7, 1000)), "string"))
    for c in ("kind", "title", "summary", "locked", "story_from", "story_to", "reveal_at"):
        value = value.when(path == c, F.col(c).cast("string"))
    # tables that no asked field or node can meet are not shuffled
    n = among(n, head("node"), asked.select(head("node")))
    edges = g.live_edge.where(F.lit(not asked.where("field like 'edge:%'").isEmpty()))
    is_open = edges.select(F.col("src").alias("node"), F.concat_ws(":", F.lit("edge"), "rel", "dst").alias("field"), F.lit("open").alias("is_open")).distinct()
    lists = g.node_alias.groupBy("node").agg(F.to_json(F.sort_array(F.collect_list("alias"))).alias("held")).withColumn("field", F.lit("aliases"))
    lists = lists.unionByName(g.node_tag.groupBy("node").agg(F.to_json(F.sort_array(F.collect_list("tag"))).alias("held")).withColumn("field", F.lit("tags")))
    out = asked.join(n, "node", "left").join(is_open, ["node", "field"], "left").join(lists, ["node", "field"], "left")
    return out.select("node", "field", F.coalesce(value, "is_open", "held").alias("value"))


def asof_content(reads: DataFrame, versions: DataFrame, base: DataFrame) -> DataFrame:
    """reads (reader, node, rev), base (node, field, value) -> reader, node, rev, field, then, now for each field that a later revision put.

    then: the value that the newest revision at or below the one read had put, or the base's."""
    by = Window.partitionBy("node", "field").orderBy("rev")
    spans = versions.select("node", "field", F.col("rev").alias("first"), F.lead("rev").over(by).alias("after"), F.col("value").alias("then"))
    now = versions.groupBy("node", "field").agg(F.max_by(F.struct("value"), "rev")["value"].alias("now"), F.max("rev").alias("last"))
    asked = reads.select("reader", "node", "rev").distinct().join(now, "node").where("last > rev")
    held = within(asked.select("reader", "node", "field", "rev"), spans, ["node", "field"], "rev", "first", "after").select("reader", "node", "field", "rev", "then", F.lit(True).alias("met"))
    out = asked.join(held, ["reader", "node", "field", "rev"], "left").join(base.select("node", "field", F.col("value").alias("was")), ["node", "field"], "left")
    return out.select("reader", "node", "rev", "field", F.when(F.col("met"), F.col("then")).otherwise(F.col("was")).alias("then"), "now")


def changed_since(reads: DataFrame, versions: DataFrame, base: DataFrame) -> DataFrame:
    """reader, node, rev, fields: typed fields that differ now from what was read; reads without one are left out."""
    differ = asof_content(reads, versions, base).where(~F.col("then").eqNullSafe(F.col("now")) & ~F.col("field").isin(*UNTYPED))
    return differ.groupBy("reader", "node", "rev").agg(F.sort_array(F.collect_set("field")).alias("fields"))
