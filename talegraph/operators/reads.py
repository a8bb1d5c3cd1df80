"""Lookups, filters and references over the live graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import begun, revealed, suffix
from ..model import Graph, cut
from .ingest import read_span_bytes
from .search import containing


def as_of_node(g: Graph, as_of: int | None) -> DataFrame:
    """Live nodes that a reader at as_of may know."""
    return g.live_node.where(revealed(as_of))


def get_brief(g: Graph, requests: DataFrame, as_of: int | None = None) -> DataFrame:
    """requests (pos, id) -> pos, id, kind, title, summary, rev; ids that are not there are left out."""
    return requests.join(as_of_node(g, as_of), "id").select("pos", "id", "kind", "title", "summary", "rev")


def get_full(g: Graph, requests: DataFrame, as_of: int | None = None, cids: DataFrame | None = None) -> DataFrame:
    """requests (pos, id), cids (id, cid) -> brief columns, props, times, and aliases, tags, viewers and evidence as sorted lists, and the content id.

    Each side table is narrowed to the requests before it is grouped."""
    base = requests.join(as_of_node(g, as_of), "id").select("pos", "id", "kind", "title", "summary", "rev", "props", "story_from", "story_to", "reveal_at", "origin", "locked")
    ids = base.select("id").distinct()

    def gathered(side: DataFrame, key: str, value, name: str) -> DataFrame:
        side = side.join(ids, side[key] == ids["id"], "left_semi")
        return side.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(value)).alias(name))

    out = base
    for side, key, value, name in (
        (g.node_alias, "node", F.col("alias"), "aliases"),
        (g.node_tag, "node", F.col("tag"), "tags"),
        (g.visibility, "fact", F.concat_ws(":", F.col("viewer"), F.coalesce(F.col("learned_at").cast("string"), F.lit("-")), F.col("pathway")), "visible_to"),
        (g.evidence, "node", F.concat_ws(":", F.col("file"), F.col("start_off").cast("string"), F.col("end_off").cast("string")), "spans"),
    ):
        out = out.join(gathered(side, key, value, name), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out if cids is None else out.join(cids, "id", "left")


def refs(g: Graph, requests: DataFrame, direction: str = "in", rels: list[str] | None = None, include_soft: bool = False, as_of: int | None = None) -> DataFrame:
    """requests (id) -> id, rel, other, title, hard, direction: neighbours by edges into and out of each id.

    The neighbour's reveal time and the edge's story start are held to as_of; its story end is not."""
    edge = g.live_edge.where(begun(as_of))
    if rels:
        edge = edge.where(F.col("rel").isin(rels))
    if not include_soft:
        edge = edge.where("hard")
    nodes = as_of_node(g, as_of).select(F.col("id").alias("other"), "title")
    sides = {"in": ("dst", "src"), "out": ("src", "dst")}
    parts = []
    for way in ("in", "out") if direction == "both" else (direction,):
        here, there = sides[way]
        part = edge.select(F.col(here).alias("id"), "rel", F.col(there).alias("other"), "hard", F.lit(way).alias("direction"))
        parts.append(requests.select("id").join(part, "id").join(nodes, "other"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("id", "rel", "other", "title", "hard", "direction")


def with_all_tags(g: Graph, tags: list[str]) -> DataFrame:
    """Ids that carry every one of the tags."""
    found = g.node_tag.where(F.col("tag").isin(tags)).groupBy("node").agg(F.countDistinct("tag").alias("n"))
    return found.where(F.col("n") == len(set(tags))).select(F.col("node").alias("id"))


def public_nodes(g: Graph, kinds: DataFrame) -> DataFrame:
    return g.live_node.join(F.broadcast(kinds.where("not internal")), "kind", "left_semi")


def address_resolve(g: Graph, requests: DataFrame) -> DataFrame:
    """requests (ref) -> ref, status, id, tier: which node a reference names.

    Tiers: 0 id, 1 id suffix, 2 title, 3 alias, 4 end of suffix or title, 5 end or part of an
    alias, 6 part of a title.  The equal tiers are joins by key; only references that they
    leave open are compared by part."""
    fold = F.lower
    want = requests.select("ref").distinct().withColumn("key", fold("ref"))
    nodes = g.live_node.select("id", fold("id").alias("lid"), fold(suffix("id")).alias("tail"), fold("title").alias("ltitle"))
    alias = g.node_alias.select(F.col("node").alias("id"), fold("alias").alias("lalias")).join(nodes.select("id"), "id", "left_semi")

    def equal(side: DataFrame, column: str, tier: int) -> DataFrame:
        return want.join(side, F.col("key") == F.col(column)).select("ref", "id", F.lit(tier).alias("tier"))

    exact = equal(nodes, "lid", 0).unionByName(equal(nodes, "tail", 1)).unionByName(equal(nodes, "ltitle", 2)).unionByName(equal(alias, "lalias", 3))
    rest = want.join(exact.select("ref").distinct(), "ref", "left_anti")
    # an end is a part too: names that hold an open reference come from the runs of characters they share
    names = nodes.select(F.col("tail").alias("name")).union(nodes.select("ltitle")).union(alias.select("lalias"))
    holds = cut(rest.join(containing(rest.select(F.col("key").alias("t")), names).withColumnRenamed("t", "key"), "key"))
    ends = holds.where(F.col("name").endswith(F.col("key")))
    part = ends.join(nodes.withColumnRenamed("tail", "name"), "name").select("ref", "id").union(ends.join(nodes.withColumnRenamed("ltitle", "name"), "name").select("ref", "id")).withColumn("tier", F.lit(4))
    part = part.unionByName(holds.join(alias.withColumnRenamed("lalias", "name"), "name").select("ref", "id", F.lit(5).alias("tier")))
    part = part.unionByName(holds.where(~F.col("ref").rlike(r"\[\d+\]$")).join(nodes.withColumnRenamed("ltitle", "name"), "name").select("ref", "id", F.lit(6).alias("tier")))
    hits = exact.unionByName(part).groupBy("ref", "id").agg(F.min("tier").alias("tier"))
    best = hits.groupBy("ref").agg(F.min("tier").alias("tier"))
    found = hits.join(best, ["ref", "tier"]).groupBy("ref", "tier").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    out = want.select("ref").join(found, "ref", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return out.select("ref", status.alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"), "tier")


def address_parse(requests: DataFrame, kinds: DataFrame) -> DataFrame:
    """requests (ref) -> ref, canonical, valid: scheme cut, known kinds in lower case, bad parts refused."""
    bare = F.regexp_replace("ref", "^story://", "")
    head = F.lower(F.substring_index("bare", "/", 1))
    out = requests.withColumn("bare", bare).withColumn("head", head)
    names = kinds.select(F.lower("kind").alias("head"), F.lit(True).alias("known"))
    out = out.join(F.broadcast(names), "head", "left")
    parts = F.split("bare", "/")
    bad = F.col("bare").rlike(r"[?#\\]") | F.exists(parts, lambda p: p.isin("", ".", ".."))
    canonical = F.when(F.col("known") & F.col("bare").contains("/"), F.concat("head", F.expr("substring(bare, length(head) + 1)"))).otherwise(F.col("bare"))
    return out.select("ref", canonical.alias("canonical"), (~bad).alias("valid"))


def query_sql(g: Graph, sql: str, limit: int = 1000, **args) -> DataFrame:
    """One read-only SELECT over the graph's views, with named parameters; one row more than limit tells that there are more."""
    text = sql.strip()
    if ";" in text or not text.upper().startswith(("SELECT", "WITH")):
        raise ValueError("one SELECT or WITH is asked for")
    g.as_views()
    return g.node.sparkSession.sql(f"SELECT * FROM ({text}) AS q LIMIT {limit + 1}", args=args or None)


def history(versions: DataFrame, most: int = 50) -> DataFrame:
    """versions (node, rev, tx_from) -> newest revisions of each node with the one before and when each ended."""
    by = Window.partitionBy("node").orderBy("rev")
    out = versions.withColumn("derived_from", F.lag("rev").over(by)).withColumn("tx_to", F.lead("tx_from").over(by))
    newest = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("rev")))
    return out.withColumn("n", newest).where(F.col("n") <= most).drop("n")


def get_body(g: Graph, asked: DataFrame, files: DataFrame, as_of: int | None = None) -> DataFrame:
    """asked (pos, id), files (file, content) -> pos, id, title, body, hidden: span text of each node; one that is not yet revealed has none."""
    bodies = read_span_bytes(files, g.evidence.join(asked.select(F.col("id").alias("node")).distinct(), "node", "left_semi")).withColumnRenamed("node", "id")
    out = asked.join(g.live_node.select("id", "title", "reveal_at"), "id").join(bodies, "id", "left")
    shown = revealed(as_of)
    return out.select("pos", "id", "title", F.when(shown, F.col("body")).alias("body"), (~shown).alias("hidden"))
