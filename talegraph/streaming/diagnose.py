"""Findings kept up to date: after a commit only what touches its nodes is evaluated again.

A finding of a local rule names every node that it depends on, so it can change only if one of these was
touched; KEYS says of which kinds.  Each rule is evaluated over the part of the graph around the touched
nodes that it can see, and its findings that name a touched node replace the open ones that do.
Cycles and reachability have no such part; they are evaluated whole, where scenes or events were touched.

Touched: the nodes that a commit wrote, and both ends of every edge that it opened or closed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import items, prop
from ..model import Graph, cut
from ..operators.rules import EXTRA, RULES, check, fingerprint

#: Kinds of the nodes that a finding of the rule depends on; none: of any kind.
KEYS: dict[str, tuple[str, ...]] = {
    "timeline.absolute": ("Fact",), "timeline.simultaneity": ("Scene",), "plot.causeless": ("Scene", "Event"), "plot.abandoned": ("Promise",),
    "character.memory": ("Scene", "Fact"), "character.knowledge": ("Scene", "Fact"), "world.core_rule": ("Scene", "Rule"), "detail.appearance": ("Fact", "Scene"),
    "detail.nomenclature": (), "narrative.perspective": ("Scene",), "promise.unearned": ("Promise",), "promise.premature": ("Promise", "Scene"),
    "plot.causal_violation": (), "promise.trigger_undefined": ("Promise",), "graph.orphan_edge": (),
}
WHOLE = ("graph.causal_cycle", "graph.unreachable")
OPEN = "rule string, nodes array<string>, message string, severity string"


@dataclass(frozen=True)
class Rechecked:
    """open: rule, nodes, message, severity; deltas: the same with action open or resolve"""

    open: DataFrame
    deltas: DataFrame


def _among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col("id").alias(column)), column, "left_semi").select(*df.columns)


def _around(g: Graph, touched: DataFrame) -> dict[str, Graph]:
    """For each rule the part of the graph that its findings about touched nodes come from."""
    node, edge = g.live_node, g.live_edge
    there = edge.where("rel = 'present_at'")

    def part(nodes: DataFrame, edges: DataFrame) -> Graph:
        return replace(g, node=_among(node, "id", nodes.distinct()), edge=edges)

    # facts: all about the subjects of touched facts and about who is in touched scenes, with the scenes of these
    facts = node.where("kind = 'Fact'").select("id", prop("subject").alias("subject")).where("subject is not null")
    subjects = _among(facts, "id", touched).select(F.col("subject").alias("id")).union(_among(there, "src", touched).select(F.col("dst").alias("id"))).distinct()
    about, met = _among(facts, "subject", subjects), _among(there, "dst", subjects)
    fact = part(about.select("id").union(met.select(F.col("src").alias("id"))), met)

    # persons of touched scenes, with all their scenes and places
    persons = _among(there, "src", touched).select(F.col("dst").alias("id")).distinct()
    theirs = _among(there, "dst", persons)
    scenes = theirs.select(F.col("src").alias("id")).distinct()
    scene = part(scenes, theirs.unionByName(_among(edge.where("rel = 'occurs_at'"), "src", scenes)))

    # scenes that name touched nodes in their lists
    said = node.where("kind = 'Scene'")
    claims = said.select("id", F.explode(items("claims", "speaker: string, fact: string")).alias("c")).select("id", F.col("c.fact").alias("at"))
    mentions = said.select("id", F.explode(items("mentions", "entity: string, name: string")).alias("m")).select("id", F.col("m.entity").alias("at"))
    mine = touched.select("id")
    claim = part(_among(claims, "at", touched).select("id").union(mine), edge)
    named = _among(mentions, "at", touched).select("id").union(mine).distinct()
    entities = _among(mentions, "id", named).select(F.col("at").alias("id"))
    mention = part(named.union(entities), edge)

    # rules: touched scenes with all rules, touched rules with the scenes that do what they speak of
    laws = node.where("kind = 'Rule'")
    done = said.select("id", F.explode(items("post", "subject: string")).alias("p")).select("id", F.col("p.subject").alias("at"))
    spoken = _among(laws, "id", touched).select(F.explode(items("forbid", "subject: string")).alias("p")).select(F.col("p.subject").alias("id")).where("id is not null").distinct()
    law = part(_among(done, "at", spoken).select("id").union(mine).union(laws.select("id")), edge)

    # edges at touched nodes, and those of the other ends that rules about promises and scenes look at
    near = _among(edge, "src", touched).unionByName(_among(edge, "dst", touched)).distinct()
    ends = near.select(F.col("src").alias("id")).union(near.select(F.col("dst").alias("id"))).union(mine).distinct()
    second = edge.where("rel in ('pays_off', 'requires_trigger')")
    far = _among(second, "src", ends).unionByName(_among(second, "dst", ends))
    nodes = ends.union(far.select(F.col("src").alias("id"))).union(far.select(F.col("dst").alias("id")))
    link = part(nodes, near.unionByName(far).distinct())

    by = {"timeline.absolute": fact, "detail.appearance": fact, "timeline.simultaneity": scene, "character.memory": claim, "character.knowledge": claim, "detail.nomenclature": mention, "world.core_rule": law}
    return {name: by.get(name, link) for name in KEYS}


def _naming(findings: DataFrame, touched: DataFrame, how: str) -> DataFrame:
    """Findings of local rules that name, or do not name, a touched node of a kind that their rule depends on."""
    spark = findings.sparkSession
    keys = spark.createDataFrame([(r, list(k)) for r, k in KEYS.items()], "rule string, kinds array<string>")
    f = findings.withColumn("key", F.xxhash64("rule", "nodes", "message")).join(F.broadcast(keys), "rule")
    hit = f.select("key", "kinds", F.explode("nodes").alias("id")).join(touched, "id").where((F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind"))).select("key").distinct()
    return f.join(hit, "key", how).select(*findings.columns)


def recheck(g: Graph, touched: DataFrame, open_rows: DataFrame, rules: list[str] | None = None) -> Rechecked:
    """g: the graph after the commit; touched (id); open_rows (rule, nodes, message, severity): open before it.

    The open set is then that of check() over the whole of g."""
    rules = rules or list(RULES | EXTRA)
    # an id's kind stands in the id; a node that is gone has none other
    touched = cut(touched.select("id", F.initcap(F.substring_index("id", "/", 1)).alias("kind")).where("id is not null").distinct())
    local, whole = [r for r in rules if r in KEYS], [r for r in rules if r in WHOLE]
    parts = _around(g, touched)
    new = None
    for some in {id(p): p for p in parts.values()}.values():
        mine = [r for r in local if parts[r] is some]
        if mine:
            found = check(Graph(**{k: cut(v) if k in ("node", "edge") else v for k, v in vars(some).items()}), mine).select("rule", "nodes", "message", "severity")
            new = found if new is None else new.unionByName(found)
    open_rows = open_rows.where(F.col("rule").isin(*rules))
    kept = _naming(open_rows.where(F.col("rule").isin(*local)), touched, "left_anti")
    now = kept if new is None else kept.unionByName(_naming(new, touched, "left_semi"))
    if whole:
        again = not touched.where("kind in ('Scene', 'Event')").isEmpty()
        now = now.unionByName(check(g, whole).select("rule", "nodes", "message", "severity") if again else open_rows.where(F.col("rule").isin(*whole)))
    now = cut(now)
    a, b = now.withColumn("fingerprint", fingerprint()), open_rows.withColumn("fingerprint", fingerprint())
    opened = a.join(b.select("fingerprint"), "fingerprint", "left_anti").withColumn("action", F.lit("open"))
    gone = b.join(a.select("fingerprint"), "fingerprint", "left_anti").withColumn("action", F.lit("resolve"))
    return Rechecked(now, opened.unionByName(gone))


def diag_stream(touched: DataFrame, load: Callable[[int], Graph], state: str, checkpoint: str, put: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """A stream of touched ids, a micro-batch for one or more commits; deltas of each are given to ``put``.

    load(number): the graph after that micro-batch.  state: a shared folder with the open findings after
    each; a batch reads the part that the one before wrote, so it comes out the same if it runs again.
    Before the first, nothing is open; its graph is checked whole."""

    def one(batch: DataFrame, number: int) -> None:
        g = load(number)
        spark = batch.sparkSession
        if number:
            out = recheck(g, batch, spark.read.schema(OPEN).parquet(f"{state}/after={number - 1}"))
        else:
            found = cut(check(g, list(RULES | EXTRA)).select("rule", "nodes", "message", "severity"))
            out = Rechecked(found, found.withColumn("fingerprint", fingerprint()).withColumn("action", F.lit("open")))
        out.open.write.mode("overwrite").parquet(f"{state}/after={number}")
        put(out.deltas, number)

    return touched.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
