"""Consistency rules: each a DataFrame (node, related array<string>, detail)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import rule_dim
from ..functions.columns import flag, items, prop, typed
from ..model import Graph, cut
from .intervals import overlapping
from .traverse import on_cycles, reached, scope_descendants

RULES: dict[str, Callable[[Graph], DataFrame]] = {}


def rule(name: str):
    def put(f):
        RULES[name] = f
        return f

    return put


def _finding(df: DataFrame, node: str, related: list, detail) -> DataFrame:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    rel = F.array(*related) if related else F.array().cast("array<string>")
    return df.select(F.col(node).alias("node"), rel.alias("related"), detail.alias("detail"))


def _differing(g: Graph, asked: str) -> DataFrame:
    """Facts on one subject and predicate, of those asked for, that hold at the same time with different objects."""
    n = g.live_node.where("kind = 'Fact'").withColumn("predicate", prop("predicate")).where(asked)
    facts = n.select("id", prop("subject").alias("subject"), "predicate", typed("object").alias("object"), "story_from", "story_to")
    return overlapping(facts.where("subject is not null"), ["subject", "predicate"], "object")


@rule("timeline.absolute")
def timeline_absolute(g: Graph) -> DataFrame:
    return _finding(_differing(g, "predicate = 'absolute_time'"), "a_id", ["b_id", "subject"], "different absolute times")


@rule("timeline.simultaneity")
def timeline_simultaneity(g: Graph) -> DataFrame:
    """One person in two overlapping scenes that occur at different places."""
    scene = g.live_node.where("kind = 'Scene'").select("id", "story_from", F.coalesce("story_to", "story_from").alias("story_to"))
    at = g.live_edge.where("rel = 'occurs_at'").select("src", F.col("dst").alias("place"))
    there = g.live_edge.where("rel = 'present_at'").select("src", F.col("dst").alias("person"))
    seen = there.join(scene, there["src"] == scene["id"]).drop("src").join(at, F.col("id") == at["src"]).select("person", "id", "story_from", "story_to", "place")
    met = overlapping(seen, ["person"], "place")
    return _finding(met, "a_id", ["b_id", "person", "a_value", "b_value"], "one person in two places")


@rule("plot.causeless")
def plot_causeless(g: Graph) -> DataFrame:
    n = g.live_node.where(F.col("kind").isin("Scene", "Event") & flag("expect_cause"))
    caused = g.live_edge.where("rel = 'causes'").select(F.col("dst").alias("id"))
    return _finding(n.join(caused, "id", "left_anti"), "id", [], "a cause is expected and none comes in")


@rule("plot.abandoned")
def plot_abandoned(g: Graph) -> DataFrame:
    n = g.live_node.where("kind = 'Promise'").where(F.coalesce(prop("status"), F.lit("hypothetical")) == "hypothetical")
    return _finding(n, "id", [], "a promise left hypothetical")


def _claims(g: Graph) -> DataFrame:
    n = g.live_node.where("kind = 'Scene'")
    return n.select("id", "story_from", F.explode(items("claims", "speaker: string, fact: string")).alias("c")).select("id", "story_from", "c.speaker", "c.fact")


@rule("character.memory")
def character_memory(g: Graph) -> DataFrame:
    known = g.visibility.where("learned_at is not null").select("fact", F.col("viewer").alias("speaker"), "learned_at")
    early = _claims(g).join(known, ["fact", "speaker"]).where("story_from is null or learned_at > story_from")
    return _finding(early, "id", ["speaker", "fact"], "spoken before it was learned")


@rule("character.knowledge")
def character_knowledge(g: Graph) -> DataFrame:
    known = g.visibility.select("fact", F.col("viewer").alias("speaker"))
    return _finding(_claims(g).join(known, ["fact", "speaker"], "left_anti"), "id", ["speaker", "fact"], "spoken by one who does not know it")


def _conditions(n: DataFrame, name: str) -> DataFrame:
    """Conditions exploded as variants, so values keep their JSON type."""
    each = n.select("id", F.explode(F.from_json(F.get_json_object("props", f"$.{name}"), "array<variant>")).alias("v"))

    def text(field: str):
        return F.try_variant_get("v", f"$.{field}", "string").alias(field)

    return each.select("id", text("subject"), text("field"), F.coalesce(F.try_variant_get("v", "$.op", "string"), F.lit("eq")).alias("op"), F.coalesce(F.to_json(F.try_variant_get("v", "$.value", "variant")), F.lit("null")).alias("value"))


@rule("world.core_rule")
def world_core_rule(g: Graph) -> DataFrame:
    post = _conditions(g.live_node.where("kind = 'Scene'"), "post")
    forbid = _conditions(g.live_node.where("kind = 'Rule' and locked"), "forbid").withColumnRenamed("id", "rule")
    return _finding(post.join(forbid, ["subject", "field", "op", "value"]), "id", ["rule"], "a scene does what a locked rule forbids")


@rule("detail.appearance")
def detail_appearance(g: Graph) -> DataFrame:
    differ = _finding(_differing(g, "predicate != 'absolute_time'"), "a_id", ["b_id", "subject"], "one property, overlapping times, different values")
    dead = g.live_node.where("kind = 'Fact' and story_from is not null").where((prop("predicate") == "life_state") & (prop("object") == "dead"))
    dead = dead.select(F.col("id").alias("fact"), prop("subject").alias("dst"), F.col("story_from").alias("died"))
    there = g.live_edge.where("rel = 'present_at'").select("src", "dst")
    scene = g.live_node.where("kind = 'Scene'").select(F.col("id").alias("src"), "story_from")
    again = dead.join(there, "dst").join(scene, "src").where("story_from > died")
    return differ.unionByName(_finding(again, "fact", ["src", "dst"], "seen again after death"))


@rule("detail.nomenclature")
def detail_nomenclature(g: Graph) -> DataFrame:
    said = g.live_node.where("kind = 'Scene'").select("id", F.explode(items("mentions", "entity: string, name: string")).alias("m")).select("id", "m.entity", "m.name")
    named = g.live_node.select(F.col("id").alias("entity"), "title")
    other = said.join(named, "entity").where("name != title")
    known = g.node_alias.select(F.col("node").alias("entity"), F.col("alias").alias("name"))
    return _finding(other.join(known, ["entity", "name"], "left_anti"), "id", ["entity"], F.concat(F.lit("unregistered name: "), F.col("name")))


@rule("narrative.perspective")
def narrative_perspective(g: Graph) -> DataFrame:
    seen = g.live_edge.where("rel = 'focalizes'").select(F.col("dst").alias("id"), "src")
    n = g.live_node.where("kind = 'Scene'").select("id").join(seen, "id", "left").groupBy("id").agg(F.count("src").alias("n"), F.sort_array(F.collect_list("src")).alias("related"))
    return n.where("n != 1").select(F.col("id").alias("node"), "related", F.concat(F.lit("focalizing edges: "), F.col("n").cast("string")).alias("detail"))


@rule("promise.unearned")
def promise_unearned(g: Graph) -> DataFrame:
    paid = g.live_edge.where("rel = 'pays_off'").select(F.col("dst").alias("id"), "src")
    triggers = g.live_edge.where("rel = 'requires_trigger'").select(F.col("src").alias("id"))
    n = g.live_node.where("kind = 'Promise'").select("id").join(paid, "id").join(triggers, "id", "left_anti")
    return n.groupBy(F.col("id").alias("node")).agg(F.sort_array(F.collect_list("src")).alias("related")).withColumn("detail", F.lit("paid off without a trigger"))


@rule("promise.premature")
def promise_premature(g: Graph) -> DataFrame:
    scene = g.live_node.where("story_from is not null").select("id", "story_from")
    paid = g.live_edge.where("rel = 'pays_off'").select(F.col("dst").alias("promise"), F.col("src").alias("pay"))
    paid = paid.join(scene.select(F.col("id").alias("pay"), F.col("story_from").alias("paid_at")), "pay")
    trigger = g.live_edge.where("rel = 'requires_trigger'").select(F.col("src").alias("promise"), F.col("dst").alias("trigger"))
    trigger = trigger.join(scene.select(F.col("id").alias("trigger"), F.col("story_from").alias("trigger_at")), "trigger")
    n = g.live_node.where("kind = 'Promise'").select(F.col("id").alias("promise"))
    early = n.join(paid, "promise").join(trigger, "promise").where("paid_at < trigger_at")
    return _finding(early, "promise", ["pay", "trigger"], "paid off before its trigger")


@rule("graph.causal_cycle")
def causal_cycle(g: Graph) -> DataFrame:
    nodes = on_cycles(g.live_edge.where("rel = 'causes'").select("src", "dst"))
    return _finding(nodes, "id", ["id"], "a cycle of causes")


@rule("graph.unreachable")
def unreachable(g: Graph) -> DataFrame:
    """Silent unless the graph has both a start and an end."""
    events = cut(g.live_node.where(F.col("kind").isin("Scene", "Event")).select("id", flag("is_start").alias("is_start"), flag("is_end").alias("is_end")))
    causes = cut(g.live_edge.where("rel = 'causes'").select("src", "dst"))
    forward = reached(causes, events.where("is_start"))
    backward = reached(causes.select(F.col("dst").alias("src"), F.col("src").alias("dst")), events.where("is_end"))
    both = events.agg(F.max("is_start").alias("s"), F.max("is_end").alias("e")).where("s and e").select(F.lit(True).alias("asked"))
    between = forward.join(backward, "id", "left_semi")
    return _finding(events.select("id").join(between, "id", "left_anti").join(F.broadcast(both)), "id", [], "not between a start and an end")


EXTRA: dict[str, Callable[[Graph], DataFrame]] = {}


def _extra(name: str):
    def put(f):
        EXTRA[name] = f
        return f

    return put


@_extra("plot.causal_violation")
def causal_violation(g: Graph) -> DataFrame:
    n = g.live_node.where("story_from is not null").select("id", "story_from")
    e = g.live_edge.where("rel = 'causes'").select("src", "dst")
    e = e.join(n.select(F.col("id").alias("src"), F.col("story_from").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("story_from").alias("b")), "dst")
    return _finding(e.where("b < a"), "src", ["dst"], "an effect before its cause")


@_extra("promise.trigger_undefined")
def trigger_undefined(g: Graph) -> DataFrame:
    triggers = g.live_edge.where("rel = 'requires_trigger'").select(F.col("src").alias("id"))
    n = g.live_node.where("kind = 'Promise'").where(F.get_json_object("props", "$.T").isNull())
    return _finding(n.join(triggers, "id", "left_anti"), "id", [], "no trigger is defined")


@_extra("graph.orphan_edge")
def orphan_edge(g: Graph) -> DataFrame:
    """Ends that are not there are found first, by one aggregate; they are few, so edges need not be dealt out by their ends."""
    e = g.live_edge.select("src", "dst", "rel")
    ends = e.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(False).alias("there"))
    ends = ends.unionByName(g.live_node.select("id", F.lit(True).alias("there")))
    lost = cut(ends.groupBy("id").agg(F.bool_or("there").alias("there")).where("not there or id is null").select("id"))
    no_src, no_dst = lost.select(F.col("id").alias("a"), F.lit(True).alias("no_src")), lost.select(F.col("id").alias("b"), F.lit(True).alias("no_dst"))
    e = e.join(no_src, F.col("src").eqNullSafe(F.col("a")), "left").join(no_dst, F.col("dst").eqNullSafe(F.col("b")), "left")
    return _finding(e.where("no_src or no_dst").select("src", "dst", "rel").distinct(), "src", ["dst", "rel"], "an end of the edge is not there")


def check(g: Graph, rules: list[str] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """rule, severity, nodes, message of every finding of the chosen rules, each once; scope (run, id) narrows it to what lies below."""
    parts = None
    for name in rules or list(RULES):
        part = (RULES | EXTRA)[name](g).select(F.lit(name).alias("rule"), "node", "related", "detail")
        parts = part if parts is None else parts.unionByName(part)
    nodes = F.array_distinct(F.concat(F.array("node"), F.filter("related", lambda x: x.isNotNull())))
    out = parts.select("rule", nodes.alias("nodes"), F.col("detail").alias("message")).dropDuplicates(["rule", "nodes", "message"])
    if scope is not None:
        inside = scope_descendants(g, scope).select(F.col("id").alias("n")).distinct()
        keyed = out.withColumn("key", F.sha2(F.to_json(F.struct("rule", "nodes", "message")), 256))
        hit = keyed.select("key", F.explode("nodes").alias("n")).join(inside, "n", "left_semi").select("key").distinct()
        out = keyed.join(hit, "key", "left_semi").drop("key")
    return out.join(F.broadcast(rule_dim(g.node.sparkSession).select("rule", "severity")), "rule")


def fingerprint() -> F.Column:
    return F.sha2(F.to_json(F.struct("rule", F.array_sort("nodes").alias("nodes"), "message")), 256)


def diag_sync(findings: DataFrame, open_rows: DataFrame) -> DataFrame:
    """findings (rule, nodes, message) against open (fingerprint, rule) -> fingerprint, rule, action: open, keep or resolve."""
    now = findings.select(fingerprint().alias("fingerprint"), "rule").distinct()
    old = open_rows.select("fingerprint", F.col("rule").alias("old_rule")).distinct()
    both = now.join(old, "fingerprint", "full")
    action = F.when(F.col("old_rule").isNull(), "open").when(F.col("rule").isNull(), "resolve").otherwise("keep")
    return both.select("fingerprint", F.coalesce("rule", "old_rule").alias("rule"), action.alias("action"))


def rule_spec_check(rules: DataFrame, built: list[str]) -> DataFrame:
    """rules (rule, executable) against the names that have a query -> rule, problem: those on one side only."""
    have = rules.sparkSession.createDataFrame([(r,) for r in built], "rule string").withColumn("built", F.lit(True))
    both = rules.where("executable").select("rule", F.lit(True).alias("listed")).join(have, "rule", "full")
    return both.where("listed is null or built is null").select("rule", F.when(F.col("built").isNull(), "no query").otherwise("not in the catalogue").alias("problem"))
