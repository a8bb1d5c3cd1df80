"""Projections over the graph: ledger, visibility, contracts, timelines, read models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import begun, prop, revealed, typed
from ..model import Graph, cut, tasks_for
from .reads import history
from .rules import _conditions


def promise_ledger(g: Graph, as_of: int | None = None) -> DataFrame:
    """One row a promise: foreshadowing F, triggers T and payoffs P, when, and what it owes.

    One pass over the three relations; a promise's edges are narrowed to as_of at both ends."""
    n = g.live_node
    promise = n.where("kind = 'Promise'").where(revealed(as_of)).select("id", "title", F.coalesce(prop("status"), F.lit("hypothetical")).alias("status"), prop("debt").cast("double").alias("own_debt"), prop("s_eff").cast("double").alias("own_s"), prop("delta_coh").cast("double").alias("own_coh"))
    e = g.live_edge.where(F.col("rel").isin("plants", "requires_trigger", "pays_off")).where(begun(as_of))
    if as_of is not None:
        e = e.where((F.col("story_to").isNull()) | (F.col("story_to") >= as_of))
    out_of = F.col("rel") == "requires_trigger"
    e = e.select(F.when(out_of, F.col("src")).otherwise(F.col("dst")).alias("id"), F.when(out_of, F.col("dst")).otherwise(F.col("src")).alias("scene"), "rel")
    scene = n.where("kind = 'Scene'").where(begun(as_of)).select(F.col("id").alias("scene"), "story_from")
    e = e.join(scene, "scene")

    def scenes(rel: str):
        return F.sort_array(F.collect_set(F.when(F.col("rel") == rel, F.col("scene"))))

    def first(rel: str):
        return F.min(F.when(F.col("rel") == rel, F.col("story_from")))

    found = e.groupBy("id").agg(scenes("plants").alias("F"), scenes("requires_trigger").alias("T"), scenes("pays_off").alias("P"), first("plants").alias("planted_at"), first("requires_trigger").alias("trigger_at"))
    horizon = F.lit(as_of) if as_of is not None else F.col("last")
    out = promise.join(found, "id", "left")
    if as_of is None:
        out = out.join(F.broadcast(n.agg(F.coalesce(F.max("story_from"), F.lit(0)).alias("last"))))
    none = F.array().cast("array<string>")
    age = F.coalesce(F.greatest(F.lit(0), horizon - F.col("planted_at")), F.lit(0))
    debt = F.coalesce("own_debt", (F.col("age") + 1) * F.when(F.col("status") == "eligible", 1.5).otherwise(1.0))
    s_eff = F.coalesce("own_s", F.bround(1 / (1 + F.greatest(F.lit(0), F.col("trigger_at") - F.col("planted_at"))), 3), F.lit(1.0))
    coh = F.coalesce("own_coh", (F.when(F.size("F") > 0, 0.5).otherwise(0.0) + F.when(F.size("T") > 0, 0.5).otherwise(0.0)))
    out = out.withColumn("age", age)
    for c in ("F", "T", "P"):
        out = out.withColumn(c, F.coalesce(c, none))
    return out.select("id", "title", "status", "F", "T", "P", "planted_at", "trigger_at", F.col("age").cast("long").alias("age"), debt.alias("debt"), s_eff.alias("s_eff"), coh.alias("delta_coh"))


def open_promise(g: Graph) -> DataFrame:
    """Promises whose own status is hypothetical or eligible; a missing status is neither."""
    return g.live_node.where("kind = 'Promise'").where(prop("status").isin("hypothetical", "eligible")).select("id", "title", prop("status").alias("status"), prop("debt").cast("double").alias("debt"))


def promise_board(g: Graph) -> DataFrame:
    return promise_ledger(g).groupBy("status").agg(F.count("*").alias("n"), F.bround(F.sum("debt"), 6).alias("debt"))


def flashback(g: Graph) -> DataFrame:
    return g.live_node.where("story_from < reveal_at").select("id", "kind", "story_from", "reveal_at", (F.col("reveal_at") - F.col("story_from")).alias("gap"))


def timeline(g: Graph) -> DataFrame:
    """Dated nodes with both times, whether they are told late, and the last chapter of all."""
    n = g.live_node
    last = n.agg(F.greatest(F.lit(1), F.max(F.greatest("story_from", "story_to", "reveal_at"))).alias("max_chapter"))
    dated = n.where("story_from is not null or reveal_at is not null")
    late = F.coalesce(F.col("story_from") < F.col("reveal_at"), F.lit(False))
    return dated.select("id", "kind", "story_from", "reveal_at", late.alias("flashback")).join(F.broadcast(last))


def visibility_classify(g: Graph, asked: DataFrame) -> DataFrame:
    """asked (fact, character, as_of, spoken) -> four predicates over who knows each fact."""
    v = g.visibility.select("fact", "viewer", "learned_at")
    met = asked.join(v, "fact", "left")
    knows = F.col("viewer").isNotNull() & (F.col("learned_at").isNull() | (F.col("learned_at") <= F.col("as_of")))
    reader = F.col("viewer") == "reader"

    def some(c):
        return F.coalesce(F.bool_or(c), F.lit(False))

    out = met.groupBy("fact", "character", "as_of", "spoken").agg(
        some(knows & reader).alias("reader"),
        some(knows & (F.col("viewer") == F.col("character"))).alias("self"),
        some(knows & ~reader).alias("other"),
        some(reader & (F.col("learned_at") > F.col("as_of"))).alias("later"),
    )
    return out.select(
        "fact", "character", "as_of", "spoken",
        (F.col("character").isNotNull() & F.col("reader") & ~F.col("self")).alias("dramatic_irony"),
        (~F.col("reader") & F.col("other")).alias("mystery"),
        (~F.col("reader") & F.col("later")).alias("twist"),
        (F.col("spoken") & ~F.col("self")).alias("continuity_bug"),
    )


def scene_feasible(g: Graph, as_of: int | None = None) -> DataFrame:
    """One row a scene: failed pre conditions and forbidden ones that hold at its cutoff.

    A missing field fails eq, ne, in and not_in and satisfies not_exists; so does null."""
    n = g.live_node
    scene = n.where("kind = 'Scene'").select("id", "props", (F.lit(as_of) if as_of is not None else F.col("story_from")).alias("cutoff"))
    cond = _conditions(scene, "pre").withColumn("part", F.lit("pre")).unionByName(_conditions(scene, "forbid").withColumn("part", F.lit("forbid")))
    cond = cond.join(scene.select("id", "cutoff"), "id")
    subject = n.select(F.col("id").alias("subject"), F.col("props").alias("sprops"), "title", "kind", F.col("story_from").alias("begins"))
    met = cond.join(subject, "subject", "left")
    there = F.col("kind").isNotNull() & (F.col("begins").isNull() | F.col("cutoff").isNull() | (F.col("begins") <= F.col("cutoff")))
    path = F.concat(F.lit("$."), F.regexp_replace("field", r"^props\.", ""))
    field = F.when(there & F.col("field").startswith("props."), F.to_json(F.try_variant_get(F.try_parse_json("sprops"), path, "variant"))).when(there & (F.col("field") == "title"), F.to_json(F.to_variant_object(F.array("title"))))
    met = met.withColumn("found", field)
    has = F.col("found").isNotNull() & (F.col("found") != "null")
    within = F.exists(F.transform(F.from_json("value", "array<variant>"), lambda x: F.to_json(x)), lambda x: x == F.col("found"))
    holds = (
        F.when(F.col("op") == "eq", has & (F.col("found") == F.col("value")))
        .when(F.col("op") == "ne", has & (F.col("found") != F.col("value")))
        .when(F.col("op") == "in", has & within)
        .when(F.col("op") == "not_in", has & ~within)
        .when(F.col("op") == "exists", has)
        .when(F.col("op") == "not_exists", ~has)
    )
    met = met.withColumn("holds", F.coalesce(holds, F.lit(False)))
    bad = met.groupBy("id").agg(F.count_if((F.col("part") == "pre") & ~F.col("holds")).alias("failed_pre"), F.count_if((F.col("part") == "forbid") & F.col("holds")).alias("active_forbid"))
    out = scene.select("id").join(bad, "id", "left")
    failed, active = F.coalesce("failed_pre", F.lit(0)), F.coalesce("active_forbid", F.lit(0))
    return out.select("id", failed.alias("failed_pre"), active.alias("active_forbid"), ((failed == 0) & (active == 0)).alias("feasible"))


def kind_counts(g: Graph) -> DataFrame:
    return g.live_node.groupBy("kind").agg(F.count("*").alias("n"))


def status_counts(g: Graph, kinds: DataFrame) -> DataFrame:
    """One row: public nodes, edges between them, promises eligible and open."""
    public = g.live_node.join(F.broadcast(kinds.where("not internal")), "kind", "left_semi").select("id", "kind", "props")
    e = g.live_edge.select("src", "dst").join(public.select(F.col("id").alias("src")), "src", "left_semi").join(public.select(F.col("id").alias("dst")), "dst", "left_semi")
    status = F.coalesce(prop("status"), F.lit("hypothetical"))
    nodes = public.agg(F.count("*").alias("nodes"), F.count_if((F.col("kind") == "Promise") & (status == "eligible")).alias("eligible"), F.count_if((F.col("kind") == "Promise") & status.isin("eligible", "hypothetical")).alias("open_promises"))
    return nodes.join(F.broadcast(e.agg(F.count("*").alias("edges"))))


def graph_read_model(g: Graph, most: int = 500, as_of: int | None = None) -> DataFrame:
    """The first nodes by story time, kind and id, with tags and the edges they have among them."""
    when = F.coalesce("story_from", "reveal_at")
    n = g.live_node.where(revealed(as_of)).select("id", "kind", "title", when.alias("told")).orderBy(F.col("told").asc_nulls_last(), "kind", "id").limit(most)
    tags = g.node_tag.groupBy(F.col("node").alias("id")).agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    e = g.live_edge.where(begun(as_of)).select("src", "dst").join(n.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("links"))
    out = n.join(tags, "id", "left").join(e, "id", "left")
    return out.select("id", "kind", "title", "told", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("links", F.lit(0)).alias("links"))


def rollup_response(rows: DataFrame, digits: int = 2) -> DataFrame:
    """rows (kind, id) -> kind, part, ids sorted, n: what is left of an answer that is too long, in parts by a hash of the id.

    digits: hexadecimal digits that name a part, so lists stay short for large kinds."""
    part = F.substring(F.md5("id"), 1, digits).alias("part")
    return rows.groupBy("kind", part).agg(F.sort_array(F.collect_set("id")).alias("ids"), F.countDistinct("id").alias("n"))


def proposal_state() -> F.Column:
    """Label of a proposal from n_conflicts and risk."""
    return F.when(F.col("n_conflicts") > 0, "bad").when(F.col("risk") == "auto", "ok").when(F.col("risk") == "review", "warn").otherwise("bad")


def ced_by_model(g: Graph, touched: DataFrame, findings: DataFrame) -> DataFrame:
    """touched (model, scene), findings (fingerprint, node) -> model, scenes, findings a 10,000 words.

    Equal word counts of different scenes count once, as in the view this stands for."""
    words = g.node.where("kind = 'Scene'").select(F.col("id").alias("scene"), prop("word_count").cast("long").alias("words"))
    t = touched.distinct().join(words, "scene")
    base = t.groupBy("model").agg(F.sum_distinct("words").alias("words"), F.countDistinct("scene").alias("scenes"))
    found = t.join(findings.select("fingerprint", F.col("node").alias("scene")), "scene").groupBy("model").agg(F.countDistinct("fingerprint").alias("n"))
    out = base.join(found, "model", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("model", "scenes", F.bround(F.col("n") * 10000.0 / F.nullif(F.col("words"), F.lit(0)), 6).alias("ced"))


def open_diag_counts(findings: DataFrame) -> DataFrame:
    """findings (rule, nodes) -> node, n."""
    return findings.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("n"))


#: Columns of node_detail after id and section.
_LINE = {
    "kind": "string", "layer": "string", "title": "string", "summary": "string", "rev": "int", "props": "string", "story_from": "int", "story_to": "int", "reveal_at": "int", "origin": "string", "locked": "boolean", "cid": "string",
    "n_in": "bigint", "n_out": "bigint", "n_soft": "bigint", "item": "string", "value": "string", "hard": "boolean", "derived_from": "int", "tx_from": "timestamp", "tx_to": "timestamp",
}


def _lines(df: DataFrame, section: str | F.Column, **of) -> DataFrame:
    """Lines of one section; columns of that name or what is given, the rest null."""
    return df.select("id", (F.lit(section) if isinstance(section, str) else section).alias("section"), *(of.get(c, F.lit(None)).cast(t).alias(c) for c, t in _LINE.items()))


def _counted(g: Graph) -> DataFrame:
    """id, n_in, n_out, n_soft of all ends of live edges."""
    e = g.live_edge.select("src", "dst", "hard")
    ends = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), "hard").unionAll(e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), "hard"))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count_if(~F.col("hard")).alias("n_soft"))


def node_detail(g: Graph, kinds: DataFrame | None = None, cids: DataFrame | None = None, revisions: DataFrame | None = None, bodies: DataFrame | None = None, most: int = 50) -> DataFrame:
    """The page of each live node of a public kind, in lines, so no row holds a list: id, section and the columns of _LINE.

    kinds (kind, layer, internal), cids (id, cid), revisions (node, rev, field, proposal, tx_from), bodies (node, body).  Sections: the node itself
    with how it is referred to (soft edges included), alias, tag, viewer, span, body, in and out (references whose other end is live and public,
    with its kind and title), and revision: the newest ``most`` with field and proposal.  Without kinds: id, kind, n_in, n_out, n_soft of each live node.

    Counted and joined in as many tasks as there are rows for, so what one task holds does not follow the input."""
    spark = g.node.sparkSession
    if kinds is None:
        out = g.live_node.select("id", "kind").join(_counted(g), "id", "left")
        out = out.select("id", "kind", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_in", "n_out", "n_soft")))
        with tasks_for(spark, g.live_node.count()):
            return cut(out)
    public = g.live_node.join(F.broadcast(kinds.where("not internal").select("kind", "layer")), "kind")
    known = public.select("id")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_in", "n_out", "n_soft")}
    own = ("kind", "layer", "title", "summary", "rev", "props", "story_from", "story_to", "reveal_at", "origin", "locked", "cid", "tx_from")
    parts = [_lines(public.join(_counted(g), "id", "left").join(cids, "id", "left"), "node", **{c: F.col(c) for c in own}, **counts)]
    at = F.concat_ws(":", F.coalesce(F.col("learned_at").cast("string"), F.lit("-")), "pathway")
    span = F.concat_ws(":", F.col("start_off").cast("string"), F.col("end_off").cast("string"))
    sides = [(g.node_alias, "node", "alias", {"item": F.col("alias")}), (g.node_tag, "node", "tag", {"item": F.col("tag")}), (g.visibility, "fact", "viewer", {"item": F.col("viewer"), "value": at}), (g.evidence, "node", "span", {"item": F.col("file"), "value": span})]
    for side, key, section, of in [*sides, (bodies, "node", "body", {"value": F.col("body")})]:
        parts.append(_lines(side.withColumnRenamed(key, "id").join(known, "id", "left_semi"), section, **of))
    ends = [public.select(F.col("id").alias(end), F.col("kind").alias(f"{end}_kind"), F.col("title").alias(f"{end}_title")) for end in ("src", "dst")]
    e = g.live_edge.select("src", "dst", "rel", "hard", "story_from", "story_to").join(ends[0], "src").join(ends[1], "dst")
    way = [F.struct(F.lit(section).alias("way"), F.col(here).alias("id"), F.col(there).alias("item"), F.col(f"{there}_kind").alias("kind"), F.col(f"{there}_title").alias("title")) for section, here, there in (("in", "dst", "src"), ("out", "src", "dst"))]
    refs = e.select(F.explode(F.array(*way)).alias("x"), "rel", "hard", "story_from", "story_to").select("x.*", F.col("rel").alias("value"), "hard", "story_from", "story_to")
    parts.append(_lines(refs, F.col("way"), **{c: F.col(c) for c in refs.columns if c in _LINE}))
    past = history(revisions, most).withColumnRenamed("node", "id").join(known, "id", "left_semi")
    parts.append(_lines(past, "revision", rev=F.col("rev"), item=F.col("proposal"), value=F.coalesce("field", F.lit("*")), derived_from=F.col("derived_from"), tx_from=F.col("tx_from"), tx_to=F.col("tx_to")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    with tasks_for(spark, g.live_node.count() + g.live_edge.count()):
        return cut(out)
