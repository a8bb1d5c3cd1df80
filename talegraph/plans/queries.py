"""The registered queries: every operator over the whole projected tables, with check SQL where SQL says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import KINDS_SQL, POLICIES_SQL, RELS_SQL, RULES_SQL, kind_dim, rel_dim, rule_dim
from ..functions.columns import MARKED, PLAIN, prop
from ..operators import apply, cascade, commit, editlog, ingest, payload, projections, reads, rules, search, traverse, versions
from ..sources import corpus
from ..streaming import grants, leases
from .retail import checked, graph, source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **views: str):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = checked(sql, **views)
        return f

    return put


def joined(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


# --- the edit log, from events -------------------------------------------------------------
_N = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
OPS_SQL = (
    "SELECT 'p' || CAST(user_id AS STRING) || '-' || CAST(day(ts) AS STRING) AS proposal, CAST(row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS INT) AS seq, "
    "CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'purchase' THEN 'UPDATE' WHEN 'click' THEN 'LINK' WHEN 'view' THEN 'UNLINK' ELSE 'INVALIDATE' END AS verb, "
    "CASE WHEN event_type = 'signup' THEN 'concept/e' || CAST(event_id AS STRING) ELSE 'character/c' || CAST(user_id AS STRING) END AS target, "
    f"CASE WHEN event_type = 'purchase' THEN CASE WHEN {_N} % 4 = 0 THEN 'props.segment' ELSE 'props.f' || CAST({_N} % 4 AS STRING) END WHEN event_type IN ('click', 'view') THEN CASE WHEN {_N} % 5 = 0 THEN 'mentioned_in' ELSE 'ally_of' END END AS field, "
    f"CASE WHEN event_type = 'purchase' THEN CAST({_N} AS STRING) WHEN event_type IN ('click', 'view') AND {_N} % 9 <> 0 THEN 'character/c' || CAST(user_id + 1 AS STRING) END AS to_val, "
    "CAST(CASE WHEN event_type = 'signup' THEN NULL ELSE 1 + event_id % 2 END AS INT) AS basis_rev, 'idem-key-' || CAST(CASE WHEN event_id % 50 = 7 THEN event_id - 7 ELSE event_id END AS STRING) AS idem_key, ts FROM @events"
)
READS_SQL = (
    "SELECT DISTINCT 'p' || CAST(user_id AS STRING) || '-' || CAST(day(ts) AS STRING) AS proposal, 'character/c' || CAST(user_id AS STRING) AS node, CAST(1 + day(ts) % 3 AS INT) AS rev FROM @events WHERE day(ts) % 7 <> 0"
    " UNION ALL SELECT DISTINCT 'p' || CAST(user_id AS STRING) || '-' || CAST(day(ts) AS STRING), 'character/c' || CAST(user_id + 1 AS STRING), CAST(1 AS INT) FROM @events WHERE day(ts) % 3 <> 0"
)
LOG = {"ops": OPS_SQL, "reads": READS_SQL}


def ops(spark, sf):
    return source(spark, sf, OPS_SQL)


def read_set(spark, sf):
    return source(spark, sf, READS_SQL)


def _cid_side(table: str, key: str, parts: str) -> str:
    """Hashes in parts of one side table, as content_cid has them."""
    listed = "CAST(to_json([" + ", ".join(f"coalesce(CAST({p} AS VARCHAR), '-')" for p in parts.split()) + "]) AS VARCHAR)"
    return f"(SELECT id, string_agg(p || h, ',' ORDER BY p || h) AS x FROM (SELECT id, p, md5(string_agg(x, ',' ORDER BY x)) AS h FROM (SELECT id, x, substr(md5(x), 1, 2) AS p FROM (SELECT {key} AS id, {listed} AS x FROM {table}) z) y GROUP BY id, p) w GROUP BY id)"


_CID_SIDES = [("node_alias", "node", "alias"), ("node_tag", "node", "tag"), ("live_edge", "src", "rel dst"), ("visibility", "fact", "viewer learned_at pathway"), ("evidence", "node", "file start_off end_off")]
_CID = (
    "SELECT n.id, sha256(CAST(to_json([" + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in ("n.id", "kind", "title", "summary", "props", "story_from", "story_to", "reveal_at", "locked", *(f"s{i}.x" for i in range(len(_CID_SIDES)))))
    + "]) AS VARCHAR)) AS cid FROM live_node n" + "".join(f" LEFT JOIN {_cid_side(*side)} s{i} ON s{i}.id = n.id" for i, side in enumerate(_CID_SIDES))
)


# --- reads ------------------------------------------------------------------------------------
@query("live_node", "SELECT id, kind, title, rev FROM live_node")
def _(spark, sf):
    return graph(spark, sf).live_node.select("id", "kind", "title", "rev")


@query("live_edge", "SELECT src, dst, rel, hard FROM live_edge")
def _(spark, sf):
    return graph(spark, sf).live_edge.select("src", "dst", "rel", "hard")


@query("as_of_node", "SELECT id, kind, reveal_at FROM live_node WHERE reveal_at IS NULL OR reveal_at <= 20")
def _(spark, sf):
    return reads.as_of_node(graph(spark, sf), 20).select("id", "kind", "reveal_at")


ASKED = "SELECT CAST(o_orderkey AS BIGINT) AS pos, 'scene/o' || CAST(o_orderkey AS STRING) AS id FROM @orders UNION ALL SELECT CAST(c_custkey AS BIGINT) + 10000000, 'character/c' || CAST(c_custkey AS STRING) FROM @customer"


@query("get_brief", "SELECT pos, id, kind, title, summary, rev FROM asked JOIN live_node USING (id) WHERE reveal_at IS NULL OR reveal_at <= 60", asked=ASKED)
def _(spark, sf):
    return reads.get_brief(graph(spark, sf), source(spark, sf, ASKED), 60)


# facts have viewers and spans, characters aliases and tags
FULL_ASKED = ASKED + " UNION ALL SELECT CAST(event_id AS BIGINT) + 20000000, 'fact/e' || CAST(event_id AS STRING) FROM @events"


@query(
    "get_full",
    f"""SELECT a.pos, a.id, n.kind, n.title, n.summary, n.rev, n.props, n.story_from, n.story_to, n.reveal_at, n.origin, n.locked, cids.cid,
    coalesce(array_to_string((SELECT list(alias ORDER BY alias) FROM node_alias x WHERE x.node = a.id), ','), '') AS aliases,
    coalesce(array_to_string((SELECT list(tag ORDER BY tag) FROM node_tag x WHERE x.node = a.id), ','), '') AS tags,
    coalesce(array_to_string((SELECT list(v ORDER BY v) FROM (SELECT fact, viewer || ':' || coalesce(CAST(learned_at AS VARCHAR), '-') || ':' || pathway AS v FROM visibility) x WHERE x.fact = a.id), ','), '') AS visible_to,
    coalesce(array_to_string((SELECT list(v ORDER BY v) FROM (SELECT node, file || ':' || CAST(start_off AS VARCHAR) || ':' || CAST(end_off AS VARCHAR) AS v FROM evidence) x WHERE x.node = a.id), ','), '') AS spans
    FROM asked a JOIN live_node n ON a.id = n.id JOIN ({_CID}) cids ON cids.id = a.id""",
    asked=FULL_ASKED,
)
def _(spark, sf):
    g = graph(spark, sf)
    out = reads.get_full(g, source(spark, sf, FULL_ASKED), cids=editlog.content_cid(g))
    return out.select("pos", "id", "kind", "title", "summary", "rev", "props", "story_from", "story_to", "reveal_at", "origin", "locked", "cid", *map(joined, ("aliases", "tags", "visible_to", "spans")))


@query(
    "refs",
    """SELECT e.dst AS id, e.rel, e.src AS other, n.title, e.hard, 'in' AS direction FROM asked a JOIN live_edge e ON e.dst = a.id JOIN live_node n ON n.id = e.src
    WHERE (e.story_from IS NULL OR e.story_from <= 40) AND (n.reveal_at IS NULL OR n.reveal_at <= 40)
    UNION ALL SELECT e.src, e.rel, e.dst, n.title, e.hard, 'out' FROM asked a JOIN live_edge e ON e.src = a.id JOIN live_node n ON n.id = e.dst
    WHERE (e.story_from IS NULL OR e.story_from <= 40) AND (n.reveal_at IS NULL OR n.reveal_at <= 40)""",
    asked=ASKED,
)
def _(spark, sf):
    return reads.refs(graph(spark, sf), source(spark, sf, ASKED), "both", include_soft=True, as_of=40)


@query("filter_all_tags", "SELECT node AS id FROM node_tag WHERE tag IN ('rich', 'MACHINERY') GROUP BY node HAVING count(DISTINCT tag) = 2")
def _(spark, sf):
    return reads.with_all_tags(graph(spark, sf), ["rich", "MACHINERY"])


@query("internal_filter", f"SELECT n.kind, count(*) AS n FROM live_node n JOIN ({KINDS_SQL}) k ON n.kind = k.kind WHERE NOT k.internal GROUP BY n.kind")
def _(spark, sf):
    return reads.public_nodes(graph(spark, sf), kind_dim(spark)).groupBy("kind").agg(F.count("*").alias("n"))


@query("schema_catalog", f"SELECT tag AS name, 'tag' AS section, count(*) AS n FROM node_tag GROUP BY tag UNION ALL SELECT r.rel, 'edge', count(e.src) FROM ({RELS_SQL}) r LEFT JOIN live_edge e ON e.rel = r.rel GROUP BY r.rel UNION ALL SELECT k.kind, 'kind', count(n.id) FROM ({KINDS_SQL}) k LEFT JOIN live_node n ON n.kind = k.kind GROUP BY k.kind")
def _(spark, sf):
    g = graph(spark, sf)
    tags = g.node_tag.groupBy(F.col("tag").alias("name")).agg(F.count("*").alias("n"))
    edges = rel_dim(spark).select(F.col("rel").alias("name")).join(g.live_edge.groupBy(F.col("rel").alias("name")).agg(F.count("*").alias("n")), "name", "left")
    kinds = kind_dim(spark).select(F.col("kind").alias("name")).join(g.live_node.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")), "name", "left")
    parts = [df.select("name", F.lit(s).alias("section"), F.coalesce("n", F.lit(0)).alias("n")) for df, s in ((tags, "tag"), (edges, "edge"), (kinds, "kind"))]
    return parts[0].union(parts[1]).union(parts[2])


REFS_ASKED = "SELECT DISTINCT ref FROM (SELECT c_name AS ref FROM @customer UNION ALL SELECT 'alias-' || CAST(c_custkey AS STRING) FROM @customer UNION ALL SELECT 'c' || CAST(c_custkey AS STRING) FROM @customer UNION ALL SELECT 'promise/p' || CAST(p_partkey AS STRING) FROM @part UNION ALL SELECT DISTINCT p_name FROM @part UNION ALL SELECT n_name FROM @nation) q"


@query(
    "address_resolve",
    """WITH nodes AS (SELECT id, lower(id) AS lid, lower(regexp_extract(id, '[^/]*$')) AS tail, lower(title) AS lt FROM live_node),
    al AS (SELECT node AS id, lower(alias) AS la FROM node_alias WHERE node IN (SELECT id FROM live_node)), want AS (SELECT ref, lower(ref) AS key FROM asked),
    exact AS (SELECT ref, id, 0 AS tier FROM want JOIN nodes ON key = lid UNION ALL SELECT ref, id, 1 FROM want JOIN nodes ON key = tail UNION ALL SELECT ref, id, 2 FROM want JOIN nodes ON key = lt UNION ALL SELECT ref, id, 3 FROM want JOIN al ON key = la),
    rest AS (SELECT * FROM want WHERE ref NOT IN (SELECT ref FROM exact)),
    every AS (SELECT * FROM exact UNION ALL SELECT ref, id, 4 FROM rest JOIN nodes ON ends_with(tail, key) OR ends_with(lt, key) UNION ALL SELECT ref, id, 5 FROM rest JOIN al ON contains(la, key) UNION ALL SELECT ref, id, 6 FROM rest JOIN nodes ON contains(lt, key)),
    hits AS (SELECT ref, id, min(tier) AS tier FROM every GROUP BY ref, id), best AS (SELECT ref, min(tier) AS tier FROM hits GROUP BY ref),
    found AS (SELECT h.ref, h.tier, count(*) AS n, min(h.id) AS id FROM hits h JOIN best b ON h.ref = b.ref AND h.tier = b.tier GROUP BY h.ref, h.tier)
    SELECT w.ref, CASE WHEN f.n IS NULL THEN 'missing' WHEN f.n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN f.n = 1 THEN f.id END AS id, f.tier FROM want w LEFT JOIN found f ON w.ref = f.ref""",
    asked=REFS_ASKED,
)
def _(spark, sf):
    return reads.address_resolve(graph(spark, sf), source(spark, sf, REFS_ASKED))


PARSE_ASKED = "SELECT 'story://Character/C' || CAST(c_custkey AS STRING) AS ref FROM @customer UNION ALL SELECT 'scene/../o' || CAST(c_custkey AS STRING) FROM @customer UNION ALL SELECT 'PROMISE/p?' || CAST(c_custkey AS STRING) FROM @customer UNION ALL SELECT c_name FROM @customer"


@query(
    "address_parse",
    f"""SELECT ref, CASE WHEN k.kind IS NOT NULL AND contains(bare, '/') THEN lower(head) || substr(bare, length(head) + 1) ELSE bare END AS canonical,
    NOT (regexp_matches(bare, '[?#\\\\]') OR list_contains(string_split(bare, '/'), '') OR list_contains(string_split(bare, '/'), '.') OR list_contains(string_split(bare, '/'), '..')) AS valid
    FROM (SELECT ref, regexp_replace(ref, '^story://', '') AS bare, split_part(regexp_replace(ref, '^story://', ''), '/', 1) AS head FROM asked) q LEFT JOIN ({KINDS_SQL}) k ON lower(k.kind) = lower(head)""",
    asked=PARSE_ASKED,
)
def _(spark, sf):
    return reads.address_parse(source(spark, sf, PARSE_ASKED), kind_dim(spark))


@query("query_sql", "SELECT kind, count(*) AS n, min(story_from) AS first FROM live_node WHERE story_from >= 10 OR story_from IS NULL GROUP BY kind")
def _(spark, sf):
    return reads.query_sql(graph(spark, sf), "SELECT kind, count(*) AS n, min(story_from) AS first FROM live_node WHERE story_from >= :t OR story_from IS NULL GROUP BY kind", t=10)


# --- traversal ----------------------------------------------------------------------------------
WALK = """WITH RECURSIVE w(run, id, depth) AS (SELECT id, id, 0 FROM live_node WHERE kind = 'Location' UNION SELECT w.run, e.dst, w.depth + 1 FROM w JOIN live_edge e ON e.src = w.id
 WHERE e.hard AND e.rel = 'contains' AND w.depth < 3) SELECT run, id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY run, id"""


@query("reach", WALK)
def _(spark, sf):
    g = graph(spark, sf)
    return traverse.walk(g, g.live_node.where("kind = 'Location'").select(F.col("id").alias("run"), "id"), rels=["contains"], most=3)


@query(
    "outline",
    """WITH RECURSIVE roots AS (SELECT id FROM live_node WHERE id NOT IN (SELECT dst FROM live_edge WHERE rel = 'contains')),
    w(id, depth) AS (SELECT id, 0 FROM roots UNION SELECT e.dst, w.depth + 1 FROM w JOIN live_edge e ON e.src = w.id WHERE e.hard AND e.rel = 'contains' AND w.depth < 3)
    SELECT n.id, n.kind, n.title, n.story_from, CAST(min(w.depth) AS INT) AS depth FROM w JOIN live_node n ON n.id = w.id WHERE n.kind IN ('Location', 'Character', 'Scene') GROUP BY n.id, n.kind, n.title, n.story_from""",
)
def _(spark, sf):
    return traverse.outline(graph(spark, sf), 3, ["Location", "Character", "Scene"]).select("id", "kind", "title", "story_from", "depth")


@query(
    "scope_descendants",
    """WITH RECURSIVE w(run, id) AS (SELECT id, id FROM live_node WHERE kind = 'Location' UNION SELECT w.run, e.dst FROM w JOIN live_edge e ON e.src = w.id WHERE e.rel = 'contains') SELECT run, count(*) AS n FROM w GROUP BY run""",
)
def _(spark, sf):
    g = graph(spark, sf)
    return traverse.scope_descendants(g, g.live_node.where("kind = 'Location'").select(F.col("id").alias("run"), "id")).groupBy("run").agg(F.count("*").alias("n"))


@query(
    "impact",
    """WITH RECURSIVE w(run, id, depth) AS (SELECT id, id, 0 FROM live_node WHERE kind = 'Promise' UNION SELECT w.run, e.src, w.depth + 1 FROM w JOIN live_edge e ON e.dst = w.id WHERE e.hard AND w.depth < 3),
    f AS (SELECT run, id, min(depth) AS depth FROM w GROUP BY run, id)
    SELECT f.run, count(*) AS affected, CAST(max(depth) AS INT) AS max_depth, CAST(sum(greatest(1, (length(title) + length(n.id) + length(kind)) // 4)) AS BIGINT) AS tokens FROM f JOIN live_node n ON n.id = f.id GROUP BY f.run""",
)
def _(spark, sf):
    g = graph(spark, sf, True)
    return traverse.impact(g, g.live_node.where("kind = 'Promise'").select(F.col("id").alias("run"), "id")).drop("cyclic")


TRACE_ASKED = "SELECT 'location/r' || CAST(n_regionkey AS STRING) AS source, 'scene/o' || CAST(o_orderkey AS STRING) AS target FROM @orders JOIN @customer ON o_custkey = c_custkey JOIN @nation ON c_nationkey = n_nationkey"


@query(
    "trace",
    """SELECT source, target, CAST(1 AS INT) AS n, '["' || source || '","' || e1.dst || '","' || e2.dst || '","' || target || '"]' AS path, CAST(3 AS INT) AS depth FROM asked
    JOIN live_edge e1 ON e1.src = source AND e1.rel = 'contains' AND e1.hard JOIN live_edge e2 ON e2.src = e1.dst AND e2.rel = 'contains' AND e2.hard JOIN live_edge e3 ON e3.src = e2.dst AND e3.dst = target AND e3.rel = 'contains' AND e3.hard""",
    asked=TRACE_ASKED,
)
def _(spark, sf):
    out = traverse.trace(graph(spark, sf), source(spark, sf, TRACE_ASKED), rels=["contains"], most=4)
    return out.select("source", "target", "n", F.to_json("path").alias("path"), "depth")


@query(
    "would_cycle",
    """WITH RECURSIVE asked AS (SELECT dst || '>' || src AS run, dst AS src, src AS dst FROM live_edge WHERE rel = 'contains' AND src LIKE 'location/r%'), w(run, id) AS (SELECT run, dst FROM asked UNION SELECT w.run, e.dst FROM w JOIN live_edge e ON e.src = w.id WHERE e.rel = 'contains')
    SELECT a.run, EXISTS (SELECT 1 FROM w WHERE w.run = a.run AND w.id = a.src) AS cycle FROM asked a""",
)
def _(spark, sf):
    g = graph(spark, sf)
    e = g.live_edge.where("rel = 'contains' and src like 'location/r%'")
    return traverse.would_cycle(g, e.select(F.concat_ws(">", "dst", "src").alias("run"), F.col("dst").alias("src"), F.col("src").alias("dst"), "rel"))


@query(
    "acyclic_check",
    """WITH RECURSIVE step AS (SELECT DISTINCT rel, src, dst FROM live_edge WHERE rel IN ('contains', 'extends', 'causes')), far(rel, a, b) AS (SELECT rel, src, dst FROM step UNION SELECT far.rel, far.a, step.dst FROM far JOIN step ON step.rel = far.rel AND step.src = far.b)
    SELECT rel, count(DISTINCT b) AS stuck_nodes FROM far WHERE (rel, a) IN (SELECT (rel, a) FROM far WHERE a = b) GROUP BY rel""",
)
def _(spark, sf):
    return traverse.acyclic_check(graph(spark, sf), rel_dim(spark))


@query("max_per_dst_check", "SELECT rel, dst, count(*) AS n FROM live_edge WHERE rel = 'focalizes' GROUP BY rel, dst HAVING count(*) > 1")
def _(spark, sf):
    return traverse.max_per_dst_check(graph(spark, sf), rel_dim(spark))


SESSIONS = "SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS src, CAST(conv_id AS STRING) || '-' || CAST(turn - 1 AS STRING) AS dst FROM @conversations WHERE turn > 0"


@query(
    "lineage_branch",
    "WITH RECURSIVE w(run, id, depth) AS (SELECT src, src, 0 FROM sessions UNION SELECT w.run, s.dst, w.depth + 1 FROM w JOIN sessions s ON s.src = w.id) SELECT run, CAST(max(depth) AS INT) AS depth, count(*) AS n FROM w GROUP BY run",
    sessions=SESSIONS,
)
def _(spark, sf):
    e = source(spark, sf, SESSIONS)
    return traverse.reach(e, e.select(F.col("src").alias("run"), F.col("src").alias("id"))).groupBy("run").agg(F.max("depth").alias("depth"), F.count("*").alias("n"))


@query("neighborhood")
def _(spark, sf):
    g = graph(spark, sf)
    seeds = g.live_node.where("kind = 'Promise'").select(F.col("id").alias("run"), "id", F.lit(1.0).alias("score"))
    out = search.neighborhood(g, seeds, 60)
    return out.select("run", joined("packed"), "dropped", "tokens")


# --- rules --------------------------------------------------------------------------------------
_X = "json_extract_string(props, '$.{}')"
_FACT = "SELECT id, json_extract_string(props, '$.subject') AS s, json_extract_string(props, '$.predicate') AS p, json_extract(props, '$.object')::VARCHAR AS o, coalesce(story_from, -2147483648) AS f, coalesce(story_to, 2147483647) AS t FROM live_node WHERE kind = 'Fact'"
_CLAIMS = "SELECT id, story_from, json_extract_string(c, '$.speaker') AS speaker, json_extract_string(c, '$.fact') AS fact FROM (SELECT id, story_from, unnest(json_extract(props, '$.claims[*]')) AS c FROM live_node WHERE kind = 'Scene') q"
RULE_SQL = {
    "timeline.absolute": f"WITH fx AS ({_FACT}) SELECT a.id AS node, b.id || ',' || a.s AS related, 'different absolute times' AS detail FROM fx a JOIN fx b ON a.s = b.s AND a.p = b.p AND a.id < b.id WHERE a.p = 'absolute_time' AND a.o <> b.o AND a.t >= b.f AND b.t >= a.f",
    "timeline.simultaneity": """WITH sc AS (SELECT s.id, p.dst AS person, l.dst AS place, coalesce(s.story_from, -2147483648) AS f, coalesce(s.story_to, s.story_from, 2147483647) AS t FROM live_node s JOIN live_edge p ON p.src = s.id AND p.rel = 'present_at' JOIN live_edge l ON l.src = s.id AND l.rel = 'occurs_at' WHERE s.kind = 'Scene')
        SELECT a.id AS node, b.id || ',' || a.person || ',' || a.place || ',' || b.place AS related, 'one person in two places' AS detail FROM sc a JOIN sc b ON a.person = b.person AND a.id < b.id AND a.place <> b.place AND a.t >= b.f AND b.t >= a.f""",
    "plot.causeless": "SELECT id AS node, '' AS related, 'a cause is expected and none comes in' AS detail FROM live_node WHERE kind IN ('Scene', 'Event') AND json_extract_string(props, '$.expect_cause') IN ('true', '1') AND id NOT IN (SELECT dst FROM live_edge WHERE rel = 'causes')",
    "plot.abandoned": "SELECT id AS node, '' AS related, 'a promise left hypothetical' AS detail FROM live_node WHERE kind = 'Promise' AND coalesce(json_extract_string(props, '$.status'), 'hypothetical') = 'hypothetical'",
    "character.memory": f"WITH cl AS ({_CLAIMS}) SELECT c.id AS node, c.speaker || ',' || c.fact AS related, 'spoken before it was learned' AS detail FROM cl c JOIN visibility v ON v.fact = c.fact AND v.viewer = c.speaker WHERE v.learned_at IS NOT NULL AND (c.story_from IS NULL OR v.learned_at > c.story_from)",
    "character.knowledge": f"WITH cl AS ({_CLAIMS}) SELECT c.id AS node, c.speaker || ',' || c.fact AS related, 'spoken by one who does not know it' AS detail FROM cl c WHERE NOT EXISTS (SELECT 1 FROM visibility v WHERE v.fact = c.fact AND v.viewer = c.speaker)",
    "world.core_rule": """WITH post AS (SELECT id, unnest(json_extract(props, '$.post[*]')) AS v FROM live_node WHERE kind = 'Scene'), forbid AS (SELECT id, unnest(json_extract(props, '$.forbid[*]')) AS v FROM live_node WHERE kind = 'Rule' AND locked)
        SELECT p.id AS node, f.id AS related, 'a scene does what a locked rule forbids' AS detail FROM post p JOIN forbid f ON json_extract_string(p.v, '$.subject') = json_extract_string(f.v, '$.subject') AND json_extract_string(p.v, '$.field') = json_extract_string(f.v, '$.field')
        AND coalesce(json_extract_string(p.v, '$.op'), 'eq') = coalesce(json_extract_string(f.v, '$.op'), 'eq') AND json_extract(p.v, '$.value')::VARCHAR = json_extract(f.v, '$.value')::VARCHAR""",
    "detail.appearance": f"""WITH fx AS ({_FACT}), pairs AS (SELECT least(a.id, b.id) AS node, greatest(a.id, b.id) AS other, a.s FROM fx a, fx b WHERE a.id < b.id AND (a.s, a.p) = (b.s, b.p) AND a.p <> 'absolute_time' AND a.o IS DISTINCT FROM b.o AND greatest(a.f, b.f) <= least(a.t, b.t)),
        deaths AS (SELECT id AS node, s AS who, f AS died FROM fx WHERE p = 'life_state' AND o = '"dead"' AND f > -2147483648), seen AS (SELECT e.dst AS who, n.id AS scene, n.story_from AS told FROM live_edge e, live_node n WHERE e.rel = 'present_at' AND n.id = e.src AND n.kind = 'Scene')
        SELECT node, other || ',' || s AS related, 'one property, overlapping times, different values' AS detail FROM pairs UNION ALL SELECT node, scene || ',' || who, 'seen again after death' FROM deaths JOIN seen USING (who) WHERE told > died""",
    "detail.nomenclature": """WITH registered AS (SELECT id AS entity, title AS name FROM live_node UNION SELECT node, alias FROM node_alias), said AS (SELECT id, m->>'$.entity' AS entity, m->>'$.name' AS name FROM (SELECT id, unnest(json_extract(props, '$.mentions[*]')) AS m FROM live_node WHERE kind = 'Scene') q)
        SELECT id AS node, entity AS related, 'unregistered name: ' || name AS detail FROM (FROM said SEMI JOIN (SELECT id AS entity FROM live_node) known USING (entity)) s ANTI JOIN registered USING (entity, name)""",
    "narrative.perspective": """WITH seen AS (SELECT dst AS id, list(src ORDER BY src) AS who FROM live_edge WHERE rel = 'focalizes' GROUP BY dst), scenes AS (SELECT id FROM live_node WHERE kind = 'Scene')
        SELECT id AS node, coalesce(array_to_string(who, ','), '') AS related, 'focalizing edges: ' || CAST(coalesce(len(who), 0) AS VARCHAR) AS detail FROM scenes LEFT JOIN seen USING (id) WHERE coalesce(len(who), 0) <> 1""",
    "promise.unearned": """WITH paid AS (SELECT dst AS id, list(src ORDER BY src) AS scenes FROM live_edge WHERE rel = 'pays_off' GROUP BY dst), open AS ((SELECT id FROM live_node WHERE kind = 'Promise' INTERSECT SELECT id FROM paid) EXCEPT SELECT src FROM live_edge WHERE rel = 'requires_trigger')
        SELECT id AS node, array_to_string(scenes, ',') AS related, 'paid off without a trigger' AS detail FROM open JOIN paid USING (id)""",
    "promise.premature": """WITH ends AS (SELECT CASE rel WHEN 'pays_off' THEN dst ELSE src END AS promise, CASE rel WHEN 'pays_off' THEN src ELSE dst END AS scene, rel FROM live_edge WHERE rel IN ('pays_off', 'requires_trigger')), dated AS (SELECT promise, scene, rel, story_from AS t FROM ends JOIN (SELECT id AS scene, story_from FROM live_node) w USING (scene) WHERE story_from IS NOT NULL AND promise IN (SELECT id FROM live_node WHERE kind = 'Promise'))
        SELECT promise AS node, paid.scene || ',' || due.scene AS related, 'paid off before its trigger' AS detail FROM (FROM dated WHERE rel = 'pays_off') paid JOIN (FROM dated WHERE rel = 'requires_trigger') due USING (promise) WHERE due.t > paid.t""",
    "graph.causal_cycle": """WITH RECURSIVE step AS (SELECT DISTINCT src, dst FROM live_edge WHERE rel = 'causes'), far(a, b) AS (SELECT src, dst FROM step UNION SELECT far.a, step.dst FROM far JOIN step ON step.src = far.b)
        SELECT a AS node, a AS related, 'a cycle of causes' AS detail FROM far WHERE a = b""",
    "graph.unreachable": """WITH RECURSIVE ev AS (SELECT id, list_contains(['true', '1'], props->>'$.is_start') AS s, list_contains(['true', '1'], props->>'$.is_end') AS e FROM live_node WHERE kind IN ('Scene', 'Event')), step AS (SELECT 'on' AS way, src AS a, dst AS b FROM live_edge WHERE rel = 'causes' UNION ALL SELECT 'back', dst, src FROM live_edge WHERE rel = 'causes'),
        hit(way, id) AS (SELECT * FROM (SELECT 'on', id FROM ev WHERE s UNION ALL SELECT 'back', id FROM ev WHERE e) seeds UNION SELECT hit.way, step.b FROM hit JOIN step ON step.way = hit.way AND step.a = hit.id), ways AS (SELECT id, count(*) AS n FROM hit GROUP BY id)
        SELECT ev.id AS node, '' AS related, 'not between a start and an end' AS detail FROM ev LEFT JOIN ways USING (id) WHERE coalesce(n, 0) < 2 AND EXISTS (SELECT 1 FROM ev x WHERE x.s) AND EXISTS (SELECT 1 FROM ev x WHERE x.e)""",
    "plot.causal_violation": "SELECT e.src AS node, e.dst AS related, 'an effect before its cause' AS detail FROM live_edge e JOIN live_node a ON a.id = e.src JOIN live_node b ON b.id = e.dst WHERE e.rel = 'causes' AND b.story_from < a.story_from",
    "promise.trigger_undefined": "SELECT id AS node, '' AS related, 'no trigger is defined' AS detail FROM live_node WHERE kind = 'Promise' AND json_extract(props, '$.T') IS NULL AND id NOT IN (SELECT src FROM live_edge WHERE rel = 'requires_trigger')",
    "graph.orphan_edge": "SELECT DISTINCT src AS node, dst || ',' || rel AS related, 'an end of the edge is not there' AS detail FROM live_edge WHERE src NOT IN (SELECT id FROM live_node) OR dst NOT IN (SELECT id FROM live_node)",
}


def _rule_query(name: str):
    def run(spark, sf):
        return (rules.RULES | rules.EXTRA)[name](graph(spark, sf, name in ("graph.causal_cycle", "detail.appearance"))).select("node", joined("related"), "detail")

    return run


for _name, _sql in RULE_SQL.items():
    query("rule_" + _name.replace(".", "_"), _sql)(_rule_query(_name))

@query("check", " UNION ALL ".join(f"SELECT rule, severity, count(*) AS n FROM (SELECT DISTINCT '{r}' AS rule, node, related, detail FROM ({sql}) a) b JOIN ({RULES_SQL}) c USING (rule) GROUP BY rule, severity" for r, sql in RULE_SQL.items()))
def _(spark, sf):
    return rules.check(graph(spark, sf, True), [*rules.RULES, *rules.EXTRA]).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("diag_sync", f"SELECT action, count(*) AS n FROM (SELECT CASE WHEN CAST(substr(node, 10) AS INT) % 3 = 0 THEN 'open' ELSE 'keep' END AS action FROM ({RULE_SQL['plot.abandoned']}) q UNION ALL SELECT 'resolve' FROM (SELECT DISTINCT node FROM ({RULE_SQL['promise.unearned']}) r) s) t GROUP BY action")
def _(spark, sf):
    g = graph(spark, sf)
    now = rules.check(g, ["plot.abandoned"])
    old = now.where(F.substring(F.col("nodes")[0], 10, 20).cast("int") % 3 != 0).unionByName(rules.check(g, ["promise.unearned"]))
    return rules.diag_sync(now, old.select(rules.fingerprint().alias("fingerprint"), "rule")).groupBy("action").agg(F.count("*").alias("n"))


# --- projections ------------------------------------------------------------------------------------
LEDGER = """WITH e AS (SELECT CASE WHEN rel = 'requires_trigger' THEN src ELSE dst END AS id, CASE WHEN rel = 'requires_trigger' THEN dst ELSE src END AS scene, rel FROM live_edge WHERE rel IN ('plants', 'requires_trigger', 'pays_off')),
 j AS (SELECT e.id, e.rel, e.scene, s.story_from FROM e JOIN live_node s ON s.id = e.scene AND s.kind = 'Scene'),
 f AS (SELECT id, string_agg(DISTINCT CASE WHEN rel = 'plants' THEN scene END, ',' ORDER BY CASE WHEN rel = 'plants' THEN scene END) AS F, count(CASE WHEN rel = 'plants' THEN 1 END) AS nf, count(CASE WHEN rel = 'requires_trigger' THEN 1 END) AS nt, count(CASE WHEN rel = 'pays_off' THEN 1 END) AS np,
  min(CASE WHEN rel = 'plants' THEN story_from END) AS planted_at, min(CASE WHEN rel = 'requires_trigger' THEN story_from END) AS trigger_at FROM j GROUP BY id),
 h AS (SELECT coalesce(max(story_from), 0) AS last FROM live_node),
 p AS (SELECT id, title, coalesce(json_extract_string(props, '$.status'), 'hypothetical') AS status, CAST(json_extract_string(props, '$.debt') AS DOUBLE) AS own FROM live_node WHERE kind = 'Promise')
 SELECT p.id, p.title, p.status, coalesce(f.F, '') AS F, coalesce(nf, 0) AS n_f, coalesce(nt, 0) AS n_t, coalesce(np, 0) AS n_p, planted_at, trigger_at, CAST(coalesce(greatest(0, last - planted_at), 0) AS BIGINT) AS age,
 CAST(coalesce(own, (coalesce(greatest(0, last - planted_at), 0) + 1) * CASE WHEN status = 'eligible' THEN 1.5 ELSE 1.0 END) AS DOUBLE) AS debt,
 CAST(CASE WHEN trigger_at IS NULL OR planted_at IS NULL THEN 1.0 ELSE round_even(CAST(1.0 AS DOUBLE) / (1 + greatest(0, trigger_at - planted_at)), 3) END AS DOUBLE) AS s_eff,
 CAST(CASE WHEN coalesce(nf, 0) > 0 THEN 0.5 ELSE 0 END + CASE WHEN coalesce(nt, 0) > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS delta_coh FROM p LEFT JOIN f ON p.id = f.id CROSS JOIN h"""


@query("promise_ledger", LEDGER)
def promise_ledger(spark, sf):
    out = projections.promise_ledger(graph(spark, sf))
    sizes = {f"n_{c.lower()}": F.size(c).cast("long") for c in "FTP"}
    out = out.withColumns(sizes)
    s_eff = F.when(F.col("trigger_at").isNull() | F.col("planted_at").isNull(), 1.0).otherwise(F.col("s_eff"))
    return out.select("id", "title", "status", joined("F"), *sizes, "planted_at", "trigger_at", "age", "debt", s_eff.alias("s_eff"), "delta_coh")


@query("open_promise", "SELECT id, title, json_extract_string(props, '$.status') AS status, CAST(json_extract_string(props, '$.debt') AS DOUBLE) AS debt FROM live_node WHERE kind = 'Promise' AND json_extract_string(props, '$.status') IN ('hypothetical', 'eligible')")
def _(spark, sf):
    return projections.open_promise(graph(spark, sf))


@query("promise_board", f"SELECT status, count(*) AS n, round_even(sum(debt), 6) AS debt FROM ({LEDGER}) q GROUP BY status")
def _(spark, sf):
    return projections.promise_board(graph(spark, sf))


@query("flashback", "SELECT id, kind, story_from, reveal_at, reveal_at - story_from AS gap FROM live_node WHERE story_from < reveal_at")
def _(spark, sf):
    return projections.flashback(graph(spark, sf))


@query("timeline", "SELECT id, kind, story_from, reveal_at, coalesce(story_from < reveal_at, false) AS flashback, (SELECT greatest(1, max(greatest(coalesce(story_from, 0), coalesce(story_to, 0), coalesce(reveal_at, 0)))) FROM live_node) AS max_chapter FROM live_node WHERE story_from IS NOT NULL OR reveal_at IS NOT NULL")
def _(spark, sf):
    return projections.timeline(graph(spark, sf))


VIS_ASKED = "SELECT 'fact/e' || CAST(event_id AS STRING) AS fact, 'character/c' || CAST(user_id + event_id % 2 AS STRING) AS \"character\", CAST(day(ts) + event_id % 5 AS INT) AS as_of, event_id % 2 = 0 AS spoken FROM @events"


@query(
    "visibility_classify",
    """WITH j AS (SELECT a.*, coalesce(bool_or(k AND v.viewer = 'reader'), false) AS r, coalesce(bool_or(k AND v.viewer = a."character"), false) AS c, coalesce(bool_or(k AND v.viewer <> 'reader'), false) AS o, coalesce(bool_or(v.viewer = 'reader' AND v.learned_at > a.as_of), false) AS l
    FROM asked a LEFT JOIN (SELECT *, true AS k0 FROM visibility) v ON v.fact = a.fact, LATERAL (SELECT coalesce(v.k0, false) AND (v.learned_at IS NULL OR v.learned_at <= a.as_of) AS k) z GROUP BY a.fact, a."character", a.as_of, a.spoken)
    SELECT fact, "character", as_of, spoken, r AND NOT c AS dramatic_irony, NOT r AND o AS mystery, NOT r AND l AS twist, spoken AND NOT c AS continuity_bug FROM j""",
    asked=VIS_ASKED,
)
def _(spark, sf):
    return projections.visibility_classify(graph(spark, sf), source(spark, sf, VIS_ASKED.replace('"', "`")))


@query(
    "scene_feasible",
    """WITH pre AS (SELECT id, story_from, unnest(json_extract(props, '$.pre[*]')) AS v FROM live_node WHERE kind = 'Scene'), m AS (SELECT p.id, json_extract_string(p.v, '$.op') AS op, json_extract(p.v, '$.value')::VARCHAR AS val, json_extract(s.props, '$.segment')::VARCHAR AS found FROM pre p LEFT JOIN live_node s ON s.id = json_extract_string(p.v, '$.subject') AND (s.story_from IS NULL OR p.story_from IS NULL OR s.story_from <= p.story_from)),
    b AS (SELECT id, count(*) FILTER (WHERE NOT CASE op WHEN 'eq' THEN coalesce(found = val, false) WHEN 'ne' THEN coalesce(found <> val, false) WHEN 'exists' THEN found IS NOT NULL ELSE false END) AS bad FROM m GROUP BY id)
    SELECT s.id, coalesce(bad, 0) AS failed_pre, CAST(0 AS BIGINT) AS active_forbid, coalesce(bad, 0) = 0 AS feasible FROM live_node s LEFT JOIN b ON b.id = s.id WHERE s.kind = 'Scene'""",
)
def _(spark, sf):
    return projections.scene_feasible(graph(spark, sf))


@query("agg_kind_counts", "SELECT kind, count(*) AS n FROM live_node GROUP BY kind")
def _(spark, sf):
    return projections.kind_counts(graph(spark, sf))


@query(
    "status_counts",
    "SELECT (SELECT count(*) FROM live_node) AS nodes, (SELECT count(*) FROM live_node WHERE kind = 'Promise' AND coalesce(json_extract_string(props, '$.status'), 'hypothetical') = 'eligible') AS eligible, (SELECT count(*) FROM live_node WHERE kind = 'Promise' AND coalesce(json_extract_string(props, '$.status'), 'hypothetical') IN ('eligible', 'hypothetical')) AS open_promises, (SELECT count(*) FROM live_edge WHERE src IN (SELECT id FROM live_node) AND dst IN (SELECT id FROM live_node)) AS edges",
)
def _(spark, sf):
    return projections.status_counts(graph(spark, sf), kind_dim(spark))


@query(
    "graph_read_model",
    """WITH n AS (SELECT id, kind, title, coalesce(story_from, reveal_at) AS told FROM live_node ORDER BY told NULLS LAST, kind, id LIMIT 500), t AS (SELECT node, string_agg(tag, ',' ORDER BY tag) AS tags FROM node_tag GROUP BY node), e AS (SELECT src, count(*) AS links FROM live_edge WHERE dst IN (SELECT id FROM n) GROUP BY src)
    SELECT n.id, n.kind, n.title, n.told, coalesce(t.tags, '') AS tags, coalesce(e.links, 0) AS links FROM n LEFT JOIN t ON t.node = n.id LEFT JOIN e ON e.src = n.id""",
)
def _(spark, sf):
    return projections.graph_read_model(graph(spark, sf)).withColumn("tags", F.array_join("tags", ","))


@query("rollup_response", "SELECT kind, substr(md5(id), 1, 2) AS part, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM (SELECT DISTINCT kind, id FROM live_node) q GROUP BY 1, 2")
def _(spark, sf):
    return projections.rollup_response(graph(spark, sf).live_node.select("kind", "id")).withColumn("ids", F.array_join("ids", ","))


TOUCHED = "SELECT DISTINCT 'model-' || CAST(o_custkey % 5 AS STRING) AS model, 'scene/o' || CAST(o_orderkey AS STRING) AS scene FROM @orders"


@query(
    "ced_by_model",
    f"""WITH w AS (SELECT t.model, t.scene, CAST(json_extract_string(n.props, '$.word_count') AS BIGINT) AS words FROM touched t JOIN node n ON n.id = t.scene AND n.kind = 'Scene'), d AS ({RULE_SQL["narrative.perspective"]}),
    x AS (SELECT w.model, count(DISTINCT d.node) AS n FROM w JOIN d ON d.node = w.scene GROUP BY w.model) SELECT w.model, count(DISTINCT w.scene) AS scenes, round_even(coalesce(max(x.n), 0) * CAST(10000.0 AS DOUBLE) / sum(DISTINCT words), 6) AS ced FROM w LEFT JOIN x ON x.model = w.model GROUP BY w.model""",
    touched=TOUCHED,
)
def _(spark, sf):
    g = graph(spark, sf)
    found = rules.RULES["narrative.perspective"](g).select(F.col("node").alias("fingerprint"), "node")
    return projections.ced_by_model(g, source(spark, sf, TOUCHED), found)


# --- retrieval --------------------------------------------------------------------------------------
DOCS = "SELECT doc_id AS id, text AS body FROM @documents"
BENCH_WORDS = "SELECT item_id AS q, text FROM @benchmark"


@query(
    "find_lexical",
    r"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(FOLDED, '[\p{L}\p{N}]+') AS ts FROM documents), dd AS (SELECT id, ts, ' ' || array_to_string(ts, ' ') || ' ' AS line FROM d),
    tok AS (SELECT DISTINCT item_id AS q, regexp_extract_all(FOLDED, '[\p{L}\p{N}]+') AS ph FROM (SELECT item_id, unnest(string_split_regex(text, '\s+')) AS text FROM benchmark) z), q AS (SELECT q, ph, array_to_string(ph, ' ') AS s FROM tok WHERE len(ph) > 0),
    need AS (SELECT q, count(*) AS need FROM q GROUP BY q), st AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM d), p AS (SELECT id, unnest(ts) AS term FROM d), one AS (SELECT id, term AS s, CAST(count(*) AS DOUBLE) AS f FROM p WHERE term IN (SELECT s FROM q WHERE len(ph) = 1) GROUP BY id, term),
    many AS (SELECT id, u.s, CAST(len(list_filter(range(1, len(ts) + 1), lambda i: ts[i : i + len(u.ph) - 1] = u.ph)) AS DOUBLE) AS f FROM dd JOIN (SELECT DISTINCT s, ph FROM q WHERE len(ph) > 1) u ON contains(line, ' ' || u.s || ' ')), tf AS (SELECT * FROM one UNION ALL SELECT * FROM many),
    df AS (SELECT s, count(*) AS df FROM tf GROUP BY s), s AS (SELECT q.q, tf.id, sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0.000001::DOUBLE) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ts) / av))) AS score, count(*) AS got FROM q JOIN tf ON tf.s = q.s JOIN df ON df.s = q.s JOIN d ON d.id = tf.id CROSS JOIN st GROUP BY q.q, tf.id)
    SELECT q, id, score, CAST(rank AS INT) AS rank FROM (SELECT s.q, s.id, round(s.score, 6) AS score, row_number() OVER (PARTITION BY s.q ORDER BY round(s.score, 6) DESC, s.id) AS rank FROM s JOIN need ON need.q = s.q WHERE got = need) z WHERE rank <= 20""".replace("FOLDED", f"translate(lower(text), '{MARKED}', '{PLAIN}')"),
)
def _(spark, sf):
    return search.find_lexical(source(spark, sf, DOCS), source(spark, sf, BENCH_WORDS))


NAMES = "SELECT DISTINCT p_name AS q, p_name AS text FROM @part"


@query(
    "find_name_match",
    """WITH names AS (SELECT id, lower(title) AS name FROM live_node UNION ALL SELECT id, lower(regexp_extract(id, '[^/]*$')) FROM live_node UNION ALL SELECT node, lower(alias) FROM node_alias WHERE node IN (SELECT id FROM live_node)), asked AS (SELECT DISTINCT p_name AS q, lower(trim(p_name)) AS t FROM part)
    SELECT q, id, CAST(max(CASE WHEN name = t THEN 100 ELSE 50 END) AS INT) AS score FROM names JOIN asked ON contains(name, t) GROUP BY q, id""",
)
def _(spark, sf):
    return search.find_name_match(graph(spark, sf), source(spark, sf, NAMES))


@query(
    "embed_ngram",
    """WITH t AS (SELECT id, lower(title) AS f, regexp_replace(lower(title), '\\s+', '', 'g') AS b FROM live_node), g AS (SELECT id, unnest(string_split_regex(f, '\\s+')) AS g FROM t UNION ALL SELECT id, substr(b, i, 2) FROM (SELECT id, b, unnest(range(1, length(b))) AS i FROM t) q UNION ALL SELECT id, substr(b, i, 3) FROM (SELECT id, b, unnest(range(1, length(b) - 1)) AS i FROM t) q),
    c AS (SELECT id, CAST(CAST('0x' || substr(md5(g), 1, 15) AS BIGINT) % 384 AS INT) AS dim, count(*) AS n FROM g WHERE g <> '' GROUP BY id, dim), m AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY id) SELECT c.id, c.dim, round(n / norm, 8) AS weight FROM c JOIN m ON m.id = c.id""",
)
def _(spark, sf):
    return search.embed_ngram(graph(spark, sf).live_node.select("id", F.col("title").alias("text")))


@query("knn_l2", "SELECT q, id, score, CAST(rank AS INT) AS rank FROM (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS id, round(1 / (1 + sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)))), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0) z WHERE score >= 0.440529) y WHERE rank <= 10")
def _(spark, sf):
    v = source(spark, sf, "SELECT vec_id AS id, embedding AS v FROM @embeddings")
    return search.knn_l2(v, v.where("id % 20 = 0").select(F.col("id").alias("q"), "v"))


FIND_ASKED = "SELECT 'n' || CAST(n_nationkey AS STRING) AS q, n_name || ' of' AS text FROM @nation UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), s_name FROM @supplier"


@query("find")
def _(spark, sf):
    return search.find(graph(spark, sf), source(spark, sf, FIND_ASKED), kinds=["Object", "Faction", "Character", "Location"], as_of=45, limit=10)


@query("rrf_fuse")
def _(spark, sf):
    g = graph(spark, sf)
    asked = source(spark, sf, NAMES)
    nodes = g.live_node.select("id", "title", "summary", F.col("props").alias("body"))
    return search.rrf_fuse([search.find_lexical(nodes, asked, 40), search.ranked(search.find_name_match(g, asked), 40)])


@query(
    "hydrate",
    """WITH names AS (SELECT id, lower(title) AS name FROM live_node UNION ALL SELECT id, lower(regexp_extract(id, '[^/]*$')) FROM live_node UNION ALL SELECT node, lower(alias) FROM node_alias WHERE node IN (SELECT id FROM live_node)), asked AS (SELECT DISTINCT p_name AS q, lower(trim(p_name)) AS t FROM part),
    h AS (SELECT q, id, CAST(max(CASE WHEN name = t THEN 100 ELSE 50 END) AS INT) AS score FROM names JOIN asked ON contains(name, t) GROUP BY q, id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INT) AS rank FROM h)
    SELECT q, rank, id, kind, title, summary, score FROM r JOIN live_node USING (id) WHERE rank <= 20""",
)
def _(spark, sf):
    g = graph(spark, sf)
    return search.hydrate(g, search.ranked(search.find_name_match(g, source(spark, sf, NAMES)), 20))


# --- edit log -----------------------------------------------------------------------------------------
@query(
    "ops_shape_check",
    """WITH e AS (SELECT proposal, 'other end is missing' AS error FROM ops WHERE verb IN ('LINK', 'UNLINK') AND to_val IS NULL UNION SELECT proposal, 'repeated idempotency key' FROM ops GROUP BY proposal HAVING count(DISTINCT idem_key) < count(*) UNION SELECT proposal, 'too many operations' FROM ops GROUP BY proposal HAVING count(*) > 100)
    SELECT proposal, string_agg(error, ',' ORDER BY error) AS errors FROM e GROUP BY proposal""",
    **LOG,
)
def _(spark, sf):
    return editlog.ops_shape_check(ops(spark, sf)).withColumn("errors", F.array_join("errors", ","))


RAW = OPS_SQL.replace("'character/c' || CAST(user_id AS STRING) END AS target", "CASE WHEN event_id % 3 = 0 THEN 'story://CHARACTER/c' ELSE 'Character/c' END || CAST(user_id AS STRING) END AS target")


@query(
    "ops_normalize_refs",
    "SELECT proposal, seq, verb, CASE WHEN contains(bare, '/') THEN lower(split_part(bare, '/', 1)) || substr(bare, length(split_part(bare, '/', 1)) + 1) ELSE bare END AS target, to_val FROM (SELECT *, regexp_replace(target, '^story://', '') AS bare FROM raw) q",
    raw=RAW,
)
def _(spark, sf):
    return editlog.ops_normalize_refs(source(spark, sf, RAW), kind_dim(spark)).select("proposal", "seq", "verb", "target", "to_val")


@query(
    "ops_read_coverage",
    """WITH k AS (SELECT proposal, node, max(rev) AS rev FROM (SELECT proposal, node, rev FROM reads UNION ALL SELECT proposal, target, NULL FROM ops WHERE verb = 'ADD') q GROUP BY proposal, node),
    e AS (SELECT proposal, target AS node, basis_rev FROM ops WHERE verb <> 'ADD' UNION ALL SELECT proposal, to_val, NULL FROM ops WHERE verb IN ('LINK', 'UNLINK'))
    SELECT DISTINCT e.proposal, e.node FROM e LEFT JOIN k ON k.proposal = e.proposal AND k.node = e.node WHERE k.node IS NULL OR (e.basis_rev IS NOT NULL AND k.rev IS NOT NULL AND e.basis_rev <> k.rev)""",
    **LOG,
)
def _(spark, sf):
    return editlog.ops_read_coverage(ops(spark, sf), read_set(spark, sf))


@query(
    "ops_idempotency",
    """WITH o AS (SELECT *, first_value(proposal) OVER w AS owner, first_value(verb || '|' || target || '|' || coalesce(field, '') || '|' || coalesce(to_val, '')) OVER w AS was, verb || '|' || target || '|' || coalesce(field, '') || '|' || coalesce(to_val, '') AS p FROM ops WINDOW w AS (PARTITION BY idem_key ORDER BY ts, proposal, seq))
    SELECT proposal, CASE WHEN bool_and(owner = proposal) THEN 'first' WHEN bool_and(p = was) AND NOT bool_or(owner = proposal) THEN 'repeat' ELSE 'reused' END AS status FROM o GROUP BY proposal""",
    **LOG,
)
def _(spark, sf):
    return editlog.ops_idempotency(ops(spark, sf))


@query(
    "pending_overlap",
    "SELECT DISTINCT a.proposal AS a, b.proposal AS b, a.target FROM ops a JOIN ops b ON a.target = b.target AND a.proposal < b.proposal WHERE a.verb <> 'UPDATE' OR b.verb <> 'UPDATE' OR a.field = b.field",
    **LOG,
)
def _(spark, sf):
    return editlog.pending_overlap(ops(spark, sf))


CHANGES = "SELECT DISTINCT 'character/c' || CAST(user_id AS STRING) AS node, CAST(2 + day(ts) % 2 AS INT) AS rev, 'props.f' || CAST(event_id % 4 AS STRING) AS field FROM @events WHERE event_type = 'purchase' AND event_id % 3 = 0"
CURRENT = "SELECT 'character/c' || CAST(c_custkey AS STRING) AS node, CAST(1 + c_custkey % 3 AS INT) AS rev FROM @customer"


_CONFLICTS = """WITH m AS (SELECT proposal, target AS node, bool_and(verb = 'UPDATE') AS upd FROM ops GROUP BY proposal, target), s AS (SELECT DISTINCT r.proposal, r.node FROM reads r JOIN changes c ON c.node = r.node AND c.rev > r.rev JOIN ops o ON o.proposal = r.proposal AND o.target = r.node AND o.field = c.field)
    SELECT r.proposal, r.node, CASE WHEN c.rev IS NULL THEN 'missing' ELSE 'revision_mismatch' END AS conflict FROM reads r LEFT JOIN cur c ON c.node = r.node LEFT JOIN m ON m.proposal = r.proposal AND m.node = r.node LEFT JOIN s ON s.proposal = r.proposal AND s.node = r.node
    WHERE c.rev IS NULL OR (c.rev <> r.rev AND NOT (coalesce(m.upd, false) AND s.node IS NULL))"""


@query(
    "detect_conflicts",
    _CONFLICTS,
    **LOG, changes=CHANGES, cur=CURRENT,
)
def _(spark, sf):
    return editlog.detect_conflicts(read_set(spark, sf), ops(spark, sf), source(spark, sf, CURRENT), source(spark, sf, CHANGES))


_RISK = f"""WITH p AS ({POLICIES_SQL}), rl AS ({RELS_SQL}), o AS (SELECT o.proposal, o.verb, o.field, coalesce(n.kind, upper(substr(o.target, 1, 1)) || lower(substr(split_part(o.target, '/', 1), 2))) AS kind, coalesce(n.locked, false) AS locked, rl.hard, CASE WHEN verb = 'UPDATE' AND json_extract_string(n.props, '$.' || regexp_replace(o.field, '^props\\.', '')) IS NOT NULL THEN 'set' ELSE 'null' END AS state FROM ops o LEFT JOIN live_node n ON n.id = o.target LEFT JOIN rl ON rl.rel = o.field),
    h AS (SELECT o.proposal, coalesce(p.policy, lower(o.verb) || '-default') AS reason, CASE p.risk WHEN 'auto' THEN 0 WHEN 'always' THEN 2 ELSE 1 END AS grade, coalesce(p.effect = 'forbid', false) AS no FROM o LEFT JOIN p ON (p.verb IS NULL OR list_contains(string_split(p.verb, '|'), o.verb)) AND coalesce(p.kind = o.kind, p.kind IS NULL) AND (p.field IS NULL OR p.field = o.field)
      AND (p.rel IS NULL OR (o.verb IN ('LINK', 'UNLINK') AND p.rel = o.field)) AND (p.hard IS NULL OR p.hard = o.hard) AND (p.locked IS NULL OR p.locked = o.locked) AND (p.value IS NULL OR p.value = o.state)),
    t AS (SELECT proposal, node FROM (SELECT proposal, target AS node FROM ops UNION SELECT proposal, to_val FROM ops WHERE verb IN ('LINK', 'UNLINK')) q WHERE node IS NOT NULL), w AS (SELECT proposal, count(*) AS n FROM t GROUP BY proposal),
    r AS (SELECT proposal, reason, grade, no FROM h UNION ALL SELECT proposal, CASE WHEN n >= 40 THEN 'cascade-40-plus' ELSE 'cascade-3-plus' END, CASE WHEN n >= 40 THEN 2 ELSE 1 END, false FROM w WHERE n >= 3)
    SELECT proposal, ['auto', 'review', 'always'][max(grade) + 1] AS risk, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, count(*) FILTER (WHERE no) AS forbidden FROM r GROUP BY proposal"""


@query(
    "risk_assess",
    _RISK,
    **LOG,
)
def _(spark, sf):
    return editlog.risk_assess(graph(spark, sf), ops(spark, sf), rel_dim(spark)).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "bump_revision",
    "SELECT o.target AS node, CAST(coalesce(c.rev, 0) + row_number() OVER w AS INT) AS rev, o.field, o.proposal, CAST(coalesce(c.rev, 0) + row_number() OVER w - 1 AS INT) AS derived_from, lead(o.ts) OVER w IS NULL AS newest FROM ops o LEFT JOIN cur c ON c.node = o.target WINDOW w AS (PARTITION BY o.target ORDER BY o.ts, o.proposal, o.seq)",
    **LOG, cur=CURRENT,
)
def _(spark, sf):
    out = editlog.bump_revisions(ops(spark, sf), source(spark, sf, CURRENT))
    return out.select("node", "rev", "field", "proposal", "derived_from", F.col("tx_to").isNull().alias("newest"))


@query(
    "revision_asof",
    "WITH r AS (SELECT target AS node, ts, CAST(row_number() OVER w AS INT) AS rev, lead(ts) OVER w AS nx FROM ops WINDOW w AS (PARTITION BY target ORDER BY ts, proposal, seq)) SELECT node, rev FROM r WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' AND (nx IS NULL OR nx > TIMESTAMP '2024-01-15 00:00:00')",
    **LOG,
)
def _(spark, sf):
    empty = spark.createDataFrame([], "node string, rev int")
    r = editlog.bump_revisions(ops(spark, sf), empty)
    return editlog.revision_asof(r, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("node", "rev")


@query("content_cid", _CID)
def _(spark, sf):
    return editlog.content_cid(graph(spark, sf))


def _fold(below: str, digits: int) -> str:
    return f"SELECT substr(leaf, 1, {digits}) AS leaf, sha256(string_agg(CAST(to_json([leaf, hash]) AS VARCHAR), ',' ORDER BY CAST(to_json([leaf, hash]) AS VARCHAR))) AS hash FROM ({below}) z GROUP BY 1"


_LEAVES = f"SELECT leaf, sha256(string_agg(x, ',' ORDER BY x)) AS hash FROM (SELECT substr(sha256(id), 1, 2) AS leaf, CAST(to_json([id, cid]) AS VARCHAR) AS x FROM ({_CID}) c) z GROUP BY leaf"


@query("graph_root", f"SELECT hash AS root FROM ({_fold(_fold(_LEAVES, 1), 0)}) q")
def _(spark, sf):
    return editlog.graph_root(editlog.content_cid(graph(spark, sf)), 2)


# what a user's proposals put into a node, a revision each, and what others read of it before
VERSIONS = "SELECT target AS node, CAST(row_number() OVER (PARTITION BY target ORDER BY ts, proposal, seq) AS INT) + 1 AS rev, field, to_val AS value FROM (" + OPS_SQL + ") o WHERE verb = 'UPDATE'"
VERSION_READS = "SELECT DISTINCT 'p' || CAST(event_id AS STRING) AS reader, 'character/c' || CAST(user_id AS STRING) AS node, CAST(1 + event_id % 9 AS INT) AS rev FROM @events WHERE event_id % 3 = 0"
_ASOF = (
    "last AS (SELECT node, field, max(rev) AS last, arg_max(value, rev) AS now FROM versions GROUP BY node, field), asked AS (SELECT r.*, l.field, l.now FROM vreads r JOIN last l ON l.node = r.node AND l.last > r.rev), "
    "c AS (SELECT a.reader, a.node, a.rev, a.field, CASE WHEN count(v.rev) > 0 THEN arg_max(v.value, v.rev) ELSE any_value(CASE WHEN a.field = 'props.segment' THEN n.props->>'$.segment' END) END AS \"then\", any_value(a.now) AS now FROM asked a LEFT JOIN versions v ON v.node = a.node AND v.field = a.field AND v.rev <= a.rev LEFT JOIN live_node n ON n.id = a.node GROUP BY a.reader, a.node, a.rev, a.field)"
)


def _versions(spark, sf):
    v = source(spark, sf, VERSIONS)
    return source(spark, sf, VERSION_READS), v, versions.base_value(graph(spark, sf), v.select("node", "field").distinct())


@query("asof_content", f"WITH {_ASOF} SELECT * FROM c", versions=VERSIONS, vreads=VERSION_READS)
def _(spark, sf):
    return versions.asof_content(*_versions(spark, sf))


@query("changed_since", f"WITH {_ASOF} SELECT reader, node, rev, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM c WHERE \"then\" IS DISTINCT FROM now GROUP BY reader, node, rev", versions=VERSIONS, vreads=VERSION_READS)
def _(spark, sf):
    return versions.changed_since(*_versions(spark, sf)).withColumn("fields", F.array_join("fields", ","))


BRANCH_LOG = "SELECT 's' || CAST(user_id % 20 AS STRING) AS session, event_id AS commit_seq, ts, CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'accepted' END AS status FROM @events"


@query("branch_track", "SELECT session, min(ts) AS first_ts, min(CASE WHEN status = 'accepted' THEN commit_seq END) AS base, max(CASE WHEN status = 'accepted' THEN commit_seq END) AS head, CASE WHEN arg_max(status, commit_seq) = 'rejected' THEN 'conflicted' ELSE 'active' END AS status FROM log GROUP BY session", log=BRANCH_LOG)
def _(spark, sf):
    return editlog.branch_track(source(spark, sf, BRANCH_LOG))


# the log of events beside one of orders: promises move on, edges that are there are unlinked, parts are invalidated
WRITES = OPS_SQL + (
    " UNION ALL SELECT 'w' || CAST(o_orderkey AS STRING), CAST(1 AS INT), 'UNLINK', 'scene/o' || CAST(o_orderkey AS STRING), 'occurs_at', 'location/n' || CAST(o_orderkey % 25 AS STRING), CAST(1 AS INT), 'order-key-' || CAST(o_orderkey AS STRING), CAST(o_orderdate AS TIMESTAMP) FROM @orders WHERE o_orderkey % 4 = 0"
    " UNION ALL SELECT 'w' || CAST(o_orderkey AS STRING), CAST(2 AS INT), 'LINK', 'scene/o' || CAST(o_orderkey AS STRING), 'occurs_at', 'location/n' || CAST((o_orderkey + 1) % 25 AS STRING), CAST(1 AS INT), 'order-next-' || CAST(o_orderkey AS STRING), CAST(o_orderdate AS TIMESTAMP) FROM @orders WHERE o_orderkey % 8 = 0"
    " UNION ALL SELECT 'm' || CAST(p_partkey AS STRING), CAST(1 AS INT), 'UPDATE', 'promise/p' || CAST(p_partkey AS STRING), 'props.status', CASE p_size % 3 WHEN 0 THEN 'eligible' WHEN 1 THEN 'prevented' ELSE 'actualized' END, CAST(1 AS INT), 'part-key-' || CAST(p_partkey AS STRING), CAST('2024-03-01 00:00:00' AS TIMESTAMP) FROM @part"
    " UNION ALL SELECT 'm' || CAST(p_partkey AS STRING), CAST(2 AS INT), 'INVALIDATE', 'promise/p' || CAST(p_partkey AS STRING), NULL, NULL, CAST(1 AS INT), 'part-gone-' || CAST(p_partkey AS STRING), CAST('2024-03-02 00:00:00' AS TIMESTAMP) FROM @part WHERE p_partkey % 3 = 0"
)

# A proposal is what one user did in a week, each after the revisions of the user that it read; ids of concepts come again, so later ADDs meet earlier ones
_WEEK = "'p' || CAST(user_id AS STRING) || '-' || CAST(CAST(floor(day(ts) / 7) AS INT) AS STRING)"
COMMIT_OPS = OPS_SQL.replace("'p' || CAST(user_id AS STRING) || '-' || CAST(day(ts) AS STRING) AS proposal", f"{_WEEK} AS proposal").replace(
    "'concept/e' || CAST(event_id AS STRING)", "'concept/e' || CAST(event_id % 500 AS STRING)"
).replace("PARTITION BY user_id, day(ts)", "PARTITION BY user_id, floor(day(ts) / 7)").replace(
    "CASE WHEN event_type = 'purchase' THEN CAST", "CASE WHEN event_type = 'signup' THEN '{\"title\":\"concept ' || CAST(event_id AS STRING) || '\",\"props\":{\"by\":\"' || CAST(user_id AS STRING) || '\"},\"tags\":[\"signup\"]}' WHEN event_type = 'purchase' THEN CAST"
)
COMMIT_OPS += "".join(" UNION ALL " + x for x in WRITES.split(" UNION ALL ")[1:])
COMMIT_READS = (
    f"SELECT DISTINCT {_WEEK} AS proposal, 'character/c' || CAST(user_id AS STRING) AS node, CAST(1 + CAST(floor(day(ts) / 7) AS INT) * (user_id % 3) AS INT) AS rev FROM @events WHERE user_id % 2 = 0"
    " UNION ALL SELECT DISTINCT 'w' || CAST(o_orderkey AS STRING), 'scene/o' || CAST(o_orderkey AS STRING), CAST(1 + o_orderkey % 8 / 4 AS INT) FROM @orders WHERE o_orderkey % 4 = 0"
)
COMMIT_ORDER = f"SELECT {_WEEK} AS proposal, max(ts) AS at FROM @events GROUP BY 1 UNION ALL SELECT 'w' || CAST(o_orderkey AS STRING), CAST(o_orderdate AS TIMESTAMP) FROM @orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'm' || CAST(p_partkey AS STRING), CAST('2024-03-01 00:00:00' AS TIMESTAMP) FROM @part"


def _commit_inputs(spark, sf):
    """A proposal is what one user did in a week; each says which revision of the user it read."""
    week = "'p' || CAST(user_id AS STRING) || '-' || CAST(CAST(floor(day(ts) / 7) AS INT) AS STRING)"
    log = OPS_SQL.replace("'p' || CAST(user_id AS STRING) || '-' || CAST(day(ts) AS STRING) AS proposal", f"{week} AS proposal")
    order = source(spark, sf, f"SELECT {week} AS proposal, min(event_id) AS commit_seq FROM @events GROUP BY 1")
    current = source(spark, sf, CURRENT).withColumn("fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))
    mine = f"SELECT DISTINCT {week} AS proposal, 'character/c' || CAST(user_id AS STRING) AS node, CAST(1 + user_id % 3 AS INT) AS rev FROM @events"
    return source(spark, sf, log), source(spark, sf, mine), order, current


def _committed(spark, sf):
    return commit.commit_log(graph(spark, sf), source(spark, sf, COMMIT_OPS), source(spark, sf, COMMIT_READS), source(spark, sf, COMMIT_ORDER), kind_dim(spark), rel_dim(spark))


@query("commit_batch")
def _(spark, sf):
    return _committed(spark, sf).status.drop("at")


@query("commit_revisions")
def _(spark, sf):
    return _committed(spark, sf).revisions


@query("commit_nodes")
def _(spark, sf):
    return _committed(spark, sf).node.drop("tx_from")


@query("commit_edges")
def _(spark, sf):
    return _committed(spark, sf).edge


@query("commit_branches")
def _(spark, sf):
    return commit.commit_branches(_committed(spark, sf), source(spark, sf, f"SELECT DISTINCT {_WEEK} AS proposal, 's' || CAST(user_id % 20 AS STRING) AS session FROM @events"))


# --- the log applied --------------------------------------------------------------------------------
_ERRORS = f"""k AS ({KINDS_SQL}), rl AS ({RELS_SQL}), nd AS (SELECT id, kind, locked, coalesce(json_extract_string(props, '$.status'), 'hypothetical') AS status FROM live_node), ad AS (SELECT DISTINCT proposal, target FROM ops WHERE verb = 'ADD'),
    x AS (SELECT o.*, n.id IS NOT NULL AS live, coalesce(n.locked, false) AS lk, n.id IS NOT NULL OR a.target IS NOT NULL AS known, coalesce(n.kind, upper(substr(o.target, 1, 1)) || lower(substr(split_part(o.target, '/', 1), 2))) AS kd, coalesce(n.status, 'hypothetical') AS status FROM ops o LEFT JOIN nd n ON n.id = o.target LEFT JOIN ad a USING (proposal, target)),
    y AS (SELECT x.*, m.id IS NOT NULL OR b.target IS NOT NULL AS other, coalesce(m.locked, false) AS olk, coalesce(m.kind, upper(substr(x.to_val, 1, 1)) || lower(substr(split_part(x.to_val, '/', 1), 2))) AS okd, rl.rel IS NOT NULL AS rk, rl.src_kind, rl.dst_kind, EXISTS (SELECT 1 FROM live_edge e WHERE e.src = x.target AND e.rel = x.field AND e.dst = x.to_val) AS linked
      FROM x LEFT JOIN nd m ON m.id = x.to_val LEFT JOIN (SELECT proposal, target FROM ad) b ON b.proposal = x.proposal AND b.target = x.to_val LEFT JOIN rl ON rl.rel = x.field WHERE x.verb IN ('LINK', 'UNLINK')),
    bad AS (SELECT proposal, seq, 'id is in use' AS error FROM x WHERE verb = 'ADD' AND live UNION ALL SELECT proposal, seq, 'unknown kind' FROM x WHERE verb = 'ADD' AND lower(split_part(target, '/', 1)) NOT IN (SELECT lower(kind) FROM k)
      UNION ALL SELECT proposal, seq, 'target is not there' FROM x WHERE verb <> 'ADD' AND NOT known UNION ALL SELECT proposal, seq, 'target is locked' FROM x WHERE verb IN ('UPDATE', 'INVALIDATE') AND lk
      UNION ALL SELECT proposal, seq, 'field cannot be set' FROM x WHERE verb = 'UPDATE' AND NOT (coalesce(field, '') LIKE 'props.%' OR coalesce(field, '') IN ('title', 'summary'))
      UNION ALL SELECT proposal, seq, 'no such step of a promise' FROM x WHERE verb = 'UPDATE' AND kd = 'Promise' AND field = 'props.status' AND to_val <> status AND (status, to_val) NOT IN (('hypothetical', 'eligible'), ('hypothetical', 'prevented'), ('eligible', 'actualized'), ('eligible', 'prevented'), ('actualized', 'prevented'))
      UNION ALL SELECT proposal, seq, 'other end is not there' FROM y WHERE NOT other UNION ALL SELECT proposal, seq, 'unknown relation' FROM y WHERE NOT rk UNION ALL SELECT proposal, seq, 'kind of the target does not fit' FROM y WHERE verb = 'LINK' AND src_kind <> kd
      UNION ALL SELECT proposal, seq, 'kind of the other end does not fit' FROM y WHERE verb = 'LINK' AND dst_kind <> okd UNION ALL SELECT proposal, seq, 'an end is locked' FROM y WHERE lk OR olk
      UNION ALL SELECT proposal, seq, 'edge is there already' FROM y WHERE verb = 'LINK' AND linked UNION ALL SELECT proposal, seq, 'edge is not there' FROM y WHERE verb = 'UNLINK' AND NOT linked)"""

def _writes(spark, sf):
    return source(spark, sf, WRITES), kind_dim(spark), rel_dim(spark)


def _sound(spark, sf):
    g = graph(spark, sf)
    return g, apply.sound_ops(g, *_writes(spark, sf))


@query("validate_ops", f"WITH {_ERRORS} SELECT proposal, seq, error FROM bad", ops=WRITES)
def _(spark, sf):
    return apply.validate_ops(graph(spark, sf), *_writes(spark, sf))


@query(
    "simulate",
    f"WITH {_ERRORS}, w AS (SELECT proposal, count(*) AS n, min((seq, error)) AS f FROM bad GROUP BY proposal) SELECT p.proposal, coalesce(w.n, 0) AS n_errors, w.n IS NULL AS valid, CASE WHEN w.n IS NOT NULL THEN f[2] END AS first_error FROM (SELECT DISTINCT proposal FROM ops) p LEFT JOIN w USING (proposal)",
    ops=WRITES,
)
def _(spark, sf):
    return apply.simulate(graph(spark, sf), *_writes(spark, sf))


_FINE = "fine AS (SELECT * FROM ops WHERE proposal NOT IN (SELECT proposal FROM bad))"


@query(
    "apply_edges",
    f"""WITH {_ERRORS}, {_FINE}, l AS (SELECT target AS src, field AS rel, to_val AS dst, arg_max(verb, (ts, proposal, seq)) AS verb, arg_max(proposal, (ts, proposal, seq)) AS p, max(ts) AS ts FROM fine WHERE verb IN ('LINK', 'UNLINK') GROUP BY target, field, to_val),
    e AS (SELECT src, rel, dst, w.src IS NOT NULL AS was, l.verb, l.p, l.ts FROM (SELECT DISTINCT src, rel, dst FROM live_edge) w FULL JOIN l USING (src, rel, dst)), z AS (SELECT target, min(ts) AS at FROM fine WHERE verb = 'INVALIDATE' GROUP BY target)
    SELECT src, rel, dst, CASE WHEN verb = 'LINK' AND NOT was THEN p END AS opened_by, CASE WHEN verb = 'LINK' AND NOT was THEN ts END AS tx_from, least(CASE WHEN verb = 'UNLINK' THEN ts END, a.at, b.at) AS tx_to
    FROM (SELECT e.src, e.rel, e.dst, m.src IS NOT NULL AS was, verb, p, ts FROM e LEFT JOIN (SELECT DISTINCT src, rel, dst FROM live_edge) m USING (src, rel, dst)) q LEFT JOIN z a ON a.target = q.src LEFT JOIN z b ON b.target = q.dst WHERE was OR verb = 'LINK'""",
    ops=WRITES,
)
def _(spark, sf):
    return apply.apply_edges(*_sound(spark, sf))


@query(
    "apply_nodes",
    f"""WITH {_ERRORS}, {_FINE}, t AS (SELECT target AS id, count(*) AS n, min(ts) FILTER (WHERE verb = 'INVALIDATE') AS closed, bool_or(verb = 'ADD') AS added FROM fine GROUP BY target),
    u AS (SELECT target AS id, field, arg_max(to_val, (ts, proposal, seq)) AS v FROM fine WHERE verb = 'UPDATE' GROUP BY target, field), b AS (SELECT src AS id, count(DISTINCT dst) AS n FROM live_edge WHERE dst IN (SELECT target FROM fine WHERE verb = 'INVALIDATE') GROUP BY src)
    SELECT coalesce(n.id, t.id) AS id, coalesce(n.kind, upper(substr(t.id, 1, 1)) || substr(split_part(t.id, '/', 1), 2)) AS kind, n.title, n.story_from, coalesce((SELECT v FROM u WHERE u.id = n.id AND field = 'props.status'), n.props->>'$.status') AS status, coalesce((SELECT v FROM u WHERE u.id = n.id AND field = 'props.segment'), n.props->>'$.segment') AS segment,
    (SELECT v FROM u WHERE u.id = n.id AND field = 'props.f1') AS f1, CAST(coalesce(n.rev, 0) + coalesce(t.n, 0) + coalesce(b.n, 0) AS INT) AS rev, t.closed AS tx_to FROM live_node n FULL JOIN t ON t.id = n.id LEFT JOIN b ON b.id = coalesce(n.id, t.id) WHERE n.id IS NOT NULL OR t.added""",
    ops=WRITES,
)
def _(spark, sf):
    out = apply.apply_nodes(*_sound(spark, sf))
    return out.select("id", "kind", "title", "story_from", *(prop(c).alias(c) for c in ("status", "segment", "f1")), "rev", "tx_to")


# --- propagation ---------------------------------------------------------------------------------------
@query(
    "dependency_edges",
    "SELECT source, target, source_rev, proposal FROM (SELECT r.node AS source, o.target, r.rev AS source_rev, o.proposal, row_number() OVER (PARTITION BY r.node, o.target ORDER BY o.ts DESC, o.proposal DESC, o.seq DESC) AS n FROM reads r JOIN ops o ON o.proposal = r.proposal WHERE r.node <> o.target) q WHERE n = 1",
    **LOG,
)
def _(spark, sf):
    return cascade.dependency_edges(ops(spark, sf), read_set(spark, sf))


@query("read_index", "SELECT proposal, node, rev FROM reads", **LOG)
def _(spark, sf):
    packed = read_set(spark, sf).groupBy("proposal").agg(F.to_json(F.collect_list(F.struct("node", "rev"))).alias("read_set"))
    return cascade.read_index(packed)


def _runs(spark, sf):
    g = graph(spark, sf, True)
    deps = cascade.dependency_edges(ops(spark, sf), read_set(spark, sf))
    triggers = deps.select(F.col("source").alias("run"), F.col("source").alias("node")).distinct()
    return cascade.propagate(g, deps, triggers, g.live_node.select(F.col("id").alias("node"))), deps


@query(
    "propagate",
    """WITH RECURSIVE deps AS (SELECT DISTINCT r.node AS source, o.target FROM reads r JOIN ops o ON o.proposal = r.proposal WHERE r.node <> o.target), lv AS (SELECT id, locked FROM live_node),
    w(run, node, depth) AS (SELECT DISTINCT source, source, 0 FROM deps WHERE source IN (SELECT id FROM lv) UNION SELECT w.run, d.target, w.depth + 1 FROM w JOIN deps d ON d.source = w.node JOIN lv ON lv.id = w.node WHERE w.depth < 3 AND NOT lv.locked),
    f AS (SELECT run, node, min(depth) AS depth FROM w GROUP BY run, node HAVING min(depth) > 0), c AS (SELECT run, count(*) AS n FROM f GROUP BY run)
    SELECT f.run, f.node, CAST(f.depth AS INT) AS depth, CASE WHEN c.n > 40 THEN 'blocked' WHEN lv.id IS NULL THEN 'cutoff' WHEN lv.locked THEN 'skipped' ELSE 'dirty' END AS status FROM f JOIN c ON c.run = f.run LEFT JOIN lv ON lv.id = f.node""",
    **LOG,
)
def _(spark, sf):
    return _runs(spark, sf)[0]


# as propagate, but only nodes whose typed content differs from what was read of them pass anything on, and a run goes as far as it leads
@query(
    "propagate_cutoff",
    f"""WITH RECURSIVE {_ASOF}, ch AS (SELECT DISTINCT node FROM c WHERE "then" IS DISTINCT FROM now), deps AS (SELECT DISTINCT r.node AS source, o.target FROM reads r JOIN ops o ON o.proposal = r.proposal WHERE r.node <> o.target), lv AS (SELECT id, locked FROM live_node),
    w(run, node, depth) AS (SELECT DISTINCT source, source, 0 FROM deps WHERE source IN (SELECT id FROM lv) UNION SELECT w.run, d.target, w.depth + 1 FROM w JOIN deps d ON d.source = w.node JOIN lv ON lv.id = w.node WHERE NOT lv.locked AND (w.depth > 0 OR w.node IN (SELECT node FROM ch))),
    f AS (SELECT run, node, min(depth) AS depth FROM w GROUP BY run, node HAVING min(depth) > 0)
    SELECT f.run, f.node, CAST(f.depth AS INT) AS depth, CASE WHEN lv.id IS NULL THEN 'cutoff' WHEN lv.locked THEN 'skipped' ELSE 'dirty' END AS status FROM f LEFT JOIN lv ON lv.id = f.node""",
    **LOG, versions=VERSIONS, vreads=VERSION_READS,
)
def _(spark, sf):
    g = graph(spark, sf)
    deps = cascade.dependency_edges(ops(spark, sf), read_set(spark, sf))
    runs = deps.join(g.live_node.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("run"), F.col("source").alias("node")).distinct()
    return cascade.propagate(g, deps, runs, versions.changed_since(*_versions(spark, sf)).select("node").distinct(), None, None)


@query("topo_order")
def _(spark, sf):
    items, deps = _runs(spark, sf)
    return cascade.topo_order(items.where("status != 'blocked'"), deps)


JOBS = "SELECT CAST(event_id AS STRING) AS job, 'run-' || CAST(user_id AS STRING) AS run, 'node-' || CAST(day(ts) AS STRING) AS node, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'skipped' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status, CAST(event_id % 5 AS INT) AS attempts, ts AS lease_until FROM @events"


@query("job_sweep", "SELECT job, CASE WHEN status = 'running' AND lease_until <= TIMESTAMP '2024-01-20 00:00:00' THEN CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END ELSE status END AS status FROM jobs", jobs=JOBS)
def _(spark, sf):
    return cascade.job_sweep(source(spark, sf, JOBS), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("job", "status")


@query("job_finish_rollup", "SELECT run, node, CASE WHEN bool_or(status = 'failed') THEN 'blocked' WHEN bool_and(status = 'skipped') THEN 'cutoff' WHEN bool_and(status IN ('done', 'skipped')) THEN 'proposed' ELSE 'waiting' END AS item FROM jobs GROUP BY run, node", jobs=JOBS)
def _(spark, sf):
    return cascade.job_finish_rollup(source(spark, sf, JOBS))


CAUSED = "SELECT 'run-' || CAST(o_custkey AS STRING) AS run, 'scene/o' || CAST(o_orderkey AS STRING) AS node, CAST(o_orderkey % 4 AS INT) AS depth, CASE WHEN o_orderkey % 6 = 0 THEN 'blocked' ELSE 'dirty' END AS status FROM @orders"


@query(
    "propagate_cycles",
    """WITH RECURSIVE step AS (SELECT DISTINCT a.run, e.src, e.dst FROM live_edge e JOIN caused a ON a.node = e.src JOIN caused b ON b.node = e.dst AND b.run = a.run WHERE e.rel = 'causes'), far(run, a, b) AS (SELECT * FROM step UNION SELECT far.run, far.a, step.dst FROM far JOIN step ON step.run = far.run AND step.src = far.b)
    SELECT run, a AS node FROM far WHERE a = b""",
    caused=CAUSED,
)
def _(spark, sf):
    deps = graph(spark, sf).live_edge.where("rel = 'causes'").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return cascade.propagate_cycles(source(spark, sf, CAUSED), deps)


TRIGGERED = "SELECT 'o' || CAST(o_orderkey AS STRING) AS proposal, 'o' || CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS STRING) AS \"trigger\" FROM @orders"


@query("run_iteration", "SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS proposal, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS iteration FROM orders")
def _(spark, sf):
    return cascade.run_iteration(source(spark, sf, TRIGGERED.replace('"', "`")))


# scenes copy a property of who is present; some have a second contract that may disagree
COPIES = (
    "SELECT 'scene/o' || CAST(o_orderkey AS STRING) AS target, 'character/c' || CAST(o_custkey AS STRING) AS source, 'props.segment' AS source_field, 'props.priority' AS target_field FROM @orders"
    " UNION ALL SELECT 'scene/o' || CAST(o_orderkey AS STRING), 'location/n' || CAST(o_orderkey % 25 AS STRING), 'title', CASE WHEN o_orderkey % 2 = 0 THEN 'props.priority' ELSE 'summary' END FROM @orders WHERE o_orderkey % 3 = 0"
)
_PARENTS = "SELECT dst AS source, src AS target FROM live_edge WHERE rel IN ('present_at', 'occurs_at')"
_DIRTY = "SELECT id AS node FROM live_node WHERE kind = 'Character' AND id LIKE '%3'"
_VALUE = "CASE {f} WHEN 'title' THEN {n}.title WHEN 'summary' THEN {n}.summary ELSE json_extract_string({n}.props, '$.' || substr({f}, 7)) END"


def _parents(g):
    return g.live_edge.where("rel in ('present_at', 'occurs_at')").select(F.col("dst").alias("source"), F.col("src").alias("target"))


@query(
    "derive_candidates",
    f"""WITH par AS ({_PARENTS}), v AS (SELECT c.target, c.target_field, {_VALUE.format(f="c.source_field", n="n")} AS value FROM copies c JOIN live_node n ON n.id = c.source WHERE (c.source, c.target) IN (SELECT (source, target) FROM par)),
    one AS (SELECT target, target_field, max(value) AS to_val FROM v GROUP BY target, target_field HAVING count(DISTINCT value) = 1 AND count(*) = count(value)), late AS (SELECT target FROM par WHERE source IN ({_DIRTY}))
    SELECT target, target_field AS field, to_val, sha256('derive|' || target || '|' || target_field || '|' || to_val) AS idem_key FROM one JOIN live_node t ON t.id = one.target WHERE target NOT IN (SELECT target FROM late) AND {_VALUE.format(f="one.target_field", n="t")} IS DISTINCT FROM to_val""",
    copies=COPIES,
)
def _(spark, sf):
    g = graph(spark, sf)
    return cascade.derive_candidates(g, source(spark, sf, COPIES), _parents(g), g.live_node.where("kind = 'Character' and id like '%3'").select(F.col("id").alias("node")))


ASKS = "SELECT 'scene/o' || CAST(o_orderkey AS STRING) AS target, 'character/c' || CAST(CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS STRING) AS source, 'summary' AS target_field, CAST(500 + o_orderkey % 4000 AS INT) AS max_tokens FROM @orders"
HUMAN = "SELECT 'scene/o' || CAST(o_orderkey AS STRING) AS node, CAST(1 AS INT) AS rev FROM @orders WHERE o_orderkey % 7 <> 0"
_JOBS_SQL = f"""par AS ({_PARENTS}), why AS (SELECT i.run, a.target, i.depth, a.target_field, a.max_tokens, CASE WHEN i.depth > 2 THEN 'too deep' WHEN a.target NOT IN (SELECT node FROM human) THEN 'no human revision' WHEN (a.source, a.target) NOT IN (SELECT (source, target) FROM par) THEN 'source is no parent' END AS reason FROM asks a JOIN caused i ON i.node = a.target),
    told AS (SELECT run, target, target_field AS field, coalesce(reason, CASE WHEN sum(CASE WHEN reason IS NULL THEN max_tokens ELSE 0 END) OVER (PARTITION BY run ORDER BY depth, target ROWS UNBOUNDED PRECEDING) > 20000 THEN 'over budget' ELSE 'queued' END) AS status FROM why)"""


def _jobs(spark, sf):
    asks = source(spark, sf, ASKS).withColumn("sources", F.array("source")).drop("source")
    return cascade.rederive_jobs(asks, source(spark, sf, CAUSED), _parents(graph(spark, sf)), source(spark, sf, HUMAN))


@query("rederive_jobs", f"WITH {_JOBS_SQL} SELECT run, target, field, status FROM told", asks=ASKS, human=HUMAN, caused=CAUSED)
def _(spark, sf):
    return _jobs(spark, sf)


@query(
    "cascade_audit",
    f"WITH {_JOBS_SQL}, x AS (SELECT run, count(*) AS nodes, count(*) FILTER (WHERE status = 'dirty') AS dirty, count(*) FILTER (WHERE status = 'blocked') AS blocked FROM caused GROUP BY run), y AS (SELECT run, count(*) AS jobs, count(*) FILTER (WHERE status = 'queued') AS queued FROM told GROUP BY run) SELECT x.*, coalesce(jobs, 0) AS jobs, coalesce(queued, 0) AS queued FROM x LEFT JOIN y USING (run)",
    asks=ASKS, human=HUMAN, caused=CAUSED,
)
def _(spark, sf):
    return cascade.cascade_audit(source(spark, sf, CAUSED), _jobs(spark, sf))


LOST = "SELECT DISTINCT 'job-' || CAST(user_id AS STRING) || '-' || CAST(event_id % 4 AS STRING) AS job, 'character/c' || CAST(user_id AS STRING) AS target, 'props.f' || CAST(event_id % 4 AS STRING) AS field, CAST(1 + event_id % 2 AS INT) AS basis_rev FROM @events"


@query(
    "job_recover",
    "WITH s AS (SELECT * FROM ops QUALIFY count(*) OVER (PARTITION BY proposal) = 1) SELECT j.job, arg_min(s.proposal, (s.ts, s.proposal)) AS proposal FROM lost j JOIN s ON s.verb = 'UPDATE' AND s.target = j.target AND s.field = j.field AND s.basis_rev = j.basis_rev GROUP BY j.job",
    **LOG, lost=LOST,
)
def _(spark, sf):
    return cascade.job_recover(source(spark, sf, LOST), ops(spark, sf))


# --- ingest ------------------------------------------------------------------------------------------
FILES = "SELECT 'doc-' || CAST(doc_id AS STRING) AS file, encode(text, 'UTF-8') AS content FROM @documents"


@query(
    "scene_split",
    r"""WITH t AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS file, string_split(text, chr(10)) AS ls, octet_length(encode(text)) AS size FROM documents WHERE text <> ''), l AS (SELECT file, size, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM t),
    o AS (SELECT file, size, i, line, coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_off FROM l), c AS (SELECT * FROM o WHERE i = 0 OR regexp_full_match(line, '(?s)#{2,3} .*|\*\*\*[ \t]*'))
    SELECT file, start_off, coalesce(lead(start_off) OVER (PARTITION BY file ORDER BY start_off), size)::BIGINT AS end_off FROM c""",
)
def _(spark, sf):
    return ingest.scene_split(source(spark, sf, FILES))


# bytes of a text by its hexadecimal form; a character that is cut at either end is U+FFFD, as when the bytes are read
_BODY = (
    "SELECT node, string_agg(part, chr(10) || chr(10) ORDER BY file, start_off, part) AS body FROM (SELECT node, file, start_off, repeat(chr(65533), CAST(len(head) / 2 AS INT)) || decode(unhex(substr(h, len(head) + 1, len(h) - len(head) - len(tail)))) || CASE WHEN tail = '' THEN '' ELSE chr(65533) END AS part "
    "FROM (SELECT *, regexp_extract(substr(h, len(head) + 1), '(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$') AS tail FROM (SELECT *, regexp_extract(h, '^(?:[89AB][0-9A-F])*') AS head FROM (SELECT e.node, e.file, e.start_off, substr(hex(encode(d.text)), 2 * e.start_off + 1, 2 * (e.end_off - e.start_off)) AS h FROM evidence e JOIN documents d ON e.file = 'doc-' || CAST(d.doc_id AS VARCHAR)) x) y) z) w GROUP BY node"
)


@query("read_span_bytes", _BODY)
def _(spark, sf):
    return ingest.read_span_bytes(source(spark, sf, FILES), graph(spark, sf).evidence)


BODIES_ASKED = "SELECT CAST(event_id AS BIGINT) AS pos, 'fact/e' || CAST(event_id AS STRING) AS id FROM @events"


@query("get_body", f"SELECT a.pos, n.id, n.title, CASE WHEN n.reveal_at IS NULL OR n.reveal_at <= 15 THEN b.body END AS body, coalesce(n.reveal_at > 15, false) AS hidden FROM (SELECT CAST(event_id AS BIGINT) AS pos, 'fact/e' || CAST(event_id AS VARCHAR) AS id FROM events) a JOIN live_node n ON n.id = a.id LEFT JOIN ({_BODY}) b ON b.node = n.id")
def _(spark, sf):
    return reads.get_body(graph(spark, sf), source(spark, sf, BODIES_ASKED), source(spark, sf, FILES), 15)


# spans of 64 bytes over whole texts, each quoting as many characters from its start
_SPANS = "SELECT 'fact/e' || CAST(doc_id AS STRING) AS node, 'doc-' || CAST(doc_id AS STRING) AS file, CAST(n * 64 AS INT) AS start_off, CAST(n * 64 + 64 AS INT) AS end_off, substr(text, CAST(n * 64 + 1 AS INT), 64) AS quote FROM {}"


@query(
    "span_validate",
    f"WITH t AS (SELECT doc_id, text, unnest(range(length(text) // 64 + 1)) AS n FROM documents), sp AS ({_SPANS.format('t')}), b AS (SELECT sp.*, d.text IS NULL AS gone, octet_length(encode(d.text)) AS size, array_slice(encode(d.text), start_off + 1, end_off) AS got FROM sp LEFT JOIN documents d ON 'doc-' || CAST(d.doc_id AS VARCHAR) = sp.file)"
    " SELECT node, start_off, CASE WHEN gone THEN 'file is missing' WHEN end_off > size THEN 'outside the file' WHEN TRY(decode(got)) IS NULL THEN 'splits a character' WHEN got <> encode(quote) THEN 'quote differs' END AS problem FROM b",
)
def _(spark, sf):
    pieces = "(SELECT doc_id, text, explode(sequence(0, CAST(floor(length(text) / 64) AS INT))) AS n FROM @documents) t"
    return ingest.span_validate(source(spark, sf, FILES), source(spark, sf, _SPANS.format(pieces)))


PARTS = "SELECT 'o' || CAST(l_orderkey AS STRING) AS file, CAST((sum(l_quantity) OVER w) - l_quantity + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS start_off, CAST((sum(l_quantity) OVER w) AS BIGINT) AS end_off FROM @lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WHOLE = "SELECT 'o' || CAST(l_orderkey AS STRING) AS file, CAST(sum(l_quantity) AS BIGINT) AS size FROM @lineitem GROUP BY l_orderkey"


@query(
    "scene_partition_check",
    "WITH s AS (SELECT file, start_off, end_off, coalesce(lag(end_off) OVER (PARTITION BY file ORDER BY start_off, end_off), 0) AS due FROM parts), p AS (SELECT file, count(*) AS scenes, bool_and(start_off = due AND end_off > start_off) AS meets, max(end_off) AS last FROM s GROUP BY file) SELECT w.file, coalesce(scenes, 0) AS scenes, coalesce(meets AND last = size, false) AS tiles FROM whole w LEFT JOIN p ON p.file = w.file",
    parts=PARTS, whole=WHOLE,
)
def _(spark, sf):
    return ingest.scene_partition_check(source(spark, sf, PARTS), source(spark, sf, WHOLE))


@query("segment_bounds", "SELECT p.file, start_off, coalesce(lead(start_off) OVER (PARTITION BY p.file ORDER BY start_off), size) AS end_off FROM parts p JOIN whole w ON w.file = p.file", parts=PARTS, whole=WHOLE)
def _(spark, sf):
    return ingest.segment_bounds(source(spark, sf, PARTS), source(spark, sf, WHOLE))


_WANT = "SELECT id, kind, CASE WHEN kind = 'Scene' AND id LIKE '%7' THEN title || ' new' ELSE title END AS title, summary, props, story_from, story_to, CASE WHEN kind = 'Promise' AND reveal_at > 30 THEN NULL ELSE reveal_at END AS reveal_at FROM live_node WHERE id NOT LIKE '%33' UNION ALL SELECT 'concept/c' || id, 'Concept', title, summary, props, story_from, story_to, reveal_at FROM live_node WHERE kind = 'Location'"


@query(
    "snapshot_diff",
    """WITH c AS (SELECT * FROM live_node) SELECT coalesce(c.id, d.id) AS id, CASE WHEN c.id IS NULL THEN 'ADD' ELSE 'INVALIDATE' END AS action, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS from_val, CAST(NULL AS VARCHAR) AS to_val FROM c FULL JOIN want d ON c.id = d.id WHERE c.id IS NULL OR d.id IS NULL
    UNION ALL SELECT c.id, 'UPDATE', 'title', c.title, d.title FROM c JOIN want d ON c.id = d.id WHERE c.title IS DISTINCT FROM d.title
    UNION ALL SELECT c.id, 'UPDATE', 'reveal_at', CAST(c.reveal_at AS VARCHAR), CAST(d.reveal_at AS VARCHAR) FROM c JOIN want d ON c.id = d.id WHERE c.reveal_at IS DISTINCT FROM d.reveal_at""",
    want=_WANT,
)
def _(spark, sf):
    g = graph(spark, sf)
    g.as_views("talegraph_v_")
    return ingest.snapshot_diff(g.live_node, spark.sql(_WANT.replace("live_node", "talegraph_v_live_node")))


@query(
    "set_diff",
    "WITH d AS (SELECT DISTINCT src, rel, CASE WHEN src LIKE '%5' THEN dst || 'x' ELSE dst END AS dst FROM live_edge), c AS (SELECT DISTINCT src, rel, dst FROM live_edge) SELECT *, 'LINK' AS action FROM (SELECT * FROM d EXCEPT SELECT * FROM (SELECT src, rel, dst FROM c) x) y UNION ALL SELECT *, 'UNLINK' FROM (SELECT src, rel, dst FROM c EXCEPT SELECT src, rel, dst FROM d) z",
)
def _(spark, sf):
    e = graph(spark, sf).live_edge
    return ingest.edge_diff(e, e.withColumn("dst", F.when(F.col("src").endswith("5"), F.concat("dst", F.lit("x"))).otherwise(F.col("dst"))))


@query(
    "corpus_upsert",
    "SELECT id, CASE WHEN id LIKE '%7' THEN 1 WHEN id LIKE '%1' THEN rev + 1 ELSE rev END AS rev, CASE WHEN id LIKE '%7' THEN 'inserted' WHEN id LIKE '%1' THEN 'updated' ELSE 'unchanged' END AS change FROM live_node",
)
def _(spark, sf):
    """Ids that end in 7 are new, in 1 changed, in 8 not loaded again."""
    n = graph(spark, sf).live_node.select("id", F.md5("title").alias("cid"), "rev", "tx_from")
    new = n.where("id not like '%8'").select("id", F.when(F.col("id").endswith("1"), F.md5("cid")).otherwise(F.col("cid")).alias("cid"))
    return ingest.corpus_upsert(n.where("id not like '%7'"), new, "2024-03-01 00:00:00").select("id", "rev", "change")


@query(
    "corpus_validate_refs",
    f"SELECT e.src, e.rel, e.dst, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'end is missing' WHEN a.kind <> r.src_kind THEN 'kind of source' ELSE 'kind of target' END AS problem FROM live_edge e LEFT JOIN live_node a ON a.id = e.src LEFT JOIN live_node b ON b.id = e.dst LEFT JOIN ({RELS_SQL}) r ON r.rel = e.rel WHERE a.id IS NULL OR b.id IS NULL OR a.kind <> r.src_kind OR (b.kind <> r.dst_kind AND r.dst_kind <> 'span')",
)
def _(spark, sf):
    g = graph(spark, sf)
    return ingest.edge_refs_check(g.live_node, g.live_edge, rel_dim(spark))


# --- leases -------------------------------------------------------------------------------------------
LEASES = "SELECT 's' || CAST(user_id AS STRING) AS session, CASE WHEN event_id % 4 = 0 THEN 'scene/A' || CAST(event_id % 7 AS STRING) || '.C' || CAST(event_id % 30 AS STRING) || '.*' WHEN event_id % 4 = 1 THEN 'scene/A' || CAST(event_id % 7 AS STRING) || '.*' ELSE 'scene/A' || CAST(event_id % 7 AS STRING) || '.C' || CAST(event_id % 30 AS STRING) || '.S' || CAST(event_id % 3 AS STRING) END AS scope, CASE WHEN event_type = 'error' THEN 'release' ELSE 'acquire' END AS action, 900 * (1 + event_id % 60) AS ttl, ts FROM @events"


@query(
    "lease_state",
    "WITH l AS (SELECT *, row_number() OVER (PARTITION BY session, scope ORDER BY ts DESC) AS n FROM leases WHERE ts <= TIMESTAMP '2024-01-20 00:00:00') SELECT session, scope FROM l WHERE n = 1 AND action <> 'release' AND date_trunc('second', ts) + to_seconds(ttl) > TIMESTAMP '2024-01-20 00:00:00'",
    leases=LEASES,
)
def _(spark, sf):
    return leases.lease_state(source(spark, sf, LEASES), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("session", "scope")


@query(
    "scope_overlap",
    """WITH s AS (SELECT DISTINCT scope, regexp_replace(scope, '\\.\\*$', '') AS base, scope LIKE '%.*' AS wild FROM leases) SELECT a.scope AS a, b.scope AS b FROM s a JOIN s b ON a.base = b.base OR (a.wild AND (starts_with(b.base, a.base || '.') OR starts_with(b.base, a.base || '/'))) OR (b.wild AND (starts_with(a.base, b.base || '.') OR starts_with(a.base, b.base || '/')))""",
    leases=LEASES,
)
def _(spark, sf):
    s = source(spark, sf, LEASES).select("scope").distinct()
    return leases.scope_overlap(s.select(F.col("scope").alias("a"), "scope"), s.select(F.col("scope").alias("b"), "scope"))


@query("lease_grants")
def _(spark, sf):
    return grants.grant_leases(source(spark, sf, LEASES)).outcomes


@query("activity_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return leases.activity_windows(source(spark, sf, "SELECT CAST(ts AS TIMESTAMP) AS ts, event_type FROM @events"))


# --- more views of the log and the graph -----------------------------------------------------------------
@query(
    "provenance",
    "SELECT o.target AS node, CAST(coalesce(c.rev, 0) + row_number() OVER w AS INT) AS rev, coalesce(o.field, '*') AS field, o.proposal AS generated_by, CASE WHEN coalesce(c.rev, 0) + row_number() OVER w > 1 THEN CAST(coalesce(c.rev, 0) + row_number() OVER w - 1 AS INT) END AS derived_from, 'agent' AS origin FROM ops o LEFT JOIN cur c ON c.node = o.target WINDOW w AS (PARTITION BY o.target ORDER BY o.ts, o.proposal, o.seq)",
    **LOG, cur=CURRENT,
)
def _(spark, sf):
    return editlog.provenance(editlog.bump_revisions(ops(spark, sf), source(spark, sf, CURRENT)))


@query("review_queue", f"SELECT o.proposal, last_ts, ops, r.risk FROM (SELECT proposal, max(ts) AS last_ts, string_agg(verb || ':' || target, ',' ORDER BY seq) AS ops FROM ops WHERE proposal NOT IN (SELECT proposal FROM reads WHERE rev = 1) GROUP BY proposal) o LEFT JOIN ({_RISK}) r ON r.proposal = o.proposal", **LOG)
def _(spark, sf):
    o = ops(spark, sf)
    out = editlog.review_queue(o, editlog.risk_assess(graph(spark, sf), o, rel_dim(spark)).select("proposal", "risk"), read_set(spark, sf).where("rev = 1"))
    return out.select("proposal", "last_ts", F.array_join(F.transform("ops", lambda x: F.concat_ws(":", x["verb"], x["target"])), ",").alias("ops"), "risk")


@query("proposal_state", f"SELECT r.proposal, CASE WHEN coalesce(c.n, 0) > 0 THEN 'bad' WHEN r.risk = 'auto' THEN 'ok' WHEN r.risk = 'review' THEN 'warn' ELSE 'bad' END AS state FROM ({_RISK}) r LEFT JOIN (SELECT proposal, count(*) AS n FROM ({_CONFLICTS}) x GROUP BY proposal) c ON c.proposal = r.proposal", **LOG, changes=CHANGES, cur=CURRENT)
def _(spark, sf):
    o = ops(spark, sf)
    met = editlog.detect_conflicts(read_set(spark, sf), o, source(spark, sf, CURRENT), source(spark, sf, CHANGES)).groupBy("proposal").agg(F.count("*").alias("n_conflicts"))
    n = editlog.risk_assess(graph(spark, sf), o, rel_dim(spark)).select("proposal", "risk").join(met, "proposal", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))
    return n.select("proposal", projections.proposal_state().alias("state"))


@query(
    "proposal_impact",
    """WITH RECURSIVE w(run, id, depth) AS (SELECT DISTINCT proposal, target, 0 FROM ops WHERE verb <> 'ADD' UNION SELECT w.run, e.src, w.depth + 1 FROM w JOIN live_edge e ON e.dst = w.id WHERE e.hard AND w.depth < 2) SELECT run, count(DISTINCT id) AS affected FROM w WHERE id IN (SELECT id FROM live_node) GROUP BY run""",
    **LOG,
)
def _(spark, sf):
    asked = ops(spark, sf).where("verb != 'ADD'").select(F.col("proposal").alias("run"), F.col("target").alias("id")).distinct()
    return traverse.impact(graph(spark, sf), asked, 2).select("run", "affected")


_FINDINGS = " UNION ALL ".join(f"SELECT DISTINCT '{name}' AS rule, node, related, detail FROM ({sql}) z" for name, sql in RULE_SQL.items())


@query("agg_open_diag_counts", f"SELECT node, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(list_prepend(node, string_split(coalesce(related, ''), ',')), lambda x: x <> ''))) AS node FROM ({_FINDINGS}) f) q GROUP BY node")
def _(spark, sf):
    return projections.open_diag_counts(rules.check(graph(spark, sf, True), list(RULE_SQL)))


_LINE = {c: t.replace("string", "VARCHAR") for c, t in projections._LINE.items()}


def _page(section: str, table: str, **of: str) -> str:
    """Lines of one section of node_detail, for public nodes."""
    return f"SELECT x.id, {section} AS section, " + ", ".join(f"CAST({of.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _LINE.items()) + f" FROM {table} x JOIN p ON p.id = x.id"


_SELF = {c: f"p.{c}" for c in ("kind", "layer", "title", "summary", "rev", "props", "story_from", "story_to", "reveal_at", "origin", "locked", "tx_from")}
_PAGES = [
    _page("'node'", "(SELECT id, cid, coalesce(i, 0) AS i, coalesce(o, 0) AS o, coalesce(a, 0) + coalesce(b, 0) AS s FROM cids LEFT JOIN (SELECT dst AS id, count(*) AS i, count(*) FILTER (WHERE NOT hard) AS a FROM live_edge GROUP BY dst) y USING (id) LEFT JOIN (SELECT src AS id, count(*) AS o, count(*) FILTER (WHERE NOT hard) AS b FROM live_edge GROUP BY src) z USING (id))", **_SELF, cid="x.cid", n_in="x.i", n_out="x.o", n_soft="x.s"),
    _page("'alias'", "(SELECT node AS id, alias FROM node_alias)", item="alias"),
    _page("'tag'", "(SELECT node AS id, tag FROM node_tag)", item="tag"),
    _page("'viewer'", "(SELECT fact AS id, * FROM visibility)", item="viewer", value="coalesce(CAST(learned_at AS VARCHAR), '-') || ':' || pathway"),
    _page("'span'", "(SELECT node AS id, * FROM evidence)", item="file", value="CAST(start_off AS VARCHAR) || ':' || CAST(end_off AS VARCHAR)"),
    _page("'body'", f"(SELECT node AS id, body FROM ({_BODY}) b)", value="body"),
    *(_page(f"'{way}'", f"(SELECT {here} AS id, {there} AS other, p.kind, p.title, rel, hard, e.story_from, e.story_to FROM live_edge e JOIN p ON p.id = {there})", kind="x.kind", title="x.title", item="other", value="rel", hard="hard", story_from="x.story_from", story_to="x.story_to") for way, here, there in (("in", "dst", "src"), ("out", "src", "dst"))),
    _page("'revision'", "(SELECT node AS id, rev, lag(rev) OVER w AS derived_from, field, proposal, ts, lead(ts) OVER w AS until FROM r WINDOW w AS (PARTITION BY node ORDER BY rev) QUALIFY row_number() OVER (PARTITION BY node ORDER BY rev DESC) <= 50)", rev="x.rev", item="proposal", value="coalesce(field, '*')", derived_from="derived_from", tx_from="ts", tx_to="until"),
]


# the page of a node, a line for each of its parts; its history is what the log does after the revision that the graph holds
@query(
    "node_detail",
    f"""WITH p AS (SELECT n.*, layer FROM live_node n JOIN ({KINDS_SQL}) k ON k.kind = n.kind WHERE NOT internal), cids AS ({_CID}), r AS (SELECT target AS node, coalesce(n.rev, 0) + row_number() OVER (PARTITION BY target ORDER BY ts, proposal, seq) AS rev, field, proposal, ts FROM ops LEFT JOIN live_node n ON n.id = target)
    {" UNION ALL ".join(_PAGES)}""",
    **LOG,
)
def _(spark, sf):
    g = graph(spark, sf)
    made = editlog.bump_revisions(ops(spark, sf), g.live_node.select(F.col("id").alias("node"), "rev")).drop("derived_from", "tx_to")
    return projections.node_detail(g, kind_dim(spark), editlog.content_cid(g), made, ingest.read_span_bytes(source(spark, sf, FILES), g.evidence))


@query("typed_changed", "SELECT id AS node, coalesce(story_from % 2 = 1 OR id LIKE '%9', id LIKE '%9') AS changed FROM live_node")
def _(spark, sf):
    n = graph(spark, sf).live_node.select(F.col("id").alias("node"), "kind", "story_from", "reveal_at")
    now = n.where("node not like '%9'").withColumn("story_from", F.when(F.col("story_from") % 2 == 1, F.col("story_from") + 1).otherwise(F.col("story_from")))
    return cascade.typed_changed(n, now, ["kind", "story_from", "reveal_at"])


WORK = "SELECT CAST(event_id AS STRING) AS job, 'character/c' || CAST(user_id AS STRING) AS target, CAST(1 + user_id % 3 AS INT) AS target_rev, 'character/c' || CAST(user_id + event_id % 3 AS STRING) AS other, CAST(1 AS INT) AS other_rev FROM @events"


@query("job_staleness", "SELECT j.job, a.rev IS NULL OR b.rev IS NULL OR a.rev <> j.target_rev OR b.rev <> j.other_rev AS stale FROM work j LEFT JOIN cur a ON a.node = j.target LEFT JOIN cur b ON b.node = j.other", work=WORK, cur=CURRENT)
def _(spark, sf):
    jobs = source(spark, sf, WORK).withColumn("sources", F.array(F.struct(F.col("other").alias("node"), F.col("other_rev").alias("rev"))))
    return cascade.job_staleness(jobs, source(spark, sf, CURRENT))


@query("payload_refs", "SELECT DISTINCT id, unnest(regexp_extract_all(props, '\"([a-z]+/[^\"]+)\"', 1)) AS ref FROM live_node")
def _(spark, sf):
    return ingest.payload_refs(graph(spark, sf).live_node)


@query("history_last50", "SELECT node, rev, lag(rev) OVER (PARTITION BY node ORDER BY rev) AS derived_from FROM (SELECT target AS node, CAST(row_number() OVER (PARTITION BY target ORDER BY ts, proposal, seq) AS INT) AS rev FROM ops) q QUALIFY row_number() OVER (PARTITION BY node ORDER BY rev DESC) <= 50", **LOG)
def _(spark, sf):
    r = editlog.bump_revisions(ops(spark, sf), spark.createDataFrame([], "node string, rev int"))
    return reads.history(r.select("node", "rev", "tx_from")).select("node", "rev", "derived_from")


@query(
    "lease_conflicts",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY session, scope ORDER BY ts DESC) AS n FROM leases WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'), h AS (SELECT session, scope, regexp_replace(scope, '\\.\\*$', '') AS base, scope LIKE '%.*' AS wild FROM l WHERE n = 1 AND action <> 'release' AND date_trunc('second', ts) + to_seconds(ttl) > TIMESTAMP '2024-01-20 00:00:00')
    SELECT a.session AS "left", b.session AS "right", a.scope AS left_scope, b.scope AS right_scope FROM h a JOIN h b ON a.session < b.session AND (a.base = b.base OR (a.wild AND (starts_with(b.base, a.base || '.') OR starts_with(b.base, a.base || '/'))) OR (b.wild AND (starts_with(a.base, b.base || '.') OR starts_with(a.base, b.base || '/'))))""",
    leases=LEASES,
)
def _(spark, sf):
    held = leases.lease_state(source(spark, sf, LEASES), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return leases.lease_conflicts(held)


@query("manifest_validate", "SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS file, CASE WHEN doc_id % 5 = 0 THEN 'hash differs' ELSE '' END || CASE WHEN doc_id % 15 = 0 THEN ',' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'unresolved names' ELSE '' END AS errors FROM documents")
def _(spark, sf):
    files = source(spark, sf, FILES)
    n = F.substring("file", 5, 20).cast("long")
    made = files.select("file", F.when(n % 5 == 0, F.lit("0")).otherwise(F.sha2("content", 256)).alias("source_sha256"), F.when(n % 3 == 0, F.array(F.lit("someone"))).otherwise(F.array().cast("array<string>")).alias("unresolved"), F.array("file").alias("ids"))
    return ingest.manifest_validate(files, made).withColumn("errors", F.array_join("errors", ","))


# --- payloads -------------------------------------------------------------------------------------------
def _references_sql() -> str:
    parts = []
    for kind, name, part, kinds in payload.references():
        allowed = "[" + ", ".join(f"'{k}'" for k in kinds) + "]::VARCHAR[]"
        if part == "-":
            parts.append(f"SELECT id, 'props.{name}' AS path, props->'$.{name}' AS v, {allowed} AS kinds FROM live_node WHERE kind = '{kind}' AND coalesce(json_type(props->'$.{name}'), 'NULL') <> 'NULL'")
        else:
            value, tail = ("item", "]") if part == "*" else (f"item->'$.{part}'", f"].{part}")
            parts.append(f"SELECT id, 'props.{name}[' || CAST(i AS VARCHAR) || '{tail}' AS path, {value} AS v, {allowed} AS kinds FROM (SELECT id, unnest(json_extract(props, '$.{name}[*]')) AS item, unnest(range(0, len(json_extract(props, '$.{name}[*]')))) AS i FROM live_node WHERE kind = '{kind}') z")
    return " UNION ALL ".join(parts)


@query(
    "reference_errors",
    f"""WITH k AS ({KINDS_SQL}), r AS (SELECT id, path, kinds, CASE WHEN json_type(v) = 'VARCHAR' AND trim(v->>'$') <> '' THEN regexp_replace(v->>'$', '^story://', '') END AS bare FROM ({_references_sql()}) x),
    t AS (SELECT *, CASE WHEN contains(bare, '/') AND lower(split_part(bare, '/', 1)) IN (SELECT lower(kind) FROM k) THEN lower(split_part(bare, '/', 1)) || substr(bare, strpos(bare, '/')) END AS "to" FROM r),
    e AS (SELECT id, path, CASE WHEN bare IS NULL THEN 'a reference is asked for' WHEN "to" IS NULL THEN 'a reference names its kind' WHEN len(kinds) > 0 AND NOT list_contains(kinds, upper(substr("to", 1, 1)) || substr(split_part("to", '/', 1), 2)) THEN 'a reference of another kind' WHEN "to" NOT IN (SELECT id FROM live_node) THEN 'the node is not there' END AS error FROM t)
    SELECT id, path, error FROM e WHERE error IS NOT NULL""",
)
def _(spark, sf):
    g = graph(spark, sf)
    return payload.reference_errors(g, g.live_node.select("id", "kind", "props"), kind_dim(spark))


@query("validate_payloads")
def _(spark, sf):
    g = graph(spark, sf)
    seen = g.visibility.groupBy(F.col("fact").alias("id")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("viewer", "learned_at", "pathway")))).alias("visible_to"))
    spans = g.evidence.groupBy(F.col("node").alias("id")).agg(F.to_json(F.collect_list(F.struct("file", F.col("start_off").alias("start"), F.col("end_off").alias("end"), F.lit("").alias("quote")))).alias("evidence"))
    p = g.live_node.select("id", "kind", "props").join(seen, "id", "left").join(spans, "id", "left")
    return payload.validate_payloads(g, p, kind_dim(spark))


# --- a corpus of files ------------------------------------------------------------------------------------
_NL = " || chr(10) || "
# every customer, supplier and part as a file with a nested header; some are not closed, some name no such edge
MD_FILES = " UNION ALL ".join(
    f"SELECT 'bible/{folder}/{short}' || CAST({key} AS STRING) || '.md' AS path, CAST({key} AS BIGINT) AS k, {name} AS name, {group} AS grp, CAST({nation} AS STRING) AS nation, '---'{_NL}'id: {kind}/{short}' || CAST({key} AS STRING){_NL}'aliases:'{_NL}'  - alias-' || CAST({key} AS STRING){_NL}'tags: [' || lower(replace({group}, ' ', '-')) || ', \"#kept\"]'{_NL}'edges:'{_NL}'  - rel: related'{_NL}'    to: location/n' || CAST({nation} AS STRING){_NL}'  - part_of: location/r1'{_NL}'props:'{_NL}'  group: \"' || {group} || '\"'{_NL}'  where:'{_NL}'    nation: ' || CAST({nation} AS STRING){_NL}CASE WHEN {key} % 40 = 0 THEN '' ELSE '---' END{_NL}'# ' || {name}{_NL}''{_NL}'Text   of ' || {name} AS text FROM {table}"
    for folder, kind, short, key, name, group, nation, table in (("characters", "character", "c", "c_custkey", "c_name", "c_mktsegment", "c_nationkey", "@customer"), ("factions", "faction", "s", "s_suppkey", "s_name", "'SUPPLIER'", "s_nationkey", "@supplier"), ("objects", "object", "p", "p_partkey", "p_name", "p_type", "p_size % 25", "@part"))
)


@query(
    "load_corpus",
    """SELECT path, CASE WHEN k % 40 <> 0 THEN regexp_extract(path, '^bible/(.*)s/', 1) || '/' || regexp_extract(path, '([^/]*)[.]md$', 1) END AS id, CASE WHEN contains(path, 'characters') THEN 'Character' WHEN contains(path, 'factions') THEN 'Faction' ELSE 'Object' END AS kind,
    CASE WHEN k % 40 = 0 THEN regexp_extract(path, '([^/]*)[.]md$', 1) ELSE name END AS title, CASE WHEN k % 40 <> 0 THEN 'Text of ' || name END AS summary, CASE WHEN k % 40 = 0 THEN '' ELSE 'alias-' || CAST(k AS VARCHAR) END AS aliases, CASE WHEN k % 40 = 0 THEN '' ELSE lower(replace(grp, ' ', '-')) || ',#kept' END AS tags,
    CASE WHEN k % 40 = 0 THEN '' ELSE 'related>location/n' || nation || ',part_of>location/r1' END AS edges, CASE WHEN k % 40 <> 0 THEN '{"group":"' || grp || '","where":{"nation":' || nation || '}}' END AS props, CASE WHEN k % 40 = 0 THEN 'the header is not closed' END AS error FROM md_files""",
    md_files=MD_FILES,
)
def _(spark, sf):
    files = source(spark, sf, MD_FILES).select("path", F.encode("text", "UTF-8").alias("content"))
    out = corpus.parse_frontmatter(files)
    return out.select("path", "id", "kind", "title", "summary", joined("aliases"), joined("tags"), F.array_join(F.transform("edges", lambda e: F.concat_ws(">", e["rel"], e["to"])), ",").alias("edges"), "props", "error")


_VECTOR_HASH = "sha256(CAST(to_json([CAST(rev AS VARCHAR), title || chr(10) || summary, 'hashed-ngram-384']) AS VARCHAR))"


@query(
    "sync_vectors",
    f"""WITH d AS (SELECT id, tx_to IS NULL AS live, {_VECTOR_HASH} AS hash FROM node), o AS (SELECT id, CASE WHEN id LIKE '%4' THEN 'other' ELSE hash END AS was FROM d WHERE id NOT LIKE '%3'), n AS (SELECT id, hash FROM d WHERE live)
    SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.hash IS NULL THEN 'remove' WHEN o.was = n.hash THEN 'keep' ELSE 'index' END AS action, n.hash FROM n FULL JOIN o ON o.id = n.id""",
)
def _(spark, sf):
    """Ids that end in 3 have no vector yet, in 4 an old one; nodes that are gone keep theirs until now."""
    docs = graph(spark, sf).node.select("id", F.col("rev").cast("string").alias("cid"), F.concat_ws("\n", "title", "summary").alias("text"), F.col("tx_to").isNull().alias("live"))
    first = corpus.sync_vectors(docs.withColumn("live", F.lit(True)), spark.createDataFrame([], "id string, hash string"))
    old = first.where("id not like '%3'").select("id", F.when(F.col("id").endswith("4"), "other").otherwise(F.col("hash")).alias("hash"))
    return corpus.sync_vectors(docs, old)


_SWEPT = "SELECT *, CASE WHEN status = 'running' AND lease_until <= TIMESTAMP '2024-01-20 00:00:00' THEN CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END ELSE status END AS now FROM jobs"


@query(
    "job_items",
    f"""WITH s AS ({_SWEPT}), x AS (SELECT DISTINCT run, node FROM s WHERE status = 'running' AND now = 'failed'), a AS (SELECT DISTINCT run, node FROM s WHERE now IN ('queued', 'running')), i AS (SELECT DISTINCT run, node FROM jobs)
    SELECT i.run, i.node, CASE WHEN x.run IS NOT NULL AND a.run IS NULL THEN 'blocked' ELSE 'queued' END AS status, CASE WHEN x.run IS NOT NULL AND a.run IS NULL THEN 'a worker''s lease ran out' END AS reason FROM i LEFT JOIN x ON x.run = i.run AND x.node = i.node LEFT JOIN a ON a.run = i.run AND a.node = i.node""",
    jobs=JOBS,
)
def _(spark, sf):
    jobs = source(spark, sf, JOBS)
    return cascade.job_items(jobs, jobs.select("run", "node").distinct().withColumn("status", F.lit("queued")), F.lit("2024-01-20 00:00:00").cast("timestamp"))


@query(
    "job_claims",
    f"WITH s AS ({_SWEPT}) SELECT job, CAST(n - 1 AS INT) AS worker, attempts + 1 AS attempts, TIMESTAMP '2024-01-20 00:05:00' AS lease_until FROM (SELECT *, row_number() OVER (ORDER BY lease_until, job) AS n FROM s WHERE now = 'queued' AND attempts < 3) q WHERE n <= 64",
    jobs=JOBS,
)
def _(spark, sf):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    swept = cascade.job_sweep(source(spark, sf, JOBS), now).withColumn("ts", F.col("lease_until"))
    return cascade.job_claims(swept, 64, now)
