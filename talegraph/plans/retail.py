"""The given retail and text tables as a graph.

The SQL is valid in Spark and in DuckDB; @name stands for a given table.  Both the queries
and their check SQL begin from this text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..model import Graph, written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "conversations")

_MONTH = "(year({d}) - 1995) * 12 + month({d})"
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
_TX = "CAST('2024-01-01 00:00:00' AS TIMESTAMP)"
_OPEN = "CAST(NULL AS TIMESTAMP)"
_NONE = "CAST(NULL AS INT)"


def _node(kind: str, ident: str, title: str, table: str, props: str = "'{}'", story_from: str = _NONE, story_to: str = _NONE, reveal: str = _NONE, locked: str = "false", closed: str = "false", rev: str = "1") -> str:
    return (
        f"SELECT {ident} AS id, '{kind}' AS kind, {title} AS title, {title} || ' of ' || '{kind}' AS summary, {props} AS props, "
        f"CAST({story_from} AS INT) AS story_from, CAST({story_to} AS INT) AS story_to, CAST({reveal} AS INT) AS reveal_at, {_TX} AS tx_from, "
        f"CASE WHEN {closed} THEN CAST('2024-02-01 00:00:00' AS TIMESTAMP) ELSE {_OPEN} END AS tx_to, 'human' AS origin, {locked} AS locked, CAST({rev} AS INT) AS rev FROM {table}"
    )


_O = "CAST(o_orderkey AS STRING)"
_SCENE_PROPS = (
    "'{\"priority\":\"' || o_orderpriority || '\",\"word_count\":' || CAST(o_orderkey % 900 + 100 AS STRING)"
    " || CASE WHEN o_orderkey % 5 = 0 THEN ',\"expect_cause\":true' ELSE '' END"
    " || CASE WHEN o_orderkey % 97 = 0 THEN ',\"is_start\":true' ELSE '' END"
    " || CASE WHEN o_orderkey % 89 = 0 THEN ',\"is_end\":true' ELSE '' END"
    " || ',\"claims\":[{\"speaker\":\"character/c' || CAST(o_orderkey % 150 AS STRING) || '\",\"fact\":\"fact/e' || " + _O + " || '\"}]'"
    " || ',\"mentions\":[{\"entity\":\"character/c' || CAST(o_custkey AS STRING) || '\",\"name\":\"' || CASE WHEN o_orderkey % 3 = 0 THEN 'alias-' || CAST(o_custkey AS STRING) WHEN o_orderkey % 3 = 1 THEN 'someone' ELSE 'c' || CAST(o_custkey % 40 AS STRING) END || '\"}]'"
    " || ',\"post\":[{\"subject\":\"location/n' || CAST(o_orderkey % 25 AS STRING) || '\",\"field\":\"status\",\"value\":' || CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '\"1\"' END || '}]'"
    " || ',\"pre\":[{\"subject\":\"character/c' || CAST(o_custkey AS STRING) || '\",\"field\":\"props.segment\",\"op\":\"' || CASE WHEN o_orderkey % 4 = 0 THEN 'ne' WHEN o_orderkey % 4 = 1 THEN 'exists' ELSE 'eq' END || '\",\"value\":\"MACHINERY\"}]}'"
)

NODE_SQL = " UNION ALL ".join([
    _node("Location", "'location/r' || CAST(r_regionkey AS STRING)", "r_name", "@region"),
    _node("Location", "'location/n' || CAST(n_nationkey AS STRING)", "n_name", "@nation"),
    _node("Rule", "'rule/n' || CAST(n_nationkey AS STRING)", "'rule of ' || n_name", "@nation", "'{\"forbid\":[{\"subject\":\"location/n' || CAST(n_nationkey AS STRING) || '\",\"field\":\"status\",\"value\":1}]}'", locked="n_nationkey % 5 <> 0"),
    _node("Character", "'character/c' || CAST(c_custkey AS STRING)", "c_name", "@customer", "'{\"segment\":\"' || c_mktsegment || '\"}'"),
    _node("Faction", "'faction/s' || CAST(s_suppkey AS STRING)", "s_name", "@supplier"),
    _node("Object", "'object/p' || CAST(p_partkey AS STRING)", "p_name || ' ' || CAST(p_partkey AS STRING)", "@part", "'{\"size\":' || CAST(p_size AS STRING) || '}'", locked="p_size % 10 = 0", closed="p_size % 17 = 0"),
    _node("Scene", "'scene/o' || " + _O, "'order ' || " + _O, "(SELECT o.*, s.ship FROM @orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS ship FROM @lineitem GROUP BY l_orderkey) s ON o.o_orderkey = s.l_orderkey) q", _SCENE_PROPS, _MONTH.format(d="o_orderdate"), _MONTH.format(d="o_orderdate") + " + o_orderkey % 3", f"CASE WHEN ship IS NULL THEN NULL ELSE {_MONTH.format(d='ship')} END"),
    _node("Promise", "'promise/p' || CAST(p_partkey AS STRING)", "'promise of ' || p_name", "@part", "CASE WHEN p_size % 11 = 0 THEN '{}' ELSE '{\"status\":\"' || CASE p_size % 4 WHEN 0 THEN 'hypothetical' WHEN 1 THEN 'eligible' WHEN 2 THEN 'actualized' ELSE 'prevented' END || '\"' || CASE WHEN p_size % 7 = 0 THEN ',\"debt\":' || CAST(p_size AS STRING) ELSE '' END || '}' END", reveal="p_size"),
    _node("Fact", "'fact/e' || CAST(event_id AS STRING)", "event_type || ' ' || CAST(event_id AS STRING)", "@events", "'{\"subject\":\"character/c' || CAST(user_id AS STRING) || '\",\"predicate\":\"' || CASE event_type WHEN 'error' THEN 'absolute_time' WHEN 'signup' THEN 'life_state' ELSE event_type END || '\",\"object\":' || CASE WHEN event_type = 'signup' AND event_id % 40 = 0 THEN '\"dead\"' ELSE CAST(" + _K + " % 5 AS STRING) END || '}'", "day(ts)", f"day(ts) + {_K} % 3", "day(ts) + 1"),
])


def _edge(rel: str, src: str, dst: str, table: str, hard: str = "true", story_from: str = _NONE, story_to: str = _NONE, closed: str = "false") -> str:
    return f"SELECT {src} AS src, {dst} AS dst, '{rel}' AS rel, {hard} AS hard, CAST({story_from} AS INT) AS story_from, CAST({story_to} AS INT) AS story_to, CASE WHEN {closed} THEN {_TX} ELSE {_OPEN} END AS tx_to, CAST(1.0 AS DOUBLE) AS confidence FROM {table}"


_SCENE, _PROMISE = "'scene/o' || CAST(l_orderkey AS STRING)", "'promise/p' || CAST(l_partkey AS STRING)"
_NEXT = "(SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM @orders) q WHERE b IS NOT NULL"

EDGE_SQL = " UNION ALL ".join([
    _edge("contains", "'location/r' || CAST(n_regionkey AS STRING)", "'location/n' || CAST(n_nationkey AS STRING)", "@nation"),
    _edge("contains", "'location/n' || CAST(c_nationkey AS STRING)", "'character/c' || CAST(c_custkey AS STRING)", "@customer"),
    _edge("contains", "'character/c' || CAST(o_custkey AS STRING)", "'scene/o' || " + _O, "@orders", hard="o_orderkey % 50 <> 0"),
    _edge("present_at", "'scene/o' || " + _O, "'character/c' || CAST(o_custkey AS STRING)", "@orders", story_from=_MONTH.format(d="o_orderdate"), closed="o_orderkey % 31 = 0"),
    _edge("occurs_at", "'scene/o' || " + _O, "'location/n' || CAST(o_orderkey % 25 AS STRING)", "@orders", story_from=_MONTH.format(d="o_orderdate"), story_to=_MONTH.format(d="o_orderdate") + " + 6"),
    _edge("focalizes", "'character/c' || CAST(o_custkey AS STRING)", "'scene/o' || " + _O, "@orders WHERE o_orderkey % 4 <> 0"),
    _edge("focalizes", "'character/c' || CAST(o_orderkey % 150 AS STRING)", "'scene/o' || " + _O, "@orders WHERE o_orderkey % 9 = 0"),
    _edge("mentioned_in", "'character/c' || CAST(o_orderkey % 150 AS STRING)", "'scene/o' || " + _O, "@orders WHERE o_orderkey % 7 = 0", hard="false"),
    _edge("plants", _SCENE, _PROMISE, "(SELECT DISTINCT l_orderkey, l_partkey FROM @lineitem WHERE l_linenumber = 1) q"),
    _edge("requires_trigger", _PROMISE, _SCENE, "(SELECT DISTINCT l_orderkey, l_partkey FROM @lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2) q"),
    _edge("pays_off", _SCENE, _PROMISE, "(SELECT DISTINCT l_orderkey, l_partkey FROM @lineitem WHERE l_returnflag = 'A' AND l_linenumber = 3) q"),
    _edge("causes", "'scene/o' || CAST(a AS STRING)", "'scene/o' || CAST(b AS STRING)", _NEXT),
    _edge("owns", "'faction/s' || CAST(s AS STRING)", "'object/p' || CAST(p AS STRING)", "(SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM @lineitem WHERE l_linenumber = 4) q"),
    _edge("performs", "'faction/s' || CAST(l_suppkey AS STRING)", _SCENE, "(SELECT DISTINCT l_suppkey, l_orderkey FROM @lineitem WHERE l_linenumber = 1 AND l_quantity >= 49) q"),
    _edge("causes", "'scene/o' || CAST(b AS STRING)", "'scene/o' || CAST(a AS STRING)", _NEXT + " AND a % 100 = 0"),
])

ALIAS_SQL = "SELECT 'character/c' || CAST(c_custkey AS STRING) AS node, 'alias-' || CAST(c_custkey AS STRING) AS alias FROM @customer UNION ALL SELECT 'character/c' || CAST(c_custkey AS STRING), 'c' || CAST(c_custkey % 40 AS STRING) FROM @customer WHERE c_custkey % 2 = 0"
TAG_SQL = "SELECT 'character/c' || CAST(c_custkey AS STRING) AS node, c_mktsegment AS tag FROM @customer UNION ALL SELECT 'scene/o' || CAST(o_orderkey AS STRING), 'status-' || o_orderstatus FROM @orders UNION ALL SELECT 'character/c' || CAST(c_custkey AS STRING), 'rich' FROM @customer WHERE c_acctbal > 5000"
VISIBILITY_SQL = (
    "SELECT 'fact/e' || CAST(event_id AS STRING) AS fact, 'character/c' || CAST(user_id + 1 AS STRING) AS viewer, CAST(day(ts) AS INT) AS learned_at, 'told' AS pathway FROM @events"
    " UNION ALL SELECT 'fact/e' || CAST(event_id AS STRING), 'character/c' || CAST(event_id % 150 AS STRING), CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE day(ts) + 40 * (event_id % 3) END AS INT), 'direct' FROM @events WHERE event_id % 2 = 0"
    " UNION ALL SELECT 'fact/e' || CAST(event_id AS STRING), 'reader', CAST(day(ts) + 2 AS INT), 'common' FROM @events WHERE event_id % 3 = 0"
)
EVIDENCE_SQL = "SELECT 'fact/e' || CAST(d.doc_id AS STRING) AS node, 'doc-' || CAST(d.doc_id AS STRING) AS file, CAST(d.doc_id % 7 AS INT) AS start_off, CAST(d.doc_id % 7 + 40 AS INT) AS end_off FROM @documents d"

GRAPH_SQL = {"node": NODE_SQL, "edge": EDGE_SQL, "node_alias": ALIAS_SQL, "node_tag": TAG_SQL, "visibility": VISIBILITY_SQL, "evidence": EVIDENCE_SQL}


def source(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the given tables of a folder."""
    for t in set(re.findall(r"@(\w+)", sql)):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"talegraph_{t}")
    return spark.sql(re.sub(r"@(\w+)", r"talegraph_\1", sql))


def graph(spark: SparkSession, sf_dir: str, many: bool = False) -> Graph:
    """many: for queries that read nodes and edges many times, which are then written once."""
    g = Graph(**{name: source(spark, sf_dir, sql) for name, sql in GRAPH_SQL.items()})
    return written(g) if many else g


def checked(body: str, **more: str) -> str:
    """DuckDB SQL: the graph tables that body names, as common table expressions, then body."""
    views = GRAPH_SQL | {"live_node": "SELECT * FROM node WHERE tx_to IS NULL", "live_edge": "SELECT * FROM edge WHERE tx_to IS NULL"} | more
    need: list[str] = []

    def want(text: str) -> None:
        for name in views:
            if re.search(rf"\b{name}\b", text) and name not in need:
                inner = views[name]
                if name in more or name.startswith("live_"):
                    want(inner)
                need.append(name)

    want(body)
    ctes = ", ".join(f"{name} AS ({views[name]})" for name in need)
    lead = "WITH RECURSIVE "
    body = body.strip()
    if not need:
        return re.sub(r"@(\w+)", r"\1", body)
    if body.upper().startswith(lead):
        body = ", " + body[len(lead):]
    elif body.upper().startswith("WITH "):
        body = ", " + body[5:]
    text = f"{lead}{ctes} {body}"
    return re.sub(r"@(\w+)", r"\1", text)
