"""Whole jobs and growth, as the findings of round 4 ask."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from talegraph.catalog import kind_dim
from talegraph.llm import op10_embeddings
from talegraph.operators import cascade, payload, projections

from test_graph import build, edge, node

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not there")


@given
def test_impact_goes_as_deep_as_the_method(spark):
    """Three steps, the default of the method, and not two."""
    deepest = entry.queries()["impact"](spark, SF).agg({"max_depth": "max"}).first()[0]
    assert deepest == 3 and "depth < 3" in entry.oracle_sql()["impact"]


def test_node_detail_is_the_whole_page(spark):
    """The node, its parts, references to public nodes both ways and the newest revisions; internal kinds are hidden."""
    nodes = [node("scene/1", "Scene", "s"), node("fact/1", "Fact", "f"), node("session/1", "Session", "x")]
    g = build(spark, nodes, [edge("scene/1", "plants", "fact/1"), edge("session/1", "causes", "fact/1"), edge("fact/1", "causes", "gone/1")], tags=[("fact/1", "t"), ("session/1", "t")])
    log = [("fact/1", i, f"props.f{i}", f"p{i}") for i in range(2, 55)] + [("session/1", 2, "title", "p")]
    made = spark.createDataFrame(log, "node string, rev int, field string, proposal string").withColumn("tx_from", F.timestamp_seconds("rev"))
    cids = g.live_node.select("id", F.concat(F.lit("c"), "id").alias("cid"))
    bodies = spark.createDataFrame([("fact/1", "told")], "node string, body string")
    out = projections.node_detail(g, kind_dim(spark), cids, made, bodies).collect()
    assert {r.id for r in out} == {"scene/1", "fact/1"}
    mine = [r for r in out if r.id == "fact/1"]
    (own,) = [r for r in mine if r.section == "node"]
    assert (own.kind, own.layer, own.title, own.cid, own.n_in, own.n_out) == ("Fact", "device", "f", "cfact/1", 2, 1)
    assert sorted((r.section, r.item, r.value, r.kind) for r in mine if r.section not in ("node", "revision")) == [("body", None, "told", None), ("in", "scene/1", "plants", "Scene"), ("tag", "t", None, None)]
    past = sorted((r.rev, r.value, r.item, r.derived_from) for r in mine if r.section == "revision")
    assert len(past) == 50 and past[0] == (5, "props.f5", "p5", 4) and past[-1] == (54, "props.f54", "p54", 53)


def test_a_run_goes_as_far_as_it_leads(spark):
    """Without bounds, by steps that double, as a plain walk; several triggers in a run go round by round."""
    rnd = random.Random(5)
    for n, m, two in ((30, 45, True), (30, 45, False), (60, 59, False)):
        names = [f"scene/{i}" for i in range(n)]
        links = {(names[i], names[i + 1]) for i in range(min(n - 1, m))} if n == 60 else {(rnd.choice(names), rnd.choice(names)) for _ in range(m)}
        links |= {(x, f"gone/{i}") for i, x in enumerate(names[::7])}
        shut = {names[i] for i in (40, 41)} if n == 60 else {names[3]}
        g = build(spark, [node(x, "Scene", x, locked=x in shut) for x in names])
        starts = [(f"r{i}", names[i]) for i in range(0, n, 5)] + ([("two", names[0]), ("two", names[9])] if two else [])
        changed = {x for x in names if x != names[5]}
        want = set()
        for run in {r for r, _ in starts}:
            mine = {x for r, x in starts if r == run}
            depth, front = dict.fromkeys(mine, 0), mine & changed
            while front:
                new = {t for s, t in links if s in front} - depth.keys()
                depth |= dict.fromkeys(new, max(depth[x] for x in front) + 1)
                front = {x for x in new if x in names and x not in shut}
            want |= {(run, x, d, "cutoff" if x not in names else "skipped" if x in shut else "dirty") for x, d in depth.items() if d}
        args = spark.createDataFrame(sorted(links), "source string, target string"), spark.createDataFrame(starts, "run string, node string"), spark.createDataFrame([(x,) for x in changed], "node string")
        out = [tuple(r) for r in cascade.propagate(g, *args, None, None).collect()]
        assert len(out) == len(want) and set(out) == want
    assert {d for _, _, d, _ in want} > {4}


@given
def test_propagate_cutoff_has_no_bounds(spark):
    deepest = entry.queries()["propagate_cutoff"](spark, SF).agg({"depth": "max"}).first()[0]
    assert deepest > 3 and "blocked" not in entry.oracle_sql()["propagate_cutoff"]


def test_payloads_are_written_once(spark):
    """What makes the payloads is run once, and each rule reads the files of the kinds that it asks for only; odd kinds stay as they are."""
    g = build(spark, [node("scene/1", "Scene", "s")])
    runs = spark.sparkContext.accumulator(0)
    rows = [("scene/1", "Scene", '{"claims":1}', None), ("x/1", "", "{}", '["reader"]'), ("x/2", None, "{}", '["reader"]'), ("fact/1", "Fact", '{"subject":"scene/1","predicate":"p","object":1}', '["reader"]')]
    made = spark.createDataFrame(rows, "id string, kind string, props string, visible_to string").withColumn("evidence", F.lit(None).cast("string"))
    tally = F.udf(lambda x: (runs.add(1), x)[1], "string").asNondeterministic()
    out = payload.validate_payloads(g, made.withColumn("props", tally("props")), kind_dim(spark))
    got = {tuple(r) for r in out.collect()}
    assert got == {("scene/1", "props.claims", "a list is asked for"), ("x/1", "visible_to", "for facts only")}
    assert runs.value == 4


def test_a_task_holds_few_shards_of_bounded_size(spark, monkeypatch):
    """Shards are built, and queried, in as many tasks as there are shards and blocks; what a group opens is not copied."""
    assert op10_embeddings.SHARD_ROWS <= 32_000
    monkeypatch.setattr(op10_embeddings, "BLOCK_ROWS", 40)
    dealt, plain = [], type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, n, *c: (dealt.append(n), plain(self, n, *c))[1])
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    x[100:110] = x[0:10] * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.id: r for r in op10_embeddings.near_vectors(df, shards=2, shard_rows=20).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert sum(r.n_links for r in out.values()) == int((u @ u.T >= 0.9).sum()) - 200
    assert dealt == [10, 13, 13]
    row = pa.table({"k": pa.array([np.arange(2).tobytes()], pa.binary())})
    k = op10_embeddings._at(row, "k", np.int64)
    assert k.tolist() == [0, 1] and k.ctypes.data == row["k"].chunk(0).buffers()[2].address
