"""Work that must not grow faster than its input, and the same results as plain versions."""

import hashlib
import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from talegraph import model
from talegraph.functions.columns import folded
from talegraph.operators import cascade, editlog, projections, rules, search, traverse, versions
from talegraph.streaming import leases

from test_graph import build, edge, node


def test_ways_to_a_target_do_not_spread_over_a_hub(spark):
    """Every leaf below a hub is asked for: edges met are three a request, not one for each pair of leaves."""
    leaves = [f"scene/o{i}" for i in range(300)]
    g = build(spark, [node("location/r", "Location", "r")], [edge("location/r", "contains", "location/n"), *(edge("location/n", "contains", x) for x in leaves), edge("location/n", "contains", "location/r")])
    asked = spark.createDataFrame([("location/r", x) for x in leaves], "source string, target string")
    steps = traverse.steps_to(g.live_edge, asked.select("target"), 4)
    assert steps.count() == 3 * len(leaves)
    out = traverse.trace(g, asked, ["contains"], 4).collect()
    assert sorted((r.target, r.path, r.n, r.depth) for r in out) == sorted((x, ["location/r", "location/n", x], 1, 2) for x in leaves)


def _impact(edges, asked, most):
    back = {}
    for s, d in edges:
        back.setdefault(d, set()).add(s)
    out = {}
    for run in {r for r, _ in asked}:
        starts = {i for r, i in asked if r == run}
        depth = dict.fromkeys(starts, 0)
        for d in range(1, most + 1):
            depth |= {s: d for at in [x for x, y in depth.items() if y == d - 1] for s in back.get(at, ()) if s not in depth}
        loop = any(s in starts for at, d in depth.items() if d < most for s in back.get(at, ()))
        out[run] = (len(depth), max(depth.values()), loop)
    return out


def test_impact_behind_hubs(spark, monkeypatch):
    """Hubs, single requests and several: as plain breadth-first search; a hub's neighbours are not spread for each run."""
    rnd = random.Random(3)
    names = [f"fact/{i}" for i in range(60)]
    edges = {(rnd.choice(names), names[int(60 * rnd.random() ** 3)]) for _ in range(150)}
    g = build(spark, [node(x, "Fact", x) for x in names], [edge(s, "causes", d) for s, d in edges])
    asked = {(f"r{i}", x) for i, x in enumerate(names)} | {(f"s{i}", x) for i, x in enumerate(names)} | {(f"m{i}", rnd.choice(names)) for i in range(20) for _ in range(3)}
    for most in (1, 2, 3):
        for hub in (2, 5, 1000):
            out = traverse.impact(g, spark.createDataFrame(sorted(asked), "run string, id string"), most, hub).collect()
            assert {r.run: (r.affected, r.max_depth, r.cyclic) for r in out} == _impact(edges, asked, most)
            assert all(r.tokens == 4 * r.affected or r.tokens > 0 for r in out)
    rows = []
    plain = traverse.reach
    monkeypatch.setattr(traverse, "reach", lambda *a: (lambda df: (rows.append(df.count()), df)[1])(plain(*a)))
    many = [f"scene/{i}" for i in range(200)]
    g = build(spark, [node(x, "Scene", x) for x in many] + [node("location/n", "Location", "n")], [edge(x, "occurs_at", "location/n") for x in many] + [edge("location/n", "contains", x) for x in many])
    out = traverse.impact(g, spark.createDataFrame([(x, x) for x in many], "run string, id string"), 2, 100).collect()
    assert {r.affected for r in out} == {201} and sum(rows) == 2 * len(many)


def test_hits_are_merged_when_they_are_many():
    """Small blocks that all hit: merges follow the hits kept, not the blocks; hits are those of a whole sort."""
    rng = np.random.default_rng(5)
    asked, rows, k = rng.normal(size=(300, 6)), rng.normal(size=(6000, 6)), 20
    best = search._Nearest(list(range(300)), asked, rows[:4], k, 100.0)
    to = np.sqrt(((rows - rows[0]) ** 2).sum(1))
    for s in range(0, 6000, 10):
        best.offer(0, np.array([f"x{i}" for i in range(s, s + 10)], object), rows[s : s + 10], to[s : s + 10])
    best.merge()
    assert best.merges < 60
    for q in range(0, 300, 37):
        score = np.round(1 / (1 + np.sqrt(((rows - asked[q]) ** 2).sum(1))), 6)
        want = sorted(zip(-score, (f"x{i}" for i in range(6000)), strict=True))[:k]
        assert [(-s, i) for s, i in zip(best.score[best.at == q], best.ids[best.at == q], strict=True)] == want


def test_conflicts_of_a_hot_scope(spark):
    """Sessions of one scope meet in blocks; pairs are those of a plain product."""
    rows = [(f"s{i:03}", x) for i in range(90) for x in ("scene/A.*", "scene/A.C1" if i % 3 else "scene/B") if i % 7]
    held = spark.createDataFrame([*rows, rows[0], (None, "scene/A.*"), ("s1", None)], "session string, scope string")
    over = {("scene/A.*", "scene/A.*"), ("scene/A.*", "scene/A.C1"), ("scene/A.C1", "scene/A.*"), ("scene/A.C1", "scene/A.C1"), ("scene/B", "scene/B")}
    want = sorted((s, t, x, y) for s, x in rows for t, y in rows if s < t and (x, y) in over)
    for most in (500, 7):
        out = leases.lease_conflicts(held, most)
        assert sorted(tuple(r) for r in out.collect()) == want
    assert out.columns == ["left", "right", "left_scope", "right_scope"]


def test_iterations_of_long_cascades_double(spark, monkeypatch):
    """A chain of 40 is not reached step by step; a cycle, what hangs on it and several triggers still count as before."""
    rows = [(f"a{i:02d}", f"a{i - 1:02d}" if i else None) for i in range(40)]
    rows += [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("m", "a01"), ("m", "a05"), ("n", "m"), ("o", "gone")]
    started = []
    reach = cascade.reach
    monkeypatch.setattr(cascade, "reach", lambda edges, start: started.append({r.run for r in start.collect()}) or reach(edges, start))
    got = {r.proposal: r.iteration for r in cascade.run_iteration(spark.createDataFrame(rows, "proposal string, trigger string")).collect()}
    back, want = {}, {}
    for p, t in rows:
        back.setdefault(p, set()).update({t} - {None})
    for p in back:
        far, now, seen = 0, {p}, {p}
        while now := {t for q in now for t in back.get(q, ())} - seen:
            far, seen = far + 1, seen | now
        want[p] = far + 1
    assert got == want and started == [{"x", "y", "z", "w", "m", "n"}]


def test_reached_walks_single_ways_by_doubling(spark, monkeypatch):
    """Forward sets as plain search, over chains, loops that nothing enters and nodes with several ways in; a chain takes no round a step."""
    rnd = random.Random(8)
    for n in (12, 90):
        edges = {(i, i + 1) for i in range(60)} | {(rnd.randrange(120), rnd.randrange(120)) for _ in range(n)} | {(200, 201), (201, 202), (202, 200), (202, 203)}
        start = {0, 7, *rnd.sample(range(120), 3)}
        want, todo = set(start), list(start)
        while todo:
            at = todo.pop()
            more = {d for s, d in edges if s == at} - want
            want |= more
            todo += more
        names = spark.createDataFrame([(f"scene/{s}", f"scene/{d}") for s, d in sorted(edges)], "src string, dst string")
        out = traverse.reached(names, spark.createDataFrame([(f"scene/{i}",) for i in sorted(start)], "id string")).collect()
        assert sorted(r.id for r in out) == sorted(f"scene/{i}" for i in want)
    written = []
    plain = traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: (written.append(1), plain(df))[1])
    chain = spark.range(300).selectExpr("'s' || id AS src", "'s' || (id + 1) AS dst")
    assert traverse.reached(chain, spark.createDataFrame([("s0",)], "id string")).count() == 301
    assert len(written) < 20


def test_rows_that_cannot_meet_are_left_out_before_a_shuffle(spark):
    """Only edges and nodes whose kind is asked for are read; many kinds, or null, change nothing."""
    g = build(spark, [node(x, x.split("/")[0].title(), x) for x in ("fact/1", "scene/1", "promise/1")], [edge("scene/1", "plants", "promise/1"), edge("fact/1", "causes", "scene/1")])
    ids = spark.createDataFrame([("promise/1",), (None,)], "id string")
    assert [r.id for r in model.among(g.live_node, model.head("id"), ids.select(model.head("id"))).collect()] == ["promise/1"]
    assert model.among(g.live_node, model.head("id"), spark.range(3).selectExpr("'k' || id"), 2).count() == 3
    seeds = spark.createDataFrame([("r", "promise/1", 1.0)], "run string, id string, score double")
    assert [(r.run, r.packed, r.dropped) for r in search.neighborhood(g, seeds).collect()] == [("r", ["promise/1", "scene/1"], 0)]
    asked = spark.createDataFrame([("scene/1", "edge:plants:promise/1"), ("scene/1", "title"), ("gone/1", "title")], "node string, field string")
    assert {(r.node, r.field): r.value for r in versions.base_value(g, asked).collect()} == {("scene/1", "edge:plants:promise/1"): "open", ("scene/1", "title"): "scene/1", ("gone/1", "title"): None}
    assert {r.id: (r.n_in, r.n_out) for r in projections.node_detail(g).collect()} == {"fact/1": (0, 1), "scene/1": (1, 1), "promise/1": (1, 0)}


def test_tasks_are_as_many_as_the_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(model, "TASK_ROWS", 10)
    assert model.dealt(spark.range(5), 5, "id").rdd.getNumPartitions() == 4
    assert model.dealt(spark.range(95), 95, "id").rdd.getNumPartitions() == 10


def test_facts_meet_only_those_of_the_predicates_asked_for(spark, monkeypatch):
    def fact(i, predicate, value):
        return node(f"fact/{i}", "Fact", "f", props=json.dumps({"subject": "character/a", "predicate": predicate, "object": value}))

    g = build(spark, [fact(1, "absolute_time", 1), fact(2, "absolute_time", 2), fact(3, "hand", 1), fact(4, "hand", 2), fact(5, "hand", 2)], [])
    met, plain = [], rules.overlapping
    monkeypatch.setattr(rules, "overlapping", lambda rows, *a: (met.append(rows.count()), plain(rows, *a))[1])
    assert [(r.node, r.related) for r in rules.timeline_absolute(g).collect()] == [("fact/1", ["fact/2", "character/a"])]
    assert sorted((r.node, r.related[0]) for r in rules.detail_appearance(g).collect()) == [("fact/3", "fact/4"), ("fact/3", "fact/5")]
    assert met == [2, 3]


def test_lost_ends_are_found_once(spark, monkeypatch):
    g = build(spark, [node("scene/1", "Scene", "s"), node("scene/2", "Scene", "s")], [edge("scene/1", "causes", "scene/2"), edge("scene/1", "causes", "gone/1"), edge("gone/1", "causes", "scene/1"), edge("gone/1", "causes", "gone/2"), edge("scene/1", "causes", "gone/1")])
    lost, plain = [], rules.cut
    monkeypatch.setattr(rules, "cut", lambda df: (lost.append(sorted(r.id for r in df.collect())), plain(df))[1])
    assert sorted((r.node, r.related) for r in rules.orphan_edge(g).collect()) == [("gone/1", ["gone/2", "causes"]), ("gone/1", ["scene/1", "causes"]), ("scene/1", ["gone/1", "causes"])]
    assert lost == [["gone/1", "gone/2"]]


def test_peeling_and_counting_are_dealt_to_more_tasks(spark, monkeypatch):
    edges = [edge(f"scene/{i}", "causes", f"scene/{i + 1}") for i in range(40)] + [edge("scene/40", "causes", "scene/30")]
    g = build(spark, [node(f"scene/{i}", "Scene", "s") for i in range(41)], edges)
    rels = spark.createDataFrame([("causes", True), ("contains", True)], "rel string, acyclic boolean")
    tasks, plain = [], traverse.dealt
    monkeypatch.setattr(model, "TASK_ROWS", 5)
    monkeypatch.setattr(traverse, "dealt", lambda *a: (lambda df: (tasks.append(df.rdd.getNumPartitions()), df)[1])(plain(*a)))
    assert [tuple(r) for r in traverse.acyclic_check(g, rels).collect()] == [("causes", 11)]
    assert max(tasks) == 9
    within, cut = [], projections.cut
    monkeypatch.setattr(projections, "cut", lambda df: (within.append(spark.conf.get("spark.sql.shuffle.partitions")), cut(df))[1])
    assert {r.id: (r.n_in, r.n_out) for r in projections.node_detail(g).collect()}["scene/30"] == (2, 1)
    assert within == ["9"] and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_content_ids_are_dealt_once_and_hashed_as_a_stream(spark):
    """As a plain version: nodes within a batch and over several, many lines in a part, text to escape."""
    dst = [f'object/{i}"' if i % 9 == 0 else f"object/{i}" for i in range(700)]
    rnd = random.Random(2)
    ways = [("hub/1", "owns", x) for x in dst] + [(f"hub/{rnd.randrange(2, 60)}", "owns", x) for x in dst] + [("gone/1", "owns", "hub/1")]
    g = build(spark, [node(f"hub/{i}", "Faction", f't"{i}') for i in range(1, 61)], [edge(*w) for w in ways])
    want = {}
    for r in g.live_node.collect():
        parts = {}
        for s, rel, d in ways:
            if s == r.id:
                x = json.dumps([rel, d], separators=(",", ":"))
                parts.setdefault(hashlib.md5(x.encode()).hexdigest()[:2], []).append(x)
        out = ",".join(sorted(p + hashlib.md5(",".join(sorted(x)).encode()).hexdigest() for p, x in parts.items()))
        own = ["-" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in (r.id, r.kind, r.title, r.summary, r.props, r.story_from, r.story_to, r.reveal_at, r.locked)]
        want[r.id] = hashlib.sha256(json.dumps([*own, "-", "-", out or "-", "-", "-"], separators=(",", ":")).encode()).hexdigest()
    for rows in (3, 50, 10_000):
        with model.batch_rows(spark, rows):
            out = editlog.content_cid(g)
            assert {r.id: r.cid for r in out.collect()} == want
    assert _exchanges(editlog.content_cid(g)) == 1


def test_ngrams_are_counted_within_the_row(spark):
    """What is shuffled are texts; vectors as by a plain count, texts of one id together."""
    rows = [("a", "Order  12"), ("a", "Or\té\U0001F600x"), ("b", " "), ("c", None), ("d", "x"), (None, "order"), ("e", "abc " * 50)]
    docs = spark.createDataFrame(rows, "id string, text string")
    want = {}
    for i, t in rows:
        words = (t or "").lower().split()
        bare = "".join(words)
        for gram in words + [bare[k : k + n] for n in (2, 3) for k in range(len(bare) - n + 1)]:
            at = (i, int(hashlib.md5(gram.encode()).hexdigest()[:15], 16) % 384)
            want[at] = want.get(at, 0) + 1
    norm = {i: math.sqrt(sum(n * n for (j, _), n in want.items() if j == i)) for i, _ in rows}
    assert {(r.id, r.dim): r.weight for r in search.embed_ngram(docs).collect()} == {(i, d): round(n / norm[i], 8) for (i, d), n in want.items() if i}
    out = search.embed_ngram(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert _exchanges(out) == 1 and plan.index("Generate") < plan.index("Exchange")


def test_terms_are_found_once(spark, monkeypatch):
    """Terms are written and read again; accents are folded as before."""
    texts = spark.createDataFrame([("Ünïcode ÀB",), ("Plain",), (None,), ("e\u0301",)], "t string")
    assert [r[0] for r in texts.select(folded(F.col("t"))).collect()] == ["unicode ab", "plain", None, "e"]
    docs = spark.createDataFrame([("a", "red door", "x"), ("b", "door red", "red door")], "id string, title string, summary string")
    written, plain = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df: (written.append(df.columns), plain(df))[1])
    out = search.find_lexical(docs, spark.createDataFrame([("q", "red")], "q string, text string")).collect()
    assert sorted(r.id for r in out) == ["a", "b"] and ["id", "title", "summary", "len"] in written
