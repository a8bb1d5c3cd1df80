"""Small graphs with expectations worked out by hand."""

import os

import pytest
from pyspark.sql import functions as F

from talegraph.catalog import kind_dim, rel_dim
from talegraph.model import Graph
from talegraph.operators import apply, cascade, editlog, ingest, projections, reads, rules, search, traverse
from talegraph.plans import queries
from talegraph.sources.corpus import parse_frontmatter
from talegraph.streaming import leases

SF = "/root/testdata/sf0.001"
NODE = "id string, kind string, title string, summary string, props string, story_from int, story_to int, reveal_at int, tx_from timestamp, tx_to timestamp, origin string, locked boolean, rev int"
EDGE = "src string, dst string, rel string, hard boolean, story_from int, story_to int, tx_to timestamp, confidence double"


def node(i, kind, title, props="{}", story_from=None, story_to=None, reveal=None, locked=False):
    return (i, kind, title, title, props, story_from, story_to, reveal, None, None, "human", locked, 1)


def edge(src, rel, dst, hard=True, story_from=None, story_to=None):
    return (src, dst, rel, hard, story_from, story_to, None, 1.0)


def build(spark, nodes, edges=(), alias=(), tags=(), visible=()):
    return Graph(
        spark.createDataFrame(list(nodes), NODE),
        spark.createDataFrame(list(edges), EDGE),
        spark.createDataFrame(list(alias), "node string, alias string"),
        spark.createDataFrame(list(tags), "node string, tag string"),
        spark.createDataFrame(list(visible), "fact string, viewer string, learned_at int, pathway string"),
        spark.createDataFrame([], "node string, file string, start_off int, end_off int"),
    )


@pytest.fixture(scope="module")
def base(spark):
    return build(
        spark,
        [
            node("character/a", "Character", "Do Yeong", '{"hand":"left"}', 1, reveal=1),
            node("scene/s", "Scene", "the cove", '{"pre":[{"subject":"character/a","field":"props.hand","op":"eq","value":"left"}]}', 3, reveal=3),
            node("object/g", "Object", "wet glove", reveal=3),
            node("promise/k", "Promise", "hidden key", '{"status":"hypothetical"}', reveal=5),
        ],
        [edge("scene/s", "present_at", "character/a", story_from=3), edge("scene/s", "contains", "object/g"), edge("scene/s", "mentioned_in", "character/a", hard=False)],
        alias=[("character/a", "Keeper")],
        tags=[("character/a", "POV"), ("character/a", "Suspect")],
    )


def ids(df, *cols):
    return sorted(tuple(r) if len(cols) != 1 else r[0] for r in df.select(*cols).collect())


def test_refs_respect_soft_edges_and_time(spark, base):
    asked = spark.createDataFrame([("character/a",)], "id string")
    assert ids(reads.refs(base, asked), "rel") == ["present_at"]
    assert ids(reads.refs(base, asked, include_soft=True), "rel") == ["mentioned_in", "present_at"]
    assert ids(reads.refs(base, asked, as_of=2), "rel") == []


def test_walk_and_outline(spark, base):
    start = spark.createDataFrame([("r", "scene/s")], "run string, id string")
    assert ids(traverse.walk(base, start, rels=["contains"]), "id", "depth") == [("object/g", 1), ("scene/s", 0)]
    assert ids(traverse.outline(base, 1), "id") == ["character/a", "object/g", "promise/k", "scene/s"]


def test_trace_gives_one_simple_path(spark, base):
    asked = spark.createDataFrame([("scene/s", "object/g")], "source string, target string")
    (row,) = traverse.trace(base, asked).collect()
    assert row.path == ["scene/s", "object/g"] and row.rels == ["contains"]


def test_address(spark, base):
    asked = spark.createDataFrame([("keeper",), ("g",), ("wet glove",), ("nobody",), ("glove",)], "ref string")
    out = {r.ref: (r.status, r.id, r.tier) for r in reads.address_resolve(base, asked).collect()}
    assert out == {"keeper": ("ok", "character/a", 3), "g": ("ok", "object/g", 1), "wet glove": ("ok", "object/g", 2), "nobody": ("missing", None, None), "glove": ("ok", "object/g", 4)}


def test_tags_all_of(spark, base):
    assert ids(reads.with_all_tags(base, ["POV", "Suspect"]), "id") == ["character/a"]
    assert ids(reads.with_all_tags(base, ["POV", "Other"]), "id") == []


def test_contract_feasible(base):
    assert [tuple(r) for r in projections.scene_feasible(base).collect()] == [("scene/s", 0, 0, True)]


def test_query_sql_is_read_only(base):
    assert reads.query_sql(base, "SELECT count(*) AS n FROM live_node WHERE kind = :k", k="Scene").first().n == 1
    with pytest.raises(ValueError):
        reads.query_sql(base, "DROP TABLE node")


def test_injected_contradictions(spark):
    fact = '{{"subject":"character/a","predicate":"{}","object":{}}}'
    g = build(
        spark,
        [
            node("character/a", "Character", "A"),
            node("fact/l", "Fact", "left", fact.format("hand", '"left"'), 1, 6),
            node("fact/r", "Fact", "right", fact.format("hand", '"right"'), 3, 8),
            node("fact/1", "Fact", "one", fact.format("count", "1"), 1, 6),
            node("fact/s1", "Fact", "one as text", fact.format("count", '"1"'), 1, 6),
            node("fact/d", "Fact", "dead", fact.format("life_state", '"dead"'), 2),
            node("scene/4", "Scene", "four", '{"claims":[{"speaker":"character/a","fact":"fact/d"}],"post":[{"subject":"x","field":"f","value":1}]}', 4),
            node("rule/x", "Rule", "rule", '{"forbid":[{"subject":"x","field":"f","value":1}]}', locked=True),
            node("promise/p", "Promise", "p", '{"status":"eligible"}'),
            node("promise/q", "Promise", "q"),
        ],
        [edge("scene/4", "present_at", "character/a"), edge("scene/4", "pays_off", "promise/p")],
        visible=[("fact/d", "reader", None, "told")],
    )
    r = rules.RULES
    assert ids(r["detail.appearance"](g), "node", "related") == [("fact/1", ["fact/s1", "character/a"]), ("fact/d", ["scene/4", "character/a"]), ("fact/l", ["fact/r", "character/a"])]
    assert ids(r["character.knowledge"](g), "node") == ["scene/4"]
    assert ids(r["world.core_rule"](g), "node", "related") == [("scene/4", ["rule/x"])]
    assert ids(r["promise.unearned"](g), "node") == ["promise/p"]
    assert ids(r["plot.abandoned"](g), "node") == ["promise/q"]
    assert ids(r["narrative.perspective"](g), "node", "detail") == [("scene/4", "focalizing edges: 0")]


def test_cycles(spark):
    g = build(spark, [node(x, "Scene", x) for x in "abcde"], [edge(a, "causes", b) for a, b in ("ab", "bc", "ca", "cd", "de")])
    assert ids(rules.RULES["graph.causal_cycle"](g), "node") == ["a", "b", "c"]
    assert [tuple(r) for r in traverse.acyclic_check(g, rel_dim(spark)).collect()] == [("causes", 5)]


def test_unreachable_needs_start_and_end(spark):
    nodes = [node("s", "Scene", "s", '{"is_start":true}'), node("e", "Scene", "e", '{"is_end":true}'), node("x", "Event", "x")]
    assert ids(rules.RULES["graph.unreachable"](build(spark, nodes, [edge("s", "causes", "e")])), "node") == ["x"]
    assert ids(rules.RULES["graph.unreachable"](build(spark, nodes[1:])), "node") == []


def test_diag_sync_is_idempotent(base):
    now = rules.check(base, ["plot.abandoned", "narrative.perspective"])
    old = now.select(rules.fingerprint().alias("fingerprint"), "rule")
    assert {r.action for r in rules.diag_sync(now, old).collect()} == {"keep"}


def test_ledger_on_one_scene(spark):
    g = build(spark, [node("scene/s", "Scene", "s", story_from=3), node("promise/p", "Promise", "p", '{"status":"eligible"}')], [edge("scene/s", "plants", "promise/p"), edge("promise/p", "requires_trigger", "scene/s")])
    (row,) = projections.promise_ledger(g).collect()
    assert (row.F, row["T"], row.P, row.delta_coh, row.age, row.debt, row.s_eff) == (["scene/s"], ["scene/s"], [], 1.0, 0, 1.5, 1.0)


def test_visibility(spark):
    g = build(spark, [node("fact/f", "Fact", "f")], visible=[("fact/f", "character/c", 3, "told"), ("fact/f", "reader", 5, "told")])
    asked = spark.createDataFrame([("fact/f", "character/c", 4, False), ("fact/f", "character/c", 6, False)], "fact string, character string, as_of int, spoken boolean")
    out = {r.as_of: (r.dramatic_irony, r.mystery, r.twist) for r in projections.visibility_classify(g, asked).collect()}
    assert out == {4: (False, True, True), 6: (False, False, False)}


def test_conflicts_merge_when_fields_differ(spark):
    reads_ = spark.createDataFrame([("p", "n", 1), ("q", "n", 1)], "proposal string, node string, rev int")
    ops = spark.createDataFrame([("p", 1, "UPDATE", "n", "title", None, "x", 1, "k1", None), ("q", 1, "UPDATE", "n", "summary", None, "x", 1, "k2", None)], "proposal string, seq int, verb string, target string, field string, from_val string, to_val string, basis_rev int, idem_key string, ts timestamp")
    current = spark.createDataFrame([("n", 2)], "node string, rev int")
    changes = spark.createDataFrame([("n", 2, "title")], "node string, rev int, field string")
    assert [tuple(r) for r in editlog.detect_conflicts(reads_, ops, current, changes).collect()] == [("p", "n", "revision_mismatch")]


def test_commit_batch_is_serial(spark):
    rows = [("p1", 1, "UPDATE", "a", "x"), ("p2", 1, "UPDATE", "a", "x"), ("p3", 1, "UPDATE", "a", "y"), ("p4", 1, "UPDATE", "b", "x"), ("p5", 1, "INVALIDATE", "b", None), ("p6", 1, "UPDATE", "b", "z")]
    ops = spark.createDataFrame([(*r, "v") for r in rows], "proposal string, seq int, verb string, target string, field string, to_val string")
    seen = spark.createDataFrame([(p, n, 1) for p, _, _, n, _ in rows], "proposal string, node string, rev int")
    order = spark.createDataFrame([(f"p{i}", i) for i in range(1, 7)], "proposal string, commit_seq int")
    current = spark.createDataFrame([("a", 1), ("b", 1)], "node string, rev int").withColumn("fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))
    out = {r.proposal: r.status for r in editlog.commit_batch(ops, seen, order, current).collect()}
    assert out == {"p1": "accepted", "p2": "rejected", "p3": "accepted", "p4": "accepted", "p5": "rejected", "p6": "accepted"}


def test_risk(spark, base):
    ops = spark.createDataFrame([("p", 1, "UPDATE", "character/a", "props.hand", "x"), ("q", 1, "ADD", "concept/c", None, None), ("r", 1, "LINK", "scene/s", "contradicts", "object/g")], "proposal string, seq int, verb string, target string, field string, to_val string")
    out = {r.proposal: (r.risk, r.reasons) for r in editlog.risk_assess(base, ops, rel_dim(spark)).collect()}
    assert out == {"p": ("review", ["existing-value-change"]), "q": ("auto", ["new-node"]), "r": ("always", ["contradiction-edge", "hard-link"])}


def test_splitter_and_partition(spark):
    text = "## one\nbody\n***\nmore\n## two\n".encode()
    files = spark.createDataFrame([("f", bytearray(text))], "file string, content binary")
    spans = ingest.scene_split(files)
    assert ids(spans, "start_off", "end_off") == [(0, 12), (12, 21), (21, 28)]
    sizes = files.select("file", F.octet_length("content").alias("size"))
    assert ingest.scene_partition_check(spans, sizes).first().tiles
    assert not ingest.scene_partition_check(spans.where("start_off != 12"), sizes).first().tiles


def test_spans(spark):
    files = spark.createDataFrame([("f", bytearray("añb".encode()))], "file string, content binary")
    spans = spark.createDataFrame([("ok", "f", 0, 3, "añ"), ("cut", "f", 0, 2, "a"), ("far", "f", 0, 9, "a"), ("differs", "f", 0, 1, "b")], "node string, file string, start_off int, end_off int, quote string")
    out = {r.node: r.problem for r in ingest.span_validate(files, spans).collect()}
    assert out == {"ok": None, "cut": "splits a character", "far": "outside the file", "differs": "quote differs"}


def test_frontmatter(spark):
    text = "---\r\ntitle: The Key\r\naliases: [old key]\r\nedges:\r\n  - plants: promise/k\r\n---\r\n# The Key\r\n\r\nA  small   key.\r\n"
    files = spark.createDataFrame([("/x/objects/key.md", bytearray(text.encode()))], "path string, content binary")
    (r,) = parse_frontmatter(files).collect()
    assert (r.id, r.kind, r.title, r.summary, r.aliases, [tuple(e) for e in r.edges]) == ("object/TheKey", "Object", "The Key", "A small key.", ["old key"], [("plants", "promise/k")])


def test_scopes(spark):
    left = spark.createDataFrame([("scene/A2.C14.*",)], "scope string").select(F.col("scope").alias("a"), "scope")
    right = spark.createDataFrame([("scene/A2.C14.S03",), ("scene/A2.C15.*",), ("book",)], "scope string").select(F.col("scope").alias("b"), "scope")
    assert ids(leases.scope_overlap(left, right), "b") == ["book", "scene/A2.C14.S03"]


def test_pack_skips_what_does_not_fit(spark, base):
    seeds = spark.createDataFrame([("r", "scene/s", 1.0)], "run string, id string, score double")
    (row,) = search.neighborhood(base, seeds, 12).collect()
    assert row.packed[0] == "scene/s" and row.tokens <= 12 and row.dropped == 3 - len(row.packed)


def test_public_counts(spark, base):
    assert reads.public_nodes(base, kind_dim(spark)).count() == 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not there")
def test_commit_batch_takes_the_whole_log(spark):
    ops, seen, order, current = queries._commit_inputs(spark, SF)
    log = ops.collect()
    assert {"LINK", "UNLINK"} <= {o.verb for o in log}
    by, read = {}, {}
    for o in log:
        by.setdefault(o.proposal, []).append(o)
    for r in seen.collect():
        read.setdefault(r.proposal, []).append((r.node, r.rev))
    rev, moved, want = {r.node: r.rev for r in current.collect()}, {}, {}
    for r in sorted(order.collect(), key=lambda r: r.commit_seq):
        mine = by[r.proposal]

        def fine(node, at, mine=mine):
            own = [o for o in mine if o.target == node]
            apart = own and all(o.verb == "UPDATE" for o in own) and all(moved.get((node, o.field), 0) <= at for o in own)
            return rev.get(node, 0) == at or apart

        want[r.proposal] = "accepted" if all(fine(*x) for x in read.get(r.proposal, [])) else "rejected"
        if want[r.proposal] == "accepted":
            for o in mine:
                rev[o.target] = rev.get(o.target, 0) + 1
            moved |= {(o.target, o.field): rev[o.target] for o in mine if o.field}
    assert {r.proposal: r.status for r in editlog.commit_batch(ops, seen, order, current).collect()} == want


OPS = "proposal string, seq int, verb string, target string, field string, to_val string, ts timestamp"


def test_the_log_applied(spark, base):
    at = lambda n: __import__("datetime").datetime(2024, 1, n)
    rows = [
        ("p1", 1, "UPDATE", "character/a", "props.hand", "right", at(1)), ("p1", 2, "UPDATE", "character/a", "props.hand", "none", at(2)), ("p1", 3, "UPDATE", "character/a", "title", "Do-Yeong", at(2)),
        ("p2", 1, "ADD", "concept/c", None, None, at(3)), ("p2", 2, "LINK", "scene/s", "ally_of", "concept/c", at(3)),
        ("p3", 1, "INVALIDATE", "object/g", None, None, at(4)),
        ("p4", 1, "UNLINK", "scene/s", "present_at", "character/a", at(5)),
        ("bad1", 1, "UPDATE", "promise/k", "props.status", "actualized", at(6)), ("bad2", 1, "ADD", "scene/s", None, None, at(6)), ("bad3", 1, "LINK", "scene/s", "plants", "character/a", at(6)),
        ("bad4", 1, "UPDATE", "nobody", "title", "x", at(6)), ("bad5", 1, "UPDATE", "character/a", "id", "x", at(6)), ("bad6", 1, "UNLINK", "scene/s", "causes", "object/g", at(6)),
    ]
    ops = spark.createDataFrame(rows, OPS)
    tables = (kind_dim(spark), rel_dim(spark))
    wrong = {r.proposal: r.error for r in apply.validate_ops(base, ops, *tables).collect()}
    assert wrong == {"bad1": "no such step of a promise", "bad2": "id is in use", "bad3": "kind of the other end does not fit", "bad4": "target is not there", "bad5": "field cannot be set", "bad6": "edge is not there"}
    assert {r.proposal for r in apply.simulate(base, ops, *tables).where("valid").collect()} == {"p1", "p2", "p3", "p4"}
    sound = apply.sound_ops(base, ops, *tables)
    nodes = {r.id: r for r in apply.apply_nodes(base, sound).collect()}
    assert (nodes["character/a"].title, nodes["character/a"].props, nodes["character/a"].rev) == ("Do-Yeong", '{"hand":"none"}', 4)
    assert nodes["concept/c"].kind == "Concept" and nodes["object/g"].tx_to == at(4)
    assert nodes["scene/s"].rev == 1 + 2 + 1  # two links, and a neighbour that went
    edges = {(r.rel, r.dst): r for r in apply.apply_edges(base, sound).collect()}
    assert edges["ally_of", "concept/c"].opened_by == "p2" and edges["ally_of", "concept/c"].tx_to is None
    assert edges["present_at", "character/a"].tx_to == at(5) and edges["contains", "object/g"].tx_to == at(4)


def test_cascade_parts(spark, base):
    items = spark.createDataFrame([("r", x) for x in "abc"] + [("q", "a"), ("q", "b")], "run string, node string")
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    assert ids(cascade.propagate_cycles(items, deps), "run", "node") == [("r", "a"), ("r", "b"), ("r", "c")]
    chain = spark.createDataFrame([("x", None), ("y", "x"), ("z", "y"), ("u", "v"), ("v", "u")], "proposal string, trigger string")
    assert ids(cascade.run_iteration(chain), "proposal", "iteration") == [("u", 2), ("v", 2), ("x", 1), ("y", 2), ("z", 3)]
    contracts = spark.createDataFrame([("object/g", "character/a", "props.hand", "props.held_by"), ("scene/s", "character/a", "title", "summary"), ("scene/s", "object/g", "title", "summary"), ("promise/k", "scene/s", "title", "title")], "target string, source string, source_field string, target_field string")
    parents = contracts.select("source", "target").where("target != 'promise/k'")
    clean = spark.createDataFrame([], "node string")
    assert ids(cascade.derive_candidates(base, contracts, parents, clean), "target", "field", "to_val") == [("object/g", "props.held_by", "left")]
    assert cascade.derive_candidates(base, contracts, parents, spark.createDataFrame([("character/a",)], "node string")).count() == 0
    jobs = spark.createDataFrame([("j", "n", "f", 1)], "job string, target string, field string, basis_rev int")
    done = spark.createDataFrame([("two", 1, "UPDATE", "n", "f", 1, None), ("two", 2, "UPDATE", "n", "g", 1, None), ("one", 1, "UPDATE", "n", "f", 1, None)], "proposal string, seq int, verb string, target string, field string, basis_rev int, ts timestamp")
    assert ids(cascade.job_recover(jobs, done), "job", "proposal") == [("j", "one")]


def test_budget_of_jobs(spark):
    asks = spark.createDataFrame([(x, ["s"], "f", 9000) for x in "abcd"], "target string, sources array<string>, target_field string, max_tokens int")
    items = spark.createDataFrame([("r", "a", 1), ("r", "b", 1), ("r", "c", 2), ("r", "d", 3)], "run string, node string, depth int")
    parents = spark.createDataFrame([("s", x) for x in "abcd"], "source string, target string")
    human = spark.createDataFrame([(x, 1) for x in "abcd"], "node string, rev int")
    out = {r.target: r.status for r in cascade.rederive_jobs(asks, items, parents, human).collect()}
    assert out == {"a": "queued", "b": "queued", "c": "over budget", "d": "too deep"}


def test_stream_keeps_keys_across_batches(spark, tmp_path):
    schema = "proposal string, seq int, verb string, target string, field string, to_val string, idem_key string, ts timestamp"
    at = __import__("datetime").datetime(2024, 1, 1)
    got = []

    def batch(*rows):
        spark.createDataFrame([(p, 1, "UPDATE", t, "f", "v", k, at) for p, t, k in rows], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        leases.op_stream(stream, lambda df, n: got.extend(sorted(r.proposal for r in df.collect())), f"{tmp_path}/at", f"{tmp_path}/keys").awaitTermination()

    batch(("p", "n", "key-1"), ("q", "n", "key-2"))
    batch(("p2", "n", "key-1"), ("r", "n", "key-3"), ("s", "other", "key-2"))
    assert got == ["p", "q", "r"]


def test_bodies_and_rules(spark, base):
    files = spark.createDataFrame([("f", bytearray(b"one two"))], "file string, content binary")
    spans = spark.createDataFrame([("character/a", "f", 0, 3), ("promise/k", "f", 4, 7)], "node string, file string, start_off int, end_off int")
    g = Graph(base.node, base.edge, base.node_alias, base.node_tag, base.visibility, spans)
    asked = spark.createDataFrame([(1, "character/a"), (2, "promise/k")], "pos long, id string")
    assert ids(reads.get_body(g, asked, files, 3), "id", "body", "hidden") == [("character/a", "one", False), ("promise/k", None, True)]
    from talegraph.catalog import rule_dim

    assert rules.rule_spec_check(rule_dim(spark), list(rules.RULES)).count() == 0
    assert ids(rules.rule_spec_check(rule_dim(spark), [*list(rules.RULES)[1:], "made.up"]), "problem") == ["no query", "not in the catalogue"]


def test_manifests(spark, tmp_path):
    from talegraph.sources.corpus import read_manifests

    (tmp_path / "one.md").write_text("## a\ntext")
    (tmp_path / "one.story.json").write_text('{"schema_version": 1, "nodes": [{"id": "scene/a", "kind": "Scene", "start_off": 0, "end_off": 9}]}')
    (tmp_path / "two.md").write_text("none")
    out = {r.file: r.manifest for r in read_manifests(spark, str(tmp_path)).collect()}
    assert out["two"] is None and out["one"].nodes[0].end_off == 9
