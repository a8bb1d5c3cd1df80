"""The ordered commit against a serial one."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from talegraph.catalog import kind_dim, rel_dim
from talegraph.model import Graph
from talegraph.operators import commit

NODE = "id string, kind string, title string, summary string, props string, story_from int, story_to int, reveal_at int, tx_from timestamp, tx_to timestamp, origin string, locked boolean, rev int"
EDGE = "src string, dst string, rel string, hard boolean, story_from int, story_to int, tx_to timestamp, confidence double"
OPS = "proposal string, seq int, verb string, target string, field string, from_val string, to_val string, idem_key string"
T0 = datetime.datetime(2024, 1, 1)


def graph(spark, nodes, edges, aliases=(), tags=()):
    return Graph(
        node=spark.createDataFrame([(i, i.split("/")[0].capitalize(), "t " + i, None, json.dumps(p), None, None, None, T0, T0 if shut else None, "human", lock, rev) for i, p, lock, rev, shut in nodes], NODE),
        edge=spark.createDataFrame([(a, b, r, True, None, None, None, 1.0) for a, r, b in edges], EDGE),
        node_alias=spark.createDataFrame(list(aliases), "node string, alias string"), node_tag=spark.createDataFrame(list(tags), "node string, tag string"),
        visibility=spark.createDataFrame([], "fact string, viewer string, learned_at int, pathway string"), evidence=spark.createDataFrame([], "node string, file string, start_off int, end_off int"),
    )


STEPS = {"hypothetical": ("eligible", "prevented"), "eligible": ("actualized", "prevented"), "actualized": ("prevented",)}


def serial(nodes, edges, ops, reads, order):
    """One proposal after another over plain dictionaries."""
    N = {i: {"kind": i.split("/")[0], "props": dict(p), "locked": lock, "rev": rev, "alive": not shut, "title": "t " + i, "moved": {}} for i, p, lock, rev, shut in nodes}
    E = {e: True for e in edges}
    status, revs, spans, keys = {}, [], [[*e, None, None, None] for e in edges], {}
    by = {}
    for o in ops:
        by.setdefault(o[0], []).append(o)
    for p, at in sorted(order, key=lambda x: (x[1], x[0])):
        mine = sorted(by.get(p, []), key=lambda o: o[1])
        owners = [keys.setdefault(o[7], (p, o[2:4] + (o[4] or "", o[6] or ""))) for o in mine]
        if any(w[0] != p for w in owners):
            same = all(w[0] != p and w[1] == o[2:4] + (o[4] or "", o[6] or "") for w, o in zip(owners, mine, strict=True))
            status[p] = ("repeat" if same else "rejected", None, None if same else "key was used for something else")
            continue
        n = {k: dict(v, props=json.loads(json.dumps(v["props"])), moved=dict(v["moved"])) for k, v in N.items()}
        e, new, wrong = dict(E), [], None
        stale = []
        for q, node, rev in reads:
            if q == p:
                x, ours = n.get(node), [o for o in mine if o[3] == node]
                apart = ours and all(o[2] == "UPDATE" for o in ours) and x and x["alive"] and all(x["moved"].get(o[4], 0) <= rev for o in ours)
                if (x["rev"] if x else 0) != rev and not apart:
                    stale.append("read an older revision")
        if stale:
            wrong = (-1, stale[0])

        def bump(i, field, seq, n=n, new=new, p=p, at=at):
            n[i]["rev"] += 1
            if not field.startswith("edge:"):
                n[i]["moved"][field] = n[i]["rev"]
            new.append((i, n[i]["rev"], field, p, seq, at))

        for _, seq, verb, target, field, expected, value, _ in mine:
            if wrong:
                break
            bad, x = [], n.get(target)
            if verb == "ADD":
                if x:
                    bad.append("id is in use")
                else:
                    load = json.loads(value)
                    n[target] = {"kind": target.split("/")[0], "props": load.get("props", {}), "locked": load.get("locked") is True, "rev": 0, "alive": True, "title": load["title"], "moved": {}}
                    bump(target, "*", seq)
            else:
                if not x or not x["alive"]:
                    bad.append("target is not there")
                elif x["locked"]:
                    bad.append("target is locked" if verb in ("UPDATE", "INVALIDATE") else "an end is locked")
                if verb in ("LINK", "UNLINK"):
                    y = n.get(value)
                    if not y or not y["alive"]:
                        bad.append("other end is not there")
                    elif y["locked"]:
                        bad.append("an end is locked")
                    is_open = e.get((target, field, value), False)
                    if is_open == (verb == "LINK"):
                        bad.append("edge is there already" if is_open else "edge is not there")
                    if not bad:
                        e[target, field, value] = verb == "LINK"
                        bump(target, f"edge:{field}:{value}", seq)
                elif not bad and verb == "UPDATE":
                    if field == "title":
                        now = x["title"]
                    else:
                        now = x["props"]
                        for s in field.split(".")[1:]:
                            now = now.get(s) if isinstance(now, dict) else None
                    if expected is not None and now != expected:
                        bad.append("value is not the expected one")
                    was = x["props"].get("status", "hypothetical")
                    if not bad and x["kind"] == "promise" and field == "props.status" and value != was and value not in STEPS.get(was, ()):
                        bad.append("no such step of a promise")
                    if not bad:
                        if field == "title":
                            x["title"] = value
                        else:
                            into, (*path, last) = x["props"], field.split(".")[1:]
                            for s in path:
                                if not isinstance(into.get(s), dict):
                                    into[s] = {}
                                into = into[s]
                            into[last] = value
                        bump(target, field, seq)
                elif not bad and verb == "INVALIDATE":
                    sources = sorted({a for (a, r, b), o in e.items() if o and b == target and a != target})
                    if any(n[a]["locked"] for a in sources):
                        bad.append("a neighbour is locked")
                    else:
                        x["alive"] = False
                        bump(target, "$invalidate", seq)
                        for k, o in e.items():
                            if o and target in (k[0], k[2]):
                                e[k] = False
                        for a in sources:
                            bump(a, f"edge:*:{target}", seq)
            if bad:
                wrong = (seq, min(bad))
        status[p] = ("rejected", *wrong) if wrong else ("accepted", None, None)
        if not wrong:
            # spans: what was opened and closed within a proposal counts by its operations
            live = dict(E)
            for _, _, verb, target, field, _, value, _ in mine:
                if verb == "LINK":
                    spans.append([target, field, value, p, at, None])
                    live[target, field, value] = True
                for s in spans:
                    if s[5] is None and (verb == "UNLINK" and tuple(s[:3]) == (target, field, value) or verb == "INVALIDATE" and target in (s[0], s[2])):
                        s[5] = at
            N, E, revs = n, e, revs + new
    return status, N, spans, revs


def random_log(rng, names, n, hot):
    ops, reads, order = [], [], []
    for k in range(n):
        p = f"p{k:03d}"
        order.append((p, T0 + datetime.timedelta(minutes=rng.randrange(n * 2))))
        some = rng.sample(names, 2) if rng.random() > hot else [names[0], rng.choice(names[1:])]
        for seq in range(rng.randrange(1, 4)):
            a, b = some if rng.random() < 0.8 else some[::-1]
            verb = rng.choices(["UPDATE", "LINK", "UNLINK", "INVALIDATE", "ADD"], [6, 4, 3, 0.5, 1.5])[0]
            key = f"key-{k}-{seq}" if rng.random() < 0.97 else f"key-{max(0, k - 3)}-0"
            if verb == "ADD":
                ops.append((p, seq, verb, f"concept/{rng.randrange(5)}", None, None, json.dumps({"title": "new", "props": {"a": {"b": "0"}}}), key))
            elif verb == "UPDATE":
                promise = a.startswith("promise/")
                field = "props.status" if promise else rng.choice(["props.a.b", "props.c", "title", "props.a"])
                value = rng.choice(["eligible", "actualized", "prevented"]) if promise else str(rng.randrange(3))
                ops.append((p, seq, verb, a, field, rng.choice([None, None, "1"]) if field == "props.c" else None, value, key))
            elif verb == "INVALIDATE":
                ops.append((p, seq, verb, a, None, None, None, key))
            else:
                ops.append((p, seq, verb, a, "related", None, b, key))
        for node in set(some):
            if rng.random() < 0.4:
                reads.append((p, node, rng.choice([1, 1, 2, 3, rng.randrange(6)])))
    return ops, reads, order


def _run(spark, nodes, edges, ops, reads, order):
    rels = spark.createDataFrame([("related", None, None, False)], "rel string, src_kind string, dst_kind string, hard boolean")
    return commit.commit_log(
        graph(spark, nodes, edges), spark.createDataFrame(ops, OPS), spark.createDataFrame(reads, "proposal string, node string, rev int"),
        spark.createDataFrame(order, "proposal string, at timestamp"), kind_dim(spark), rels,
    )


def _compare(got, want):
    status, nodes, spans, revs = want
    assert {r.proposal: (r.status, r.seq, r.error) for r in got.status.collect()} == status
    assert sorted((r.node, r.rev, r.field, r.proposal, r.seq, r.tx_from) for r in got.revisions.collect()) == sorted(revs)
    live = {r.id: (r.rev, r.title, json.loads(r.props), r.tx_to is None) for r in got.node.collect()}
    assert live == {i: (x["rev"], x["title"], x["props"], x["alive"]) for i, x in nodes.items() if x["alive"] or i in live} and {i for i, x in nodes.items() if x["alive"]} <= set(live)
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted((tuple(r) for r in got.edge.collect()), key=key) == sorted((tuple(s) for s in spans), key=key)


@pytest.mark.parametrize(("seed", "hot"), [(1, 0.2), (2, 0.7)])
def test_serial(spark, seed, hot):
    rng = random.Random(seed)
    names = [f"character/{i}" for i in range(6)] + ["promise/1", "promise/2"]
    nodes = [(i, {"c": "1"}, i == "character/5", 1, False) for i in names] + [("concept/4", {}, False, 3, True)]
    edges = [("character/1", "related", "character/2"), ("character/0", "related", "character/3"), ("character/5", "related", "character/4"), ("character/2", "related", "character/0")]
    ops, reads, order = random_log(rng, names, 60, hot)
    want = serial(nodes, edges, ops, reads, order)
    assert {"accepted", "rejected"} <= {s[0] for s in want[0].values()}
    got = _run(spark, nodes, edges, ops, reads, order)
    _compare(got, want)


def _at(i):
    return T0 + datetime.timedelta(hours=i)


def test_reproduced_cases(spark):
    nodes = [("promise/1", {}, False, 1, False), ("character/a", {}, False, 1, False), ("character/b", {}, False, 1, False), ("character/c", {}, False, 1, False)]
    add = json.dumps({"title": " New  one ", "props": {"x": {"y": "1"}}, "aliases": ["n", "m"], "tags": ["t"], "story_from": 4})
    ops = [
        ("p1", 0, "ADD", "concept/z", None, None, add, "k1"), ("p2", 0, "ADD", "concept/z", None, None, add, "k2"),
        ("p3", 0, "UPDATE", "promise/1", "props.status", None, "eligible", "k3"), ("p4", 0, "UPDATE", "promise/1", "props.status", None, "actualized", "k4"),
        ("p5", 0, "UPDATE", "concept/z", "props.x.w", None, "2", "k5"), ("p5", 1, "UPDATE", "concept/z", "aliases", None, '["only"]', "k5b"),
        ("p6", 0, "INVALIDATE", "character/b", None, None, None, "k6"), ("p7", 0, "LINK", "character/a", "related", None, "character/b", "k7"),
        ("p8", 0, "LINK", "character/a", "related", None, "character/c", "k8"), ("p9", 0, "UNLINK", "character/a", "related", None, "character/c", "k9"), ("pa", 0, "LINK", "character/a", "related", None, "character/c", "k10"),
        ("pb", 0, "UPDATE", "promise/1", "props.status", None, "eligible", "k3"), ("pc", 0, "UPDATE", "promise/1", "props.status", None, "prevented", "k4"), ("pd", 0, "UPDATE", "character/a", "props.v", None, "1", "k11"),
    ]
    order = [(p, _at(i)) for i, p in enumerate(["p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9", "pa", "pb", "pc", "pd"])]
    got = _run(spark, nodes, [], ops, [("pd", "character/a", 1)], order)
    status = {r.proposal: (r.status, r.error) for r in got.status.collect()}
    assert status["p1"][0] == "accepted" and status["p2"] == ("rejected", "id is in use")
    assert status["p3"][0] == status["p4"][0] == status["p5"][0] == "accepted"
    assert status["p7"] == ("rejected", "other end is not there")
    assert status["pb"] == ("repeat", None) and status["pc"] == ("rejected", "key was used for something else")
    assert status["pd"][0] == "accepted"  # only edges moved a since
    node = {r.id: r for r in got.node.collect()}
    assert json.loads(node["concept/z"].props) == {"x": {"y": "1", "w": "2"}} and node["concept/z"].title == "New  one" and node["concept/z"].story_from == 4
    assert json.loads(node["promise/1"].props)["status"] == "actualized" and node["promise/1"].rev == 3
    assert [(r.dst, r.opened_by, r.tx_to is None) for r in got.edge.orderBy("tx_from").collect()] == [("character/c", "p8", False), ("character/c", "pa", True)]
    assert all(r.tx_to is None or r.tx_from <= r.tx_to for r in got.edge.collect())
    assert [r.alias for r in got.alias.collect()] == ["only"] and [r.tag for r in got.tag.collect()] == ["t"]
    branches = commit.commit_branches(got, spark.createDataFrame([("p1", "s"), ("p2", "s"), ("p3", "r"), ("pb", "r")], "proposal string, session string"))
    assert {r.session: (r.status, r.n_accepted, r.n_rejected) for r in branches.collect()} == {"s": ("conflicted", 1, 1), "r": ("active", 1, 0)}


def test_rounds_do_not_follow_a_hot_node(spark):
    """Every proposal reads what the one before wrote: the longest chain there is."""
    for n in (10, 120):
        nodes = [("character/a", {}, False, 1, False)]
        ops = [(f"p{i:04d}", 0, "UPDATE", "character/a", "props.v", None, str(i), f"key-{i}") for i in range(n)]
        reads = [(f"p{i:04d}", "character/a", i + 1 - (i == 7)) for i in range(n)]
        got = _run(spark, nodes, [], ops, reads, [(o[0], _at(i)) for i, o in enumerate(ops)])
        assert got.rounds <= 3
    accepted = [r.proposal for r in got.status.where("status = 'accepted'").collect()]
    assert len(accepted) == 119  # one updates a field that changed after what it read


def test_nothing_and_nulls(spark):
    nodes = [("character/a", {}, False, 1, False)]
    got = _run(spark, nodes, [], [], [], [])
    assert got.status.count() == 0 and got.node.count() == 1 and got.edge.count() == 0
    ops = [("p", 0, None, None, None, None, None, None), ("q", 0, "LINK", "character/a", None, None, None, "k"), ("r", 0, "UPDATE", "character/a", "title", None, "é", None)]
    got = _run(spark, nodes, [], ops, [("none", "character/a", None)], [(x, T0) for x in "pqr"])
    assert {r.proposal: r.status for r in got.status.select("proposal", "status", F.lit(1)).collect()} == {"p": "rejected", "q": "rejected", "r": "accepted"}


def test_catalogue_of_the_given_relations(spark):
    """Kinds of ends are held against the catalogue."""
    g = graph(spark, [("location/a", {}, False, 1, False), ("scene/s", {}, False, 1, False)], [])
    ops = spark.createDataFrame([("p", 0, "LINK", "location/a", "occurs_at", None, "scene/s", "k1"), ("q", 0, "LINK", "scene/s", "occurs_at", None, "location/a", "k2"), ("r", 0, "ADD", "nothing/x", None, None, '{"title": "x"}', "k3")], OPS)
    wrong = {(r.proposal, r.error) for r in commit.refused(g, ops, kind_dim(spark), rel_dim(spark)).collect()}
    assert wrong == {("p", "kind of the target does not fit"), ("p", "kind of the other end does not fit"), ("r", "unknown kind")}


def test_later_rounds_fold_only_what_counts_otherwise(spark, monkeypatch):
    """30 proposals apart from each other beside one that is refused and one that builds on it: the 30 are folded once."""
    tables, write = [], commit.cut
    monkeypatch.setattr(commit, "cut", lambda df: tables.append(write(df)) or tables[-1])
    nodes = [(f"character/{i}", {"v": "a"}, False, 1, False) for i in range(31)]
    ops = [(f"p{i:02d}", 0, "UPDATE", f"character/{i}", "props.v", None, "b", f"k{i}") for i in range(30)]
    ops += [("q", 0, "UPDATE", "character/30", "props.v", None, "x", "kq"), ("q", 1, "UPDATE", "character/none", "props.v", None, "x", "kn"), ("r", 0, "UPDATE", "character/30", "props.v", "x", "y", "kr")]
    got = _run(spark, nodes, [], ops, [], [(p, _at(i)) for i, p in enumerate(dict.fromkeys(o[0] for o in ops))])
    assert {r.proposal for r in got.status.where("status = 'rejected'").collect()} == {"q", "r"} and got.rounds >= 2
    folds = [t.where("what = 'verdict' and ok").count() for t in tables if {"what", "ok", "rev"} <= set(t.columns)]
    assert sum(n >= 30 for n in folds) == 2  # the first round, and what all rounds gave
