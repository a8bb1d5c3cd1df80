"""Findings kept up to date against a check of the whole graph."""

import json
import random

from test_commit import EDGE, NODE, T0

from talegraph.model import Graph
from talegraph.operators.rules import EXTRA, RULES, check
from talegraph.streaming import diagnose


def _props(rng, kind):
    if kind == "Fact":
        return {"subject": f"character/{rng.randrange(2)}", "predicate": rng.choice(["absolute_time", "eyes", "life_state"]), "object": rng.choice(["dead", "1", "2"])}
    if kind == "Scene":
        return {
            "expect_cause": rng.random() < 0.4, "is_start": rng.random() < 0.2, "is_end": rng.random() < 0.2, "claims": [{"speaker": f"character/{rng.randrange(4)}", "fact": f"fact/{rng.randrange(6)}"}],
            "mentions": [{"entity": f"character/{rng.randrange(4)}", "name": rng.choice(["x", "Jo"])}], "post": [{"subject": f"location/{rng.randrange(2)}", "field": "f", "value": rng.randrange(2)}],
        }
    if kind == "Rule":
        return {"forbid": [{"subject": f"location/{rng.randrange(2)}", "field": "f", "value": rng.randrange(2)}]}
    return {"status": rng.choice(["hypothetical", "eligible"])} if kind == "Promise" else {}


IDS = [f"{k}/{i}" for k, n in (("character", 4), ("location", 2), ("scene", 7), ("fact", 10), ("promise", 4), ("rule", 2)) for i in range(n)]
ENDS = {"present_at": ("scene", "character"), "occurs_at": ("scene", "location"), "causes": ("scene", "scene"), "focalizes": ("character", "scene"), "pays_off": ("scene", "promise"), "requires_trigger": ("promise", "scene"), "owns": ("character", "location")}


class World:
    def __init__(self, seed):
        self.rng = random.Random(seed)
        self.nodes = {i: self.node(i) for i in IDS}
        self.edges = {self.edge() for _ in range(75)}
        self.seen = {(f"fact/{self.rng.randrange(6)}", f"character/{self.rng.randrange(4)}", self.rng.choice([None, 3, 9])) for _ in range(9)}

    def node(self, ident):
        kind = ident.split("/")[0].capitalize()
        start = self.rng.choice([None, 2, 5, 8])
        return (ident, kind, self.rng.choice(["Jo", "Al"]), None, json.dumps(_props(self.rng, kind)), start, None if start is None else start + self.rng.randrange(3), None, T0, None, "human", kind == "Rule" and self.rng.random() < 0.8, 1)

    def edge(self):
        rel = self.rng.choice(list(ENDS))
        a, b = (self.rng.choice([i for i in IDS if i.startswith(k)]) for k in ENDS[rel])
        return a, b, rel

    def change(self):
        """Touched ids of a commit: updates, an invalidation or a return, links and unlinks."""
        touched = set()
        for _ in range(self.rng.randrange(1, 4)):
            i = self.rng.choice(IDS)
            touched.add(i)
            if self.rng.random() < 0.25 and i in self.nodes:
                del self.nodes[i]
                for e in [e for e in self.edges if i in e[:2] and self.rng.random() < 0.7]:  # some are left dangling
                    self.edges.discard(e)
                    touched |= set(e[:2])
            else:
                self.nodes[i] = self.node(i)
        for _ in range(self.rng.randrange(3)):
            e = self.edge() if self.rng.random() < 0.5 else self.rng.choice(sorted(self.edges))
            self.edges ^= {e}
            touched |= set(e[:2])
        return touched

    def graph(self, spark):
        return Graph(
            node=spark.createDataFrame(list(self.nodes.values()), NODE), edge=spark.createDataFrame([(a, b, r, True, None, None, None, 1.0) for a, b, r in self.edges], EDGE),
            node_alias=spark.createDataFrame([("character/1", "x")], "node string, alias string"), node_tag=spark.createDataFrame([], "node string, tag string"),
            visibility=spark.createDataFrame([(*x, "told") for x in self.seen], "fact string, viewer string, learned_at int, pathway string"), evidence=spark.createDataFrame([], "node string, file string, start_off int, end_off int"),
        )


def rows(df):
    return sorted((r.rule, tuple(r.nodes), r.message) for r in df.collect())


def test_rules_are_covered():
    assert set(diagnose.KEYS) | set(diagnose.WHOLE) == set(RULES | EXTRA)


def test_open_set_is_that_of_a_whole_check(spark):
    local = list(diagnose.KEYS)
    seen = set()
    for seed in (1,):
        world = World(seed)
        now = check(world.graph(spark), local).select("rule", "nodes", "message", "severity")
        before = rows(now)
        for _ in range(2):
            touched = world.change()
            g = world.graph(spark)
            out = diagnose.recheck(g, spark.createDataFrame([(i,) for i in touched], "id string"), now, local)
            got, want = rows(out.open), rows(check(g, local))
            assert got == want
            deltas = [(r.action, (r.rule, tuple(r.nodes), r.message)) for r in out.deltas.collect()]
            assert sorted(x for a, x in deltas if a == "open") == sorted(set(got) - set(before)) and sorted(x for a, x in deltas if a == "resolve") == sorted(set(before) - set(got))
            seen |= {x[0] for x in want} | {x[0] for x in before}
            now, before = out.open, got
    assert len(seen) >= 11


def test_stream(spark, tmp_path):
    world = World(7)
    graphs, deltas = [], []
    for k in range(2):
        touched = world.change()
        graphs.append(world.graph(spark))
        spark.createDataFrame([(i,) for i in sorted(touched)], "id string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = diagnose.diag_stream(stream, lambda n: graphs[n], f"{tmp_path}/state", f"{tmp_path}/at", lambda df, n: deltas.append(df.count()))
    query.processAllAvailable()
    query.stop()
    assert len(deltas) == 2
    for n, g in enumerate(graphs):
        assert rows(spark.read.parquet(f"{tmp_path}/state/after={n}")) == rows(check(g, list(RULES | EXTRA)))
