"""Interval pairs and strong components against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from talegraph.operators import traverse
from talegraph.operators.intervals import overlapping


def test_overlapping(spark):
    rng = random.Random(4)
    for span, base in ((12, 0), (100_000, -50_000)):
        rows = []
        for i in range(160):
            a = rng.choice([None, rng.randrange(span) + base])
            b = rng.choice([None, (rng.randrange(span) + base) if a is None else a + rng.choice([0, 1, 3, span // 3])])
            rows.append((rng.choice("xyz"), f"i{i:03d}", a, b, rng.choice("pq") if i % 3 else "p"))
        rows += [("same", f"s{i}", 1, 2, "v") for i in range(9)]
        far = 10**9
        want = set()
        for i, x in enumerate(rows):
            for y in rows[i + 1 :]:
                if x[0] == y[0] and x[4] != y[4] and (far if x[3] is None else x[3]) >= (-far if y[2] is None else y[2]) and (far if y[3] is None else y[3]) >= (-far if x[2] is None else x[2]):
                    want.add((x[0], *sorted([(x[1], x[4]), (y[1], y[4])])))
        df = spark.createDataFrame(rows, "k string, id string, story_from int, story_to int, v string")
        got = [(r.k, (r.a_id, r.a_value), (r.b_id, r.b_value)) for r in overlapping(df, ["k"], "v").collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    assert overlapping(df.limit(0), ["k"], "v").count() == 0


def test_a_hot_key_makes_only_its_pairs(spark):
    """20,000 intervals of one key, each meeting the next only."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.format_string("%06d", "id").alias("id"), (F.col("id") * 10).cast("int").alias("story_from"), (F.col("id") * 10 + 10).cast("int").alias("story_to"), (F.col("id") % 2).cast("string").alias("v"))
    assert overlapping(df, ["k"], "v").count() == 19_999


def components(edges):
    """By plain reachability."""
    out, nodes = {}, {x for e in edges for x in e}
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    far = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for m in to.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        far[n] = seen
    for n in nodes:
        mine = frozenset(m for m in far[n] if n in far[m]) | {n}
        if len(mine) > 1:
            out[n] = mine
    return out, {n for n in nodes if n in far[n]}


@pytest.mark.parametrize("few", [0, 100_000])
def test_strong_components(spark, monkeypatch, few):
    monkeypatch.setattr(traverse, "FEW_EDGES", few)
    rng = random.Random(9)
    for n, m in ((30, 36), (20, 34), (5, 0)):
        edges = [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)]
        df = spark.createDataFrame(edges, "src string, dst string")
        want, looped = components(edges)
        by = {}
        for r in traverse.strong_components(df).collect():
            by.setdefault(r.component, set()).add(r.id)
        got = {i: frozenset(s) for s in by.values() for i in s}
        assert got == want
        assert {r.id for r in traverse.on_cycles(df).collect()} == looped


def test_one_large_cycle(spark, monkeypatch):
    """A cycle of 1,500 beside a path of 1,500: logarithmic rounds, no more rows than edges."""
    n = 1_500
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    path = spark.range(n).select((F.col("id") + n).alias("src"), (F.col("id") + n + 1).alias("dst"))
    monkeypatch.setattr(traverse, "FEW_EDGES", 0)
    cuts, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: cuts.append(cut(df)) or cuts[-1])
    assert traverse.on_cycles(ring.union(path)).count() == n
    assert len(cuts) < 300 and max(c.count() for c in cuts) <= 2 * n
