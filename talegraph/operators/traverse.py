"""Traversal: breadth-first frontiers, peeling and simple paths.

Reachability and least depth need no paths, so each is a loop of joins against the nodes
not visited yet; only ``trace`` carries paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import begun, token_estimate
from ..model import Graph, cut, dealt


#: Edges that one task may hold, to finish what rounds have left.
FEW_EDGES = 100_000
#: Edges of a node from which on what lies behind it is not spread for each run.
HUB = 1_000


def reach(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """edges (src, dst), start (run, id) -> run, id, depth: least depth of all that each run reaches.

    Without ``most`` it goes on until nothing new is met.  Lineage is cut every round."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = cut(start.select("run", "id", F.lit(0).alias("depth")).distinct())
    frontier, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        found = frontier.join(edges, frontier["id"] == edges["src"]).select("run", F.col("dst").alias("id")).distinct()
        frontier = cut(found.join(seen, ["run", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier)) if depth % 4 == 0 else seen.unionByName(frontier)
    return seen


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """edges (src, dst), start (id) -> id: start and all that it leads to.

    A node with one way in is reached if what leads to it is, so such ways are walked back by steps that double.
    Only nodes with several ways in are reached round by round, over what those ways begin at."""
    edges = cut(edges.select("src", "dst").where("src != dst").distinct())
    start = cut(start.select("id").distinct())
    ins = cut(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("at")).join(start, "id", "left_anti"))
    back = cut(ins.where("n = 1").select("id", "at", F.lit(True).alias("on")))
    going = back.count()
    while going:
        ahead = back.select(F.col("id").alias("at"), F.col("at").alias("to"))
        back = cut(back.join(ahead, "at", "left").select("id", F.coalesce("to", "at").alias("at"), F.col("to").isNotNull().alias("on")))
        before, going = going, back.where("on").count()
        if going == before:  # on a way that ends, every distance to its end occurs, so what is left goes round and begins nowhere
            break
    into = edges.join(ins.where("n > 1").select(F.col("id").alias("dst")), "dst", "left_semi").join(back.select(F.col("id").alias("src"), "at"), "src", "left")
    ends = reach(into.select(F.coalesce("at", "src").alias("src"), "dst").where("src != dst"), start.select(F.lit(0).alias("run"), "id")).select("id")
    return ends.unionByName(back.join(ends.withColumnRenamed("id", "at"), "at", "left_semi").select("id"))


def walk(g: Graph, start: DataFrame, direction: str = "out", rels: list[str] | None = None, most: int = 3, include_soft: bool = False, as_of: int | None = None) -> DataFrame:
    """start (run, id) -> run, id, depth over chosen relations; edges that begin after as_of are left out."""
    edge = g.live_edge.where(begun(as_of))
    if rels:
        edge = edge.where(F.col("rel").isin(rels))
    if not include_soft:
        edge = edge.where("hard")
    if direction == "in":
        edge = edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(edge, start, most)


def outline(g: Graph, depth: int = 1, kinds: list[str] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """id, kind, title, story_from, depth below the roots: nodes that nothing live contains, or those of scope (id).

    Any live ``contains`` keeps a node from being a root, but only hard ones are followed; kinds narrow
    what is returned, not the way."""
    nodes = g.live_node
    held = g.live_edge.where("rel = 'contains'")
    roots = scope.select("id") if scope is not None else nodes.join(held, nodes["id"] == held["dst"], "left_anti").select("id")
    found = reach(held.where("hard"), roots.select(F.lit(0).alias("run"), "id"), depth).drop("run")
    out = found.join(nodes.select("id", "kind", "title", "story_from"), "id")
    return out.where(F.col("kind").isin(kinds)) if kinds else out


def scope_descendants(g: Graph, scope: DataFrame) -> DataFrame:
    """scope (run, id) -> run, id: itself and all below through contains, hard or soft."""
    return reach(g.live_edge.where("rel = 'contains'"), scope).select("run", "id")


def _spread(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """As reach, from seeds (run, id, depth) that begin at depths of their own."""
    seen = front = seeds.where("depth = 0")
    for depth in range(1, most + 1):
        found = front.join(edges, front["id"] == edges["src"]).select("run", F.col("dst").alias("id")).unionByName(seeds.where(F.col("depth") == depth).select("run", "id")).distinct()
        front = cut(found.join(seen, ["run", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(front)
    return cut(seen)


def impact(g: Graph, requests: DataFrame, most: int = 3, hub: int = HUB) -> DataFrame:
    """requests (run, id) -> run, affected, max_depth, tokens, cyclic: what rests on each id by hard edges against their direction.

    Runs that ask for the same one id are counted once.  What lies behind nodes with more than ``hub`` edges is
    spread once for each set of such nodes that a run meets, and counted; what a run reaches by other ways too is taken off."""
    back = cut(g.live_edge.where("hard").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())
    asked = requests.select("run", "id").distinct()
    alone = asked.groupBy("run").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    alone = cut(alone.select("run", F.when(F.col("n") == 1, F.concat(F.lit("="), "one")).otherwise(F.concat(F.lit("+"), F.col("run").cast("string"))).alias("key")))
    asked = cut(asked.join(alone, "run").select(F.col("key").alias("run"), "id").distinct())
    hubs = cut(back.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("src"))
    near = cut(reach(back.join(hubs, "src", "left_anti"), asked, most))
    hit = cut(near.where(F.col("depth") < most).join(hubs.withColumnRenamed("src", "id"), "id").select("run", "id", "depth"))
    met = cut(hit.groupBy("run").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("depth", "id")))), 256).alias("set")))
    far = _spread(back, cut(hit.join(met, "run").select(F.col("set").alias("run"), "id", "depth").distinct()), most)
    far = far.select(F.col("run").alias("set"), "id", F.col("depth").alias("far"))
    nodes = g.live_node.select("id", token_estimate(F.col("title"), F.col("id"), F.col("kind")).cast("long").alias("tokens"))
    behind = cut(far.join(nodes, "id").groupBy("set", F.col("far").alias("depth")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")))
    own = near.join(met, "run", "left").join(far, ["set", "id"], "left").join(nodes, "id")
    own = cut(own.groupBy("run", F.coalesce(F.least("depth", "far"), "depth").alias("depth"), "far").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")))
    parts = own.select("run", "depth", "n", "tokens").unionByName(own.where("far is not null").select("run", F.col("far").alias("depth"), (-F.col("n")).alias("n"), (-F.col("tokens")).alias("tokens")))
    parts = parts.unionByName(met.join(behind, "set").select("run", "depth", "n", "tokens"))
    parts = parts.groupBy("run", "depth").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).where("n > 0")
    summed = parts.groupBy("run").agg(F.sum("n").alias("affected"), F.max("depth").alias("max_depth"), F.sum("tokens").alias("tokens"))
    # a loop: something met before the last step leads to what was asked for
    leads = asked.join(back.select(F.col("src").alias("at"), F.col("dst").alias("id")), "id").select("run", F.col("at").alias("id"))
    loops = leads.join(near.where(F.col("depth") < most), ["run", "id"], "left_semi").select("run")
    loops = loops.unionByName(leads.join(met, "run").join(far.where(F.col("far") < most), ["set", "id"], "left_semi").select("run")).distinct().withColumn("loop", F.lit(True))
    out = summed.join(loops, "run", "left").withColumnRenamed("run", "key").join(alone, "key")
    return out.select("run", "affected", "max_depth", "tokens", F.coalesce("loop", F.lit(False)).alias("cyclic"))


def steps_to(edges: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """edges (src, dst, rel), targets (target) -> target, src, dst, rel, left: edges on a way of at most ``most`` to each target; left: least steps from dst."""
    back = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets.select(F.col("target").alias("run"), F.col("target").alias("id")), most - 1)
    return back.select(F.col("run").alias("target"), F.col("id").alias("dst"), F.col("depth").alias("left")).join(edges, "dst").select("target", "src", "dst", "rel", "left")


def trace(g: Graph, requests: DataFrame, rels: list[str] | None = None, most: int = 5, k: int = 3) -> DataFrame:
    """requests (source, target) -> source, target, n, path, rels, depth: the first k simple paths over hard edges.

    The way back is found first: a path only takes edges from which its target is within the steps that are left.
    Joins are unrolled to the depth; each carries its path and refuses a node twice."""
    edge = g.live_edge.where("hard")
    if rels:
        edge = edge.where(F.col("rel").isin(rels))
    edge = cut(edge.select("src", "dst", "rel").distinct())
    steps = cut(steps_to(edge, requests.select("target"), most))
    now = requests.select("source", "target", F.col("source").alias("at"), F.array("source").alias("path"), F.array().cast("array<string>").alias("rels"))
    found = None
    for depth in range(1, most + 1):
        now = now.join(steps.where(F.col("left") <= most - depth).withColumnRenamed("src", "at"), ["target", "at"]).where(~F.array_contains("path", F.col("dst")))
        now = now.select("source", "target", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("rels", F.col("rel")).alias("rels"))
        hit = now.where("at = target").select("source", "target", "path", "rels", F.lit(depth).alias("depth"))
        found = hit if found is None else found.unionByName(hit)
        now = now.where("at != target")
    order = Window.partitionBy("source", "target").orderBy("depth", F.to_json("path"), F.to_json("rels"))
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def would_cycle(g: Graph, candidates: DataFrame) -> DataFrame:
    """candidates (run, src, dst, rel) -> run, cycle: whether an edge would close a cycle of its relation."""
    parts = None
    for (rel,) in candidates.select("rel").distinct().collect():  # relations are catalogued
        mine = candidates.where(F.col("rel") == rel)
        met = reach(g.live_edge.where(F.col("rel") == rel), mine.select("run", F.col("dst").alias("id")))
        part = mine.join(met.select("run", F.col("id").alias("src"), F.lit(True).alias("hit")), ["run", "src"], "left").select("run", F.coalesce("hit", F.lit(False)).alias("cycle"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def stuck(edges: DataFrame) -> DataFrame:
    """edges (src, dst) -> those that stay when edges from nodes without incoming ones are peeled off."""
    left = cut(edges.select("src", "dst"))
    left = cut(dealt(left, left.count(), "src", "dst").distinct())
    n = left.count()
    while n:
        left = cut(dealt(left, n, "src").join(dealt(left.select(F.col("dst").alias("src")), n, "src").distinct(), "src", "left_semi"))
        m = left.count()
        if m == n:
            break
        n = m
    return left


def acyclic_check(g: Graph, rels: DataFrame) -> DataFrame:
    """rel, stuck_nodes for each relation that must be acyclic and is not: nodes on or after a cycle."""
    asked = [r.rel for r in rels.where("acyclic").select("rel").collect()]  # catalogued relations
    edges, out = cut(g.live_edge.where(F.col("rel").isin(asked)).select("rel", "src", "dst")), None
    for rel in asked:
        left = stuck(edges.where(F.col("rel") == rel))
        part = dealt(left.select(F.col("dst").alias("id")), left.count(), "id").distinct().agg(F.count("*").alias("stuck_nodes")).select(F.lit(rel).alias("rel"), "stuck_nodes")
        out = part if out is None else out.unionByName(part)
    return out.where("stuck_nodes > 0")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without edges from nodes that nothing leads to, and without those to nodes that lead nowhere."""
    src, dst = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select("src", "dst")


def _components_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst) of a bounded graph -> id, component: two passes of depth-first search, the second against the edges."""
    ahead: dict = {}
    back: dict = {}
    kind = None
    for b in batches:
        kind = b.schema.field("src").type
        for s, d in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True):
            ahead.setdefault(s, []).append(d)
            back.setdefault(d, []).append(s)
    seen: set = set()
    order = []
    for root in ahead:
        todo = [(root, iter(ahead[root]))] if root not in seen else []
        seen.add(root)
        while todo:
            node, ways = todo[-1]
            to = next((x for x in ways if x not in seen), None)
            if to is None:
                order.append(node)
                todo.pop()
            else:
                seen.add(to)
                todo.append((to, iter(ahead.get(to, ()))))
    part: dict = {}
    for root in reversed(order):
        todo = [root] if root not in part else []
        while todo:
            node = todo.pop()
            if node not in part:
                part[node] = root
                todo += [x for x in back.get(node, ()) if x not in part]
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(part.keys(), kind), pa.array(part.values(), kind)], ["id", "component"])


def strong_components(edges: DataFrame) -> DataFrame:
    """edges (src, dst) -> id, component: nodes that share a cycle; nodes without one do not appear.

    Once no more than FEW_EDGES are left, one task finishes them; until then:

    Paths are contracted first: where a node has one way out, half of them by lot go into what they lead
    to, so a cycle or path of any length is gone in a logarithmic number of rounds, and ends are trimmed.
    What is left is coloured forward by the least node that reaches each, and backward from those nodes
    within a colour: that is a component.  At last contracted nodes come back, one round after another:
    such a node is in the component it leads to if a node of that component leads to it.
    No round has more rows than there are edges."""
    left = cut(edges.select("src", "dst").where("src != dst").distinct())
    n, rounds, gone, few = left.count(), 0, [], False
    while n:
        rounds += 1
        left = cut(_trimmed(_trimmed(left)))
        ways = left.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("into")).where("n = 1").select(F.col("src").alias("id"), "into")
        lot = [F.pmod(F.xxhash64(F.lit(rounds), c), F.lit(2)) for c in ("id", "into")]
        m = left.count()
        if m <= FEW_EDGES:
            n, few = m, m > 0
            break
        going = cut(ways.where((lot[0] == 0) & (lot[1] == 1)))
        if not going.isEmpty():
            gone.append(cut(left.select(F.col("src").alias("by"), F.col("dst").alias("id")).join(going, "id")))
            rest = left.join(going.select(F.col("id").alias("src")), "src", "left_anti")
            moved = rest.join(going.select(F.col("id").alias("dst"), "into"), "dst", "left").select("src", F.coalesce("into", "dst").alias("dst"))
            left = cut(moved.where("src != dst").distinct())
            m = left.count()
        elif m == n and ways.isEmpty():
            break
        n = m
    found = left.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    if few:
        kind = left.schema["src"].dataType.simpleString()
        found, n = cut(left.coalesce(1).mapInArrow(_components_here, f"id {kind}, component {kind}")), 0
    while n:
        color = cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("color", F.col("id")))
        new = color
        while not new.isEmpty():
            told = left.join(new.select(F.col("id").alias("src"), "color"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("told"))
            new = cut(told.join(color, "id").where("told < color").select("id", F.col("told").alias("color")))
            color = cut(color.join(new.withColumnRenamed("color", "less"), "id", "left").select("id", F.coalesce("less", "color").alias("color")))
        same = left.join(color.select(F.col("id").alias("src"), "color"), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("other")), "dst").where("color = other")
        same = cut(same.select("src", "dst"))
        part = front = cut(color.where("id = color"))
        while not front.isEmpty():
            back = same.join(front.select(F.col("id").alias("dst"), "color"), "dst").select(F.col("src").alias("id"), "color").distinct()
            front = cut(back.join(part.select("id"), "id", "left_anti"))
            part = cut(part.unionByName(front))
        found = cut(found.unionByName(part.select("id", F.col("color").alias("component"))))
        left = left.join(part.select(F.col("id").alias("src")), "src", "left_anti").join(part.select(F.col("id").alias("dst")), "dst", "left_anti")
        left = cut(_trimmed(left.select("src", "dst")))
        n = left.count()
    for g in reversed(gone):
        # a node that is in no component yet is one of its own
        label = g.join(found.select(F.col("id").alias("into"), F.col("component").alias("c")), "into", "left").join(found.select(F.col("id").alias("by"), F.col("component").alias("d")), "by", "left")
        label = label.select("id", "into", F.coalesce("c", "into").alias("c"), F.coalesce("d", "by").alias("d")).where("c = d").select("id", "into", F.col("c").alias("component")).distinct()
        label = cut(label)
        more = label.select("id", "component").union(label.select(F.col("into").alias("id"), "component")).distinct()
        found = cut(found.unionByName(more.join(found.select("id"), "id", "left_anti")))
    sized = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return found.join(sized, "component", "left_semi").select("id", "component")


def on_cycles(edges: DataFrame) -> DataFrame:
    """id of every node on a cycle, a loop included."""
    loops = edges.where("src = dst").select(F.col("src").alias("id"))
    return strong_components(edges).select("id").union(loops).distinct()


def max_per_dst_check(g: Graph, rels: DataFrame) -> DataFrame:
    """rel, dst, n where a relation has more edges into a node than it may."""
    counts = g.live_edge.groupBy("rel", "dst").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(rels.where("max_per_dst is not null")), "rel").where("n > max_per_dst").select("rel", "dst", "n")
