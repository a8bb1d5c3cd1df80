"""Dirty propagation: who depends on what was read, and how far a change goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import field_value
from ..model import Graph, cut
from .traverse import on_cycles, reach


def read_index(proposals: DataFrame) -> DataFrame:
    """proposals (proposal, read_set JSON) -> proposal, node, rev."""
    reads = F.from_json("read_set", "array<struct<node: string, rev: int>>")
    return proposals.select("proposal", F.explode(reads).alias("r")).select("proposal", "r.node", "r.rev")


def dependency_edges(ops: DataFrame, reads: DataFrame) -> DataFrame:
    """source, target, source_rev, proposal: what each written node rests on, newest for each pair."""
    written = ops.select("proposal", F.col("target"), "ts", "seq")
    met = reads.where("node != 'book'").join(written, "proposal").where("node != target")
    newest = F.row_number().over(Window.partitionBy("node", "target").orderBy(F.desc("ts"), F.desc("proposal"), F.desc("seq")))
    return met.withColumn("n", newest).where("n = 1").select(F.col("node").alias("source"), "target", F.col("rev").alias("source_rev"), "proposal")


def propagate(g: Graph, deps: DataFrame, triggers: DataFrame, changed: DataFrame, most: int | None = 3, nodes: int | None = 40) -> DataFrame:
    """triggers (run, node), deps (source, target), changed (node) -> run, node, depth, status.

    Runs go together, keyed by run.  A node whose typed content did not change passes nothing on
    (cutoff), a locked one is skipped, a dead one is cutoff; a run of more than ``nodes`` is blocked whole.
    Without ``most`` a run goes on until nothing new is met, without ``nodes`` none is blocked."""
    deps = deps.select("source", "target").distinct()
    live = g.live_node.select(F.col("id").alias("node"), "locked")
    seen = cut(triggers.select("run", "node", F.lit(0).alias("depth")).distinct())
    frontier = seen.join(changed, "node", "left_semi")
    if most is None and seen.groupBy("run").count().where("count > 1").isEmpty():
        seen = seen.unionByName(_passed(cut(deps), live, seen, frontier))
    else:
        depth = 0
        while most is None or depth < most:
            depth += 1
            step = frontier.join(deps, frontier["node"] == deps["source"]).select("run", F.col("target").alias("node")).distinct()
            frontier = cut(step.join(seen, ["run", "node"], "left_anti").withColumn("depth", F.lit(depth)))
            if frontier.isEmpty():
                break
            seen = cut(seen.unionByName(frontier)) if depth % 8 == 0 else seen.unionByName(frontier)
            frontier = frontier.join(live.where("not locked").select("node"), "node", "left_semi")
    items = seen.where("depth > 0").join(live, "node", "left")
    status = F.when(F.col("locked").isNull(), "cutoff").when(F.col("locked"), "skipped").otherwise("dirty")
    if nodes is None:
        return items.select("run", "node", "depth", status.alias("status"))
    size = items.groupBy("run").agg(F.count("*").alias("n"))
    return items.join(size, "run").select("run", "node", "depth", F.when(F.col("n") > nodes, "blocked").otherwise(status).alias("status"))


def _passed(deps: DataFrame, live: DataFrame, triggers: DataFrame, starts: DataFrame) -> DataFrame:
    """run, node, depth: all that starts (run, node) lead to, of runs with one trigger each; triggers (run, node) themselves left out.

    Steps double: nodes within 2^i of a run's first are joined to those at 2^i from them, so rounds grow with the
    logarithm of the depth.  Least depths are exact, as each part of a shortest way is one.  Nodes that pass
    nothing on are met once, at the end."""
    least = F.min("depth").alias("depth")
    free = live.where("not locked").select(F.col("node").alias("source"))
    onward = cut(deps.join(free, "source", "left_semi"))
    passing = cut(onward.select(F.col("source").alias("node")).distinct())
    first = cut(starts.join(deps.withColumnRenamed("source", "node"), "node").select("run", F.col("target").alias("node"), F.lit(1).alias("depth")).join(triggers.select("run", "node"), ["run", "node"], "left_anti"))
    met = cut(first.join(passing, "node", "left_semi"))
    jump, length, had = cut(onward.join(passing.withColumnRenamed("node", "target"), "target", "left_semi").where("source != target").select("source", "target")), 1, met.count()
    while had:
        further = met.join(jump, met["node"] == jump["source"]).select("run", F.col("target").alias("node"), (F.col("depth") + length).alias("depth"))
        met = cut(met.unionByName(further).groupBy("run", "node").agg(least))
        before, had = had, met.count()
        if had == before:
            break
        ahead = jump.select(F.col("source").alias("target"), F.col("target").alias("to"))
        jump = cut(jump.join(ahead, "target").select("source", F.col("to").alias("target")).distinct())
        length *= 2
    ends = onward.join(passing.withColumnRenamed("node", "target"), "target", "left_anti")
    ends = met.join(ends.withColumnRenamed("source", "node"), "node").select("run", F.col("target").alias("node"), (F.col("depth") + 1).alias("depth"))
    out = first.unionByName(met).unionByName(ends).groupBy("run", "node").agg(least)
    return out.join(triggers.select("run", "node"), ["run", "node"], "left_anti")


def topo_order(items: DataFrame, deps: DataFrame) -> DataFrame:
    """items (run, node), deps (source, target) -> run, node, pos: parents first, ties by id; nodes on cycles have no pos.

    Runs are bounded (40 nodes), so each is ordered in one group."""
    inner = items.select("run", F.col("node").alias("source")).join(deps.select("source", "target").distinct(), "source")
    inner = inner.join(items.select("run", F.col("node").alias("target")), ["run", "target"])
    rows = items.select("run", "node").distinct().join(inner.groupBy("run", F.col("target").alias("node")).agg(F.sort_array(F.collect_set("source")).alias("parents")), ["run", "node"], "left")

    def order(pdf):
        parents = {n: set(p) - {n} if p is not None else set() for n, p in zip(pdf["node"], pdf["parents"], strict=True)}
        pos: dict[str, int] = {}
        while ready := sorted(n for n, p in parents.items() if n not in pos and p <= pos.keys()):
            pos[ready[0]] = len(pos)
        out = pdf[["run", "node"]].copy()
        out["pos"] = [pos.get(n) for n in out["node"]]
        out["pos"] = out["pos"].astype("Int64")
        return out

    return rows.groupBy("run").applyInPandas(order, "run string, node string, pos long")


def job_sweep(jobs: DataFrame, now, most: int = 3) -> DataFrame:
    """jobs (job, status, attempts, lease_until) -> with expired running jobs queued again, or failed after the last attempt."""
    expired = (F.col("status") == "running") & (F.col("lease_until") <= now)
    return jobs.withColumn("status", F.when(expired & (F.col("attempts") < most), "queued").when(expired, "failed").otherwise(F.col("status")))


def job_items(jobs: DataFrame, items: DataFrame, now, most: int = 3) -> DataFrame:
    """jobs as job_sweep with run and node, items (run, node, status) -> run, node, status, reason: a queued item is blocked
    if a job of it ran out of attempts and none is left that waits or runs."""
    swept = job_sweep(jobs, now, most)
    out_of = jobs.where((F.col("status") == "running") & (F.col("lease_until") <= now) & (F.col("attempts") >= most)).select("run", "node").distinct().withColumn("exhausted", F.lit(True))
    active = swept.where("status in ('queued', 'running')").select("run", "node").distinct().withColumn("active", F.lit(True))
    met = items.join(out_of, ["run", "node"], "left").join(active, ["run", "node"], "left")
    blocked = (F.col("status") == "queued") & F.coalesce("exhausted", F.lit(False)) & F.col("active").isNull()
    return met.select("run", "node", F.when(blocked, "blocked").otherwise(F.col("status")).alias("status"), F.when(blocked, "a worker's lease ran out").alias("reason"))


def job_claims(jobs: DataFrame, workers: int, now, lease_sec: int = 300, most: int = 3) -> DataFrame:
    """jobs (job, status, attempts, ts) after a sweep -> job, worker, attempts, lease_until: the oldest that wait, one for each of so many workers."""
    first = jobs.where((F.col("status") == "queued") & (F.col("attempts") < most)).orderBy("ts", "job").limit(workers)
    at = F.row_number().over(Window.orderBy("ts", "job")) - 1  # no more rows than workers
    return first.select("job", at.alias("worker"), (F.col("attempts") + 1).alias("attempts"), (F.lit(now).cast("timestamp") + F.make_interval(secs=F.lit(lease_sec))).alias("lease_until"))


def job_finish_rollup(jobs: DataFrame) -> DataFrame:
    """jobs (run, node, status) -> run, node, item: proposed, blocked if any failed, cutoff if all were skipped."""
    s = F.col("status")
    item = F.when(F.bool_or(s == "failed"), "blocked").when(F.bool_and(s == "skipped"), "cutoff").when(F.bool_and(s.isin("done", "skipped")), "proposed").otherwise("waiting")
    return jobs.groupBy("run", "node").agg(item.alias("item"))


def typed_changed(then: DataFrame, now: DataFrame, columns: list[str]) -> DataFrame:
    """then (node, columns), now (node, columns) -> node, changed: whether the typed part of a node differs; one that is gone changed."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select("node", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias(name))

    both = digest(then, "a").join(digest(now, "b"), "node", "left")
    return both.select("node", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def job_staleness(jobs: DataFrame, current: DataFrame) -> DataFrame:
    """jobs (job, target, target_rev, sources array<struct<node, rev>>), current (node, rev) -> job, stale."""
    now = current.select("node", F.col("rev").alias("now"))
    asked = jobs.select("job", F.explode(F.array_append("sources", F.struct(F.col("target").alias("node"), F.col("target_rev").alias("rev")))).alias("x")).select("job", "x.node", "x.rev")
    met = asked.join(now, "node", "left")
    return met.groupBy("job").agg(F.bool_or(F.col("now").isNull() | (F.col("now") != F.col("rev"))).alias("stale"))


def propagate_cycles(items: DataFrame, deps: DataFrame) -> DataFrame:
    """items (run, node), deps (source, target) -> run, node: nodes on a cycle of the edges inside their run.

    The nodes of all runs are told apart by run, so one pass serves them all."""
    nodes = items.select("run", "node").distinct()
    inner = nodes.withColumnRenamed("node", "source").join(deps.select("source", "target").distinct(), "source")
    inner = inner.join(nodes.withColumnRenamed("node", "target"), ["run", "target"])
    own = [F.to_json(F.struct("run", F.col(c).alias("node"))).alias(e) for c, e in (("source", "src"), ("target", "dst"))]
    found = on_cycles(inner.select(*own)).select(F.from_json("id", f"run {nodes.schema['run'].dataType.simpleString()}, node string").alias("x"))
    return found.select("x.run", "x.node").distinct()


def run_iteration(proposals: DataFrame) -> DataFrame:
    """proposals (proposal, trigger) -> proposal, iteration: how many proposals of a cascade lie before it, itself included; safe on cycles.

    Ways back through proposals with one trigger each are walked by steps that double; only what lies on or
    behind a cycle, or a proposal with several triggers, is reached step by step."""
    back = cut(proposals.where("proposal is not null and trigger is not null").select(F.col("proposal").alias("src"), F.col("trigger").alias("dst")).distinct())
    fan = back.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("at"))
    several = fan.where("n > 1").select("src")
    walk = cut(fan.where("n = 1").select("src", "at", F.lit(1).alias("steps"), F.lit(True).alias("on")))
    going = walk.count()
    while going:
        ahead = walk.select(F.col("src").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"))
        walk = cut(walk.join(ahead, "at", "left").select("src", F.coalesce("to", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("to").isNotNull().alias("on")))
        before, going = going, walk.where("on").count()
        if going == before:  # on a way that ends, every distance to its end occurs, so what is left goes round
            break
    # several triggers, on the way or at once, and what goes round
    slow = walk.where("on").select("src") if going else walk.select("src").limit(0)
    slow = cut(slow.union(several).union(walk.join(several.withColumnRenamed("src", "at"), "at", "left_semi").select("src")).distinct().select(F.col("src").alias("proposal")))
    every = proposals.select("proposal").distinct()
    ended = every.join(slow, "proposal", "left_anti").join(walk.select(F.col("src").alias("proposal"), "steps"), "proposal", "left")
    ended = ended.select("proposal", (F.coalesce("steps", F.lit(0)) + 1).alias("iteration"))
    start = slow.join(every, "proposal", "left_semi").select(F.col("proposal").alias("run"), F.col("proposal").alias("id"))
    return ended.unionByName(reach(back, start).groupBy(F.col("run").alias("proposal")).agg((F.max("depth") + 1).alias("iteration")))


def derive_candidates(g: Graph, contracts: DataFrame, parents: DataFrame, dirty: DataFrame) -> DataFrame:
    """contracts (target, source, source_field, target_field), parents (source, target), dirty (node) -> target, field, to_val, idem_key.

    A copy is proposed where the source is a traversed parent, not dirty itself, and holds another value
    than the target; contracts that disagree on one field of a target propose nothing."""
    node = g.live_node.select("id", "title", "summary", "props")
    of_source = contracts.join(parents.select("source", "target").distinct(), ["source", "target"], "left_semi")
    of_source = of_source.join(node.withColumnRenamed("id", "source"), "source").withColumn("value", field_value("source_field")).drop("title", "summary", "props")
    agreed = of_source.groupBy("target", "target_field").agg(F.countDistinct("value").alias("n"), F.max("value").alias("to_val"), F.count_if(F.col("value").isNull()).alias("blank")).where("n = 1 and blank = 0")
    waiting = parents.join(dirty.select(F.col("node").alias("source")).distinct(), "source", "left_semi").select("target").distinct()
    now = agreed.join(waiting, "target", "left_anti").join(node.withColumnRenamed("id", "target"), "target").withColumn("now", field_value("target_field"))
    key = F.sha2(F.concat_ws("|", F.lit("derive"), "target", "target_field", "to_val"), 256)
    return now.where(~F.col("now").eqNullSafe(F.col("to_val"))).select("target", F.col("target_field").alias("field"), "to_val", key.alias("idem_key"))


def rederive_jobs(contracts: DataFrame, items: DataFrame, parents: DataFrame, human: DataFrame, deepest: int = 2, budget: int = 20_000) -> DataFrame:
    """contracts (target, sources, target_field, max_tokens), items (run, node, depth), parents (source, target), human (node, rev)
    -> run, target, field, status: 'queued', or why not.  Tokens are reserved in the order of depth and target, by run."""
    linked = parents.groupBy("target").agg(F.collect_set("source").alias("linked"))
    j = contracts.join(items.withColumnRenamed("node", "target"), "target").join(linked, "target", "left").join(human.select(F.col("node").alias("target"), "rev"), "target", "left")
    reason = (
        F.when(F.col("depth") > deepest, "too deep").when(F.col("rev").isNull(), "no human revision")
        .when(F.size(F.array_except("sources", F.coalesce("linked", F.array().cast("array<string>")))) > 0, "source is no parent")
    )
    j = j.withColumn("reason", reason)
    order = Window.partitionBy("run").orderBy("depth", "target", "target_field").rowsBetween(Window.unboundedPreceding, 0)
    reserved = F.sum(F.when(F.col("reason").isNull(), F.col("max_tokens")).otherwise(0)).over(order)
    j = j.withColumn("reserved", reserved)
    status = F.coalesce("reason", F.when(F.col("reserved") > budget, "over budget"), F.lit("queued"))
    return j.select("run", "target", F.col("target_field").alias("field"), status.alias("status"))


def cascade_audit(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """items (run, node, status), jobs (run, target, status) -> run, nodes, dirty, blocked, jobs, queued: what a run's record says."""
    of_items = items.groupBy("run").agg(F.count("*").alias("nodes"), F.count_if(F.col("status") == "dirty").alias("dirty"), F.count_if(F.col("status") == "blocked").alias("blocked"))
    of_jobs = jobs.groupBy("run").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "queued").alias("queued"))
    both = of_items.join(of_jobs, "run", "left")
    return both.select("run", "nodes", "dirty", "blocked", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("queued", F.lit(0)).alias("queued"))


def job_recover(jobs: DataFrame, ops: DataFrame) -> DataFrame:
    """jobs (job, target, field, basis_rev) -> job, proposal: the first proposal of one operation alone that already does what the job asks."""
    single = ops.withColumn("n", F.count("*").over(Window.partitionBy("proposal"))).where("n = 1 and verb = 'UPDATE'")
    met = jobs.join(single.select("proposal", "target", "field", "basis_rev", "ts"), ["target", "field", "basis_rev"])
    first = F.row_number().over(Window.partitionBy("job").orderBy("ts", "proposal"))
    return met.withColumn("n", first).where("n = 1").select("job", "proposal")
