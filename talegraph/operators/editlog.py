"""The edit log: proposals of operations, checked, graded and applied.

ops: proposal, seq, verb, target, field, from_val, to_val, basis_rev, idem_key, ts
reads: proposal, node, rev"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import policy_dim
from ..functions.columns import prop
from ..model import Graph, cut
from .reads import address_parse

VERBS = ("ADD", "UPDATE", "INVALIDATE", "LINK", "UNLINK")
RANK = {"auto": 0, "review": 1, "always": 2}


def ops_shape_check(ops: DataFrame, most_ops: int = 100) -> DataFrame:
    """proposal, errors: what is wrong with the shape of its operations; sound proposals are left out."""
    linked = F.col("verb").isin("LINK", "UNLINK")
    checks = [
        (~F.col("verb").isin(*VERBS), "unknown verb"),
        (F.col("verb").isin("UPDATE", "LINK", "UNLINK") & F.col("field").isNull(), "field is missing"),
        (linked & F.col("to_val").isNull(), "other end is missing"),
        ((F.col("verb") != "ADD") & F.col("basis_rev").isNull(), "basis revision is missing"),
        (F.coalesce(F.length("idem_key"), F.lit(0)).between(8, 200) == F.lit(False), "idempotency key length"),
    ]
    wrong = F.filter(F.array(*(F.when(c, F.lit(m)) for c, m in checks)), lambda x: x.isNotNull())
    each = ops.select("proposal", F.explode(wrong).alias("error"))
    tally = ops.groupBy("proposal").agg(F.count("*").alias("n"), F.countDistinct("idem_key").alias("keys"))
    whole = tally.select("proposal", F.explode(F.filter(F.array(F.when(F.col("n") > most_ops, F.lit("too many operations")), F.when(F.col("keys") < F.col("n"), F.lit("repeated idempotency key"))), lambda x: x.isNotNull())).alias("error"))
    return each.union(whole).groupBy("proposal").agg(F.sort_array(F.collect_set("error")).alias("errors"))


def ops_normalize_refs(ops: DataFrame, kinds: DataFrame) -> DataFrame:
    """ops with the ids of their targets and of the ends of links in canonical form; what is no id stays."""
    linked = F.col("verb").isin("LINK", "UNLINK")
    refs = ops.select(F.explode(F.array_compact(F.array("target", F.when(linked, F.col("to_val"))))).alias("ref")).distinct()
    known = address_parse(refs, kinds).where("valid").select("ref", "canonical")
    out = ops.join(known.select(F.col("ref").alias("target"), F.col("canonical").alias("own")), "target", "left")
    out = out.join(known.select(F.col("ref").alias("to_val"), F.col("canonical").alias("other")), "to_val", "left")
    out = out.withColumn("target", F.coalesce("own", "target")).withColumn("to_val", F.when(linked, F.coalesce("other", "to_val")).otherwise(F.col("to_val")))
    return out.select(*ops.columns)


def ops_read_coverage(ops: DataFrame, reads: DataFrame) -> DataFrame:
    """proposal, node: touched but neither read nor added in the same proposal; or read at another revision than its basis."""
    ends = ops.where("verb != 'ADD'").select("proposal", F.col("target").alias("node"), "basis_rev")
    other = ops.where("verb in ('LINK', 'UNLINK')").select("proposal", F.col("to_val").alias("node"), F.lit(None).cast("int").alias("basis_rev"))
    known = reads.select("proposal", "node", "rev").unionByName(ops.where("verb = 'ADD'").select("proposal", F.col("target").alias("node"), F.lit(None).cast("int").alias("rev")))
    known = known.groupBy("proposal", "node").agg(F.max("rev").alias("rev"))
    met = ends.unionByName(other).join(known.withColumn("there", F.lit(True)), ["proposal", "node"], "left")
    return met.where("there is null or (basis_rev is not null and rev is not null and basis_rev != rev)").select("proposal", "node").distinct()


def ops_idempotency(ops: DataFrame) -> DataFrame:
    """proposal, status: 'first' use of its keys, 'repeat' of an earlier proposal, or 'reused' with other content or in part."""
    payload = F.sha2(F.concat_ws("|", "verb", "target", F.coalesce("field", F.lit("")), F.coalesce("to_val", F.lit(""))), 256)
    first = Window.partitionBy("idem_key").orderBy("ts", "proposal", "seq")
    o = ops.withColumn("payload", payload).withColumn("owner", F.first("proposal").over(first)).withColumn("was", F.first("payload").over(first))
    per = o.groupBy("proposal").agg(F.bool_and(F.col("owner") == F.col("proposal")).alias("own"), F.bool_and(F.col("payload") == F.col("was")).alias("same"), F.bool_or(F.col("owner") == F.col("proposal")).alias("some"))
    return per.select("proposal", F.when(F.col("own"), "first").when(F.col("same") & ~F.col("some"), "repeat").otherwise("reused").alias("status"))


def pending_overlap(ops: DataFrame) -> DataFrame:
    """a, b, target: open proposals that touch one node at the same field, or in any other way than UPDATE."""
    o = ops.select("proposal", "target", "field", "verb").distinct()
    a, b = o.select(*(F.col(c).alias(f"a_{c}") for c in o.columns if c != "target"), "target"), o.select(*(F.col(c).alias(f"b_{c}") for c in o.columns if c != "target"), "target")
    met = a.join(b, "target").where("a_proposal < b_proposal").where("a_verb != 'UPDATE' or b_verb != 'UPDATE' or a_field = b_field")
    return met.select(F.col("a_proposal").alias("a"), F.col("b_proposal").alias("b"), "target").distinct()


def detect_conflicts(reads: DataFrame, ops: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """current (node, rev), changes (node, rev, field) -> proposal, node, conflict.

    A newer revision is no conflict if the proposal only updates fields that no later revision touched."""
    r = reads.join(current.select("node", F.col("rev").alias("now")), "node", "left")
    mine = ops.groupBy("proposal", F.col("target").alias("node")).agg(F.bool_and(F.col("verb") == "UPDATE").alias("updates"), F.collect_set("field").alias("fields"))
    since = r.join(changes.select("node", F.col("rev").alias("at"), "field"), "node").where("at > rev").groupBy("proposal", "node").agg(F.collect_set("field").alias("changed"))
    r = r.join(mine, ["proposal", "node"], "left").join(since, ["proposal", "node"], "left")
    apart = F.coalesce(F.col("updates"), F.lit(False)) & ~F.coalesce(F.arrays_overlap("fields", "changed"), F.lit(False))
    conflict = F.when(F.col("now").isNull(), "missing").when((F.col("now") != F.col("rev")) & ~apart, "revision_mismatch")
    return r.select("proposal", "node", conflict.alias("conflict")).where("conflict is not null")


def risk_assess(g: Graph, ops: DataFrame, rels: DataFrame) -> DataFrame:
    """proposal, risk, reasons, forbidden: every policy that matches any operation counts; the highest grade stands."""
    node = g.live_node.select(F.col("id").alias("target"), "kind", "locked", "props")
    o = ops.join(node, "target", "left").join(F.broadcast(rels.select(F.col("rel").alias("field"), F.col("hard").alias("rel_hard"))), "field", "left")
    value = F.when(F.col("verb") == "UPDATE", F.try_variant_get(F.try_parse_json("props"), F.concat(F.lit("$."), F.regexp_replace("field", r"^props\.", "")), "string"))
    o = o.select("proposal", "seq", "verb", "target", "field", F.coalesce("kind", F.initcap(F.substring_index("target", "/", 1))).alias("kind"), F.coalesce("locked", F.lit(False)).alias("locked"), F.col("rel_hard").alias("hard"), value.alias("value"), "to_val")
    p = F.broadcast(policy_dim(ops.sparkSession).select("policy", "risk", "effect", "verbs", *(F.col(c).alias(f"p_{c}") for c in ("kind", "field", "rel", "hard", "locked", "value"))))

    def fits(wanted: str, actual):
        return F.col(wanted).isNull() | F.coalesce(F.col(wanted) == actual, F.lit(False))

    rel = F.when(F.col("verb").isin("LINK", "UNLINK"), F.col("field"))
    match = (
        (F.col("verbs").isNull() | F.array_contains("verbs", F.col("verb"))) & fits("p_kind", F.col("kind")) & fits("p_field", F.col("field")) & fits("p_rel", rel) & fits("p_hard", F.col("hard"))
        & fits("p_locked", F.col("locked")) & (F.col("p_value").isNull() | (F.col("p_value") == F.when(F.col("value").isNull(), "null").otherwise("set")))
    )
    hit = o.join(p, match, "left")
    grade = F.when(F.col("policy").isNull(), 1).otherwise(F.element_at(F.create_map(*(x for k, v in RANK.items() for x in (F.lit(k), F.lit(v)))), F.col("risk")))
    reason = F.coalesce("policy", F.concat(F.lower("verb"), F.lit("-default")))
    rows = hit.groupBy("proposal").agg(F.max(grade).alias("grade"), F.collect_set(reason).alias("reasons"), F.count_if(F.col("effect") == "forbid").alias("forbidden"))
    ends = o.select("proposal", F.explode(F.array_compact(F.array("target", F.when(F.col("verb").isin("LINK", "UNLINK"), F.col("to_val"))))).alias("node"))
    spread = ends.groupBy("proposal").agg(F.countDistinct("node").alias("n"))
    rows = rows.join(spread, "proposal")
    wide = F.when(F.col("n") >= 40, F.lit("cascade-40-plus")).when(F.col("n") >= 3, F.lit("cascade-3-plus"))
    grade = F.greatest("grade", F.when(F.col("n") >= 40, 2).when(F.col("n") >= 3, 1).otherwise(0))
    names = F.array(*(F.lit(k) for k in RANK))
    return rows.select("proposal", F.element_at(names, grade + 1).alias("risk"), F.sort_array(F.array_compact(F.array_append("reasons", wide))).alias("reasons"), "forbidden")


def bump_revisions(ops: DataFrame, base: DataFrame) -> DataFrame:
    """Applied ops and base (node, rev) -> node, rev, field, proposal, derived_from, tx_from, tx_to: one revision an operation, in order."""
    by = Window.partitionBy("node").orderBy("ts", "proposal", "seq")
    o = ops.select(F.col("target").alias("node"), "field", "proposal", "seq", "ts").join(base, "node", "left").withColumn("rev", F.coalesce("rev", F.lit(0)) + F.row_number().over(by))
    return o.select("node", "rev", "field", "proposal", (F.col("rev") - 1).alias("derived_from"), F.col("ts").alias("tx_from"), F.lead("ts").over(by).alias("tx_to"))


def revision_asof(revisions: DataFrame, at) -> DataFrame:
    """The revision of each node that held at a transaction time."""
    return revisions.where((F.col("tx_from") <= at) & (F.col("tx_to").isNull() | (F.col("tx_to") > at)))


def commit_batch(ops: DataFrame, reads: DataFrame, order: DataFrame, current: DataFrame) -> DataFrame:
    """order (proposal, commit_seq), current (node, rev, fields map<string,int>) -> proposal, commit_seq, status.

    All or nothing, as if one after another.  A round takes the proposals that are the first left on all
    that they read or write; they cannot touch each other.  Each is accepted if every node it read is at
    the revision read, or the proposal only updates fields that did not change since; accepted writes
    move the revisions that the next round meets.  Rounds are as many as the longest chain on one node."""
    foot = ops.select("proposal", F.col("target").alias("node"), F.lit(True).alias("writes"))
    foot = foot.unionByName(ops.where("verb in ('LINK', 'UNLINK')").select("proposal", F.col("to_val").alias("node"), F.lit(False).alias("writes"))).unionByName(reads.select("proposal", "node", F.lit(False).alias("writes")))
    foot = cut(foot.groupBy("proposal", "node").agg(F.max("writes").alias("writes")).join(order, "proposal"))
    left, state, done = foot, cut(current), None
    while not left.isEmpty():
        head = left.groupBy("node").agg(F.min("commit_seq").alias("head"))
        ready = left.join(head, "node").groupBy("proposal", "commit_seq").agg(F.bool_and(F.col("commit_seq") == F.col("head")).alias("free")).where("free").drop("free")
        ready = cut(ready)
        mine = ops.join(ready.select("proposal"), "proposal")
        wrote = mine.groupBy("proposal", F.col("target").alias("node")).agg(F.bool_and(F.col("verb") == "UPDATE").alias("updates"), F.collect_set("field").alias("fields"), F.count("*").alias("n"))
        seen = reads.join(ready.select("proposal"), "proposal").join(state.select("node", F.col("rev").alias("now"), F.col("fields").alias("moved")), "node", "left").join(wrote, ["proposal", "node"], "left")
        newer = F.exists("fields", lambda f: F.coalesce(F.col("moved")[f], F.lit(0)) > F.col("rev"))
        fine = (F.coalesce("now", F.lit(0)) == F.col("rev")) | (F.coalesce("updates", F.lit(False)) & ~F.coalesce(newer, F.lit(False)))
        judged = ready.join(seen.groupBy("proposal").agg(F.bool_and(fine).alias("fine")), "proposal", "left")
        judged = cut(judged.select("proposal", "commit_seq", F.when(F.coalesce("fine", F.lit(True)), "accepted").otherwise("rejected").alias("status")))
        done = judged if done is None else done.unionByName(judged)
        moved = wrote.join(judged.where("status = 'accepted'").select("proposal"), "proposal").select("node", "n", "fields")
        state = state.join(moved.withColumnRenamed("fields", "new"), "node", "full")
        rev = F.coalesce("rev", F.lit(0)) + F.coalesce("n", F.lit(0))
        fresh = F.map_from_arrays(F.coalesce("new", F.array().cast("array<string>")), F.transform(F.coalesce("new", F.array().cast("array<string>")), lambda _: rev.cast("int")))
        keep = F.map_filter(F.coalesce("fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))), lambda k, _: ~F.coalesce(F.array_contains("new", k), F.lit(False)))
        state = cut(state.select("node", rev.cast("int").alias("rev"), F.map_concat(keep, fresh).alias("fields")))
        left = cut(left.join(ready.select("proposal"), "proposal", "left_anti"))
    return done


def _whole(ids: np.ndarray, b: pa.RecordBatch, sides: int) -> list[tuple[str, str]]:
    """Rows of ids that are whole, sorted -> (id, cid); ids: a number for each row's id."""
    side, part, line, x = b.column("side").to_numpy(), b.column("part"), b.column("line"), b.column("x")
    own, mine = np.flatnonzero(side < 0), np.flatnonzero(side >= 0)
    new = np.r_[True, (ids[1:] != ids[:-1]) | (side[1:] != side[:-1]) | pc.not_equal(part[1:], part[:-1]).to_numpy(zero_copy_only=False)] if len(ids) else np.zeros(0, bool)
    starts = mine[new[mine]]
    ends = np.r_[starts[1:], len(side)]
    hashes = line.take(pa.array(starts))
    several = new[starts] & ~np.r_[new, True][starts + 1] if len(starts) else np.zeros(0, bool)
    if several.any():
        more = []
        for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            last = s + 1
            while last < e and not new[last]:
                last += 1
            more.append(hashlib.md5(",".join(x[s : last].to_pylist()).encode(), usedforsecurity=False).hexdigest())
        hashes = pc.replace_with_mask(hashes, pa.array(several), pa.array(more, pa.string()))
    told = pc.binary_join_element_wise(part.take(pa.array(starts)), hashes, "")
    places = np.searchsorted(ids[starts] * sides + side[starts], np.arange((int(ids[-1]) + 1) * sides + 1))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(places, pa.int32()), told), ",")
    joined = pc.if_else(pc.equal(joined, ""), "-", joined)
    content = pc.utf8_slice_codeunits(x.take(pa.array(own)), 0, -2)
    text = pc.binary_join_element_wise(content, *(joined.take(pa.array(ids[own] * sides + i)) for i in range(sides)), '","')
    return [(i, hashlib.sha256(t.encode() + b'"]').hexdigest()) for i, t in zip(b.column("id").take(pa.array(own)).to_pylist(), text.to_pylist(), strict=True)]


def _hashed(sides: int):
    """(id, side, part, x, line: hash of x), sorted -> id, cid; side -1 is a node's own content.

    Ids that lie within a batch are hashed together.  Those that lie in several are hashed row by row as
    they come, so a node with many rows takes no memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, own, found, at, line = None, [], [[] for _ in range(sides)], None, None

        def told() -> list:
            if line is not None:
                found[at[0]].append(at[1] + line.hexdigest())
            tail = "".join(',"' + (",".join(f) or "-") + '"' for f in found) + "]"
            return [(ident, hashlib.sha256((x[:-1] + tail).encode()).hexdigest()) for x in own]

        def batch(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], pa.string()) for n in (0, 1)], ["id", "cid"])

        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("id")
            ids = np.cumsum(np.r_[False, pc.coalesce(pc.not_equal(names[1:], names[:-1]), True).to_numpy(zero_copy_only=False)])
            # the first id may go on from the batch before, the last one into the next
            first, last = int(np.searchsorted(ids, 1)), int(np.searchsorted(ids, ids[-1]))
            out = []
            for s, e in ((0, first), (max(first, last), b.num_rows)):
                each = b.slice(s, e - s)
                for i, side, part, x in zip(*(each.column(c).to_pylist() for c in ("id", "side", "part", "x")), strict=True):
                    if i != ident:
                        out += told()
                        ident, own, found, at, line = i, [], [[] for _ in range(sides)], None, None
                    if side < 0:
                        own.append(x)
                    elif at == (side, part):
                        line.update(b"," + x.encode())
                    elif own:
                        if line is not None:
                            found[at[0]].append(at[1] + line.hexdigest())
                        at, line = (side, part), hashlib.md5(x.encode(), usedforsecurity=False)
                if s == 0 and first < last:
                    out += _whole(ids[first:last] - 1, b.slice(first, last - first), sides)
            yield batch(out)
        yield batch(told())

    return run


def content_cid(g: Graph) -> DataFrame:
    """id, cid: hash of a live node's content as one JSON array, with sorted aliases, tags, viewers, spans and outgoing edges.

    What belongs to a node is hashed in parts, by the first two digits of each line's own hash.  Nodes and all that
    belongs to them are dealt out by id once and sorted."""

    def listed(*parts: str):
        texts = [F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts]
        escaped = F.concat(*texts).rlike(r'["\\\x00-\x1F]')
        return F.when(escaped, F.to_json(F.array(*texts))).otherwise(F.concat(F.lit('["'), F.concat_ws('","', *texts), F.lit('"]')))

    own = listed("id", "kind", "title", "summary", "props", "story_from", "story_to", "reveal_at", "locked")
    rows = g.live_node.select("id", F.lit(-1).alias("side"), F.lit("").alias("part"), own.alias("x"))
    sides = [(g.node_alias, "node", listed("alias")), (g.node_tag, "node", listed("tag")), (g.live_edge, "src", listed("rel", "dst")), (g.visibility, "fact", listed("viewer", "learned_at", "pathway")), (g.evidence, "node", listed("file", "start_off", "end_off"))]
    for i, (side, key, value) in enumerate(sides):
        lines = side.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), value.alias("x"))
        rows = rows.unionByName(lines.select("id", F.lit(i).alias("side"), F.substring(F.md5("x"), 1, 2).alias("part"), "x"))
    rows = rows.repartition("id").sortWithinPartitions("id", "side", "part", "x")
    return rows.withColumn("line", F.md5("x")).mapInArrow(_hashed(len(sides)), "id string, cid string")


#: Ids that a leaf of the graph's hash tree should hold.
LEAF = 1_024


def root_digits(n: int) -> int:
    """Hexadecimal digits that name the leaves of a tree over n ids; fixed for the life of a graph."""
    digits = 1
    while n > LEAF << 4 * digits:
        digits += 1
    return digits


def root_leaves(cids: DataFrame, digits: int) -> DataFrame:
    """cids (id, cid) -> leaf, hash: ranges of the hashed ids, each with a hash of its sorted ids and contents."""
    leaf = F.substring(F.sha2("id", 256), 1, digits).alias("leaf")
    line = F.to_json(F.array("id", "cid"))
    return cids.groupBy(leaf).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ","), 256).alias("hash"))


def root_update(leaves: DataFrame, cids: DataFrame, changed: DataFrame, digits: int) -> DataFrame:
    """Leaves after a commit: only those of changed (id) are hashed again; ids that are gone are in changed and not in cids."""
    mine = changed.select(F.substring(F.sha2("id", 256), 1, digits).alias("leaf")).distinct()
    here = cids.withColumn("leaf", F.substring(F.sha2("id", 256), 1, digits)).join(mine, "leaf", "left_semi")
    return leaves.join(mine, "leaf", "left_anti").unionByName(root_leaves(here.select("id", "cid"), digits))


def root_of(leaves: DataFrame, digits: int) -> DataFrame:
    """root: leaves are folded sixteen at a time, a digit a level, so no list has more than sixteen parts."""
    level = leaves.select("leaf", "hash")
    for n in range(digits - 1, -1, -1):
        parts = F.array_join(F.sort_array(F.collect_list(F.to_json(F.array("leaf", "hash")))), ",")
        level = level.groupBy(F.substring("leaf", 1, n).alias("up")).agg(F.sha2(parts, 256).alias("hash")).withColumnRenamed("up", "leaf")
    return level.select(F.col("hash").alias("root"))


def graph_root(cids: DataFrame, digits: int) -> DataFrame:
    """root of the whole graph."""
    return root_of(root_leaves(cids, digits), digits)


def branch_track(log: DataFrame) -> DataFrame:
    """log (session, commit_seq, ts, status) -> session, first_ts, base, head, status: from the outcomes of its commits."""
    accepted = F.when(F.col("status") == "accepted", F.col("commit_seq"))
    last = F.max_by("status", "commit_seq")
    return log.groupBy("session").agg(F.min("ts").alias("first_ts"), F.min(accepted).alias("base"), F.max(accepted).alias("head"), F.when(last == "rejected", "conflicted").otherwise("active").alias("status"))


def provenance(revisions: DataFrame, origin: str = "agent") -> DataFrame:
    """Revisions -> node, rev, field, generated_by, derived_from, origin: one row for each version and field."""
    return revisions.select("node", "rev", F.coalesce("field", F.lit("*")).alias("field"), F.col("proposal").alias("generated_by"), F.when(F.col("derived_from") > 0, F.col("derived_from")).alias("derived_from"), F.lit(origin).alias("origin"))


def review_queue(ops: DataFrame, risks: DataFrame, accepted: DataFrame) -> DataFrame:
    """Proposals not accepted, newest first by last_ts, with their risk and their operations in order."""
    listed = ops.groupBy("proposal").agg(F.max("ts").alias("last_ts"), F.sort_array(F.collect_list(F.struct("seq", "verb", "target", "field"))).alias("ops"))
    return listed.join(accepted.select("proposal"), "proposal", "left_anti").join(risks, "proposal", "left")
