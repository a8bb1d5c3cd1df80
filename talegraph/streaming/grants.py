"""Leases granted or refused in order, in batch and as a stream.

A scope is `book`, or parts joined by `/` and `.`, as kind/A.B, with `.*` at the end if it holds all
below it.  An acquire is refused while another session holds a scope that overlaps; the same session
and scope again is a renewal; a lease ends when it expires or is released.

Actions are folded by tree: scopes overlap only within one tree (kind and first part), so trees are
streams of their own, each with the leases that it holds at the time as its state.  A scope above trees
(`book`, kind.*) is an action in each of them and is granted if none refuses it; those verdicts come
from the round before, and rounds repeat until none changes, as each depends on earlier actions only.
Without such scopes there is one round."""

from __future__ import annotations

import datetime
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import cut

_OUT = "what string, tree string, ts timestamp, session string, scope string, action string, ttl int, ok boolean, renewed boolean, expires_at timestamp"
_ACT = ["ts", "session", "scope", "action", "ttl"]
BOOK = "book"
#: Parts that trees are dealt into, where a scope is in all of them.
PARTS = 64


@dataclass(frozen=True)
class Grants:
    """outcomes: ts, session, scope, action, ttl, outcome (acquired, renewed, refused, released, nothing), expires_at; held: session, scope, expires_at"""

    outcomes: DataFrame
    held: DataFrame


def _base(scope: Column) -> Column:
    return F.regexp_replace(scope, r"\.\*$", "")


def _tree(scope: Column) -> Column:
    """Kind and first part; null for scopes above trees."""
    found = F.regexp_extract(_base(scope), r"^([^/.]+[/.][^/.]+)", 1)
    return F.when(found != "", found)


def _above(base: str) -> list[str]:
    """Scopes that hold this one if they are wild."""
    return [BOOK, *(base[:i] for i, c in enumerate(base) if c in "./")]


class _Tree:
    """Leases held in one tree, by scope and by every scope above."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, str], datetime.datetime] = {}
        self.ends: list[tuple[datetime.datetime, str, str]] = []
        self.at: dict[str, dict[str, int]] = {}  # sessions that hold leases at a base, ...
        self.wild: dict[str, dict[str, int]] = {}  # ... of these the wild ones, ...
        self.inside: dict[str, dict[str, int]] = {}  # ... and those somewhere below it

    def _count(self, session: str, scope: str, n: int) -> None:
        base = scope.removesuffix(".*")
        places = [(self.at, base), *((self.inside, a) for a in _above(base) if a != base)]
        if scope == BOOK or scope.endswith(".*"):
            places.append((self.wild, base))
        for index, key in places:
            by = index.setdefault(key, {})
            by[session] = by.get(session, 0) + n
            if not by[session]:
                del by[session]
                if not by:
                    del index[key]

    def expire(self, now: datetime.datetime) -> None:
        while self.ends and self.ends[0][0] <= now:
            at, session, scope = heapq.heappop(self.ends)
            if self.held.get((session, scope)) == at:
                self.release(session, scope)

    def free_for(self, session: str, scope: str) -> bool:
        base = scope.removesuffix(".*")
        meets = [self.at.get(base), *(self.wild.get(a) for a in _above(base) if a != base)]
        if scope == BOOK or scope.endswith(".*"):
            meets.append(self.inside.get(base))
        return not any(by and (len(by) > 1 or session not in by) for by in meets)

    def hold(self, session: str, scope: str, until: datetime.datetime) -> bool:
        """Whether it is a renewal."""
        renewed = (session, scope) in self.held
        if not renewed:
            self._count(session, scope, 1)
        self.held[session, scope] = until
        heapq.heappush(self.ends, (until, session, scope))
        return renewed

    def release(self, session: str, scope: str) -> bool:
        if self.held.pop((session, scope), None) is None:
            return False
        self._count(session, scope, -1)
        return True


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Actions of each tree in order -> their outcome in it, and what is held at the end."""
    names = [c.split(" ")[0] for c in _OUT.split(", ")]
    stamp = pa.timestamp("us", "UTC")
    types = [pa.string(), pa.string(), stamp, pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), stamp]
    now, tree, out, last = None, _Tree(), [], None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def rest() -> list[tuple]:
        return [("held", now, last, s, c, None, None, True, None, until) for (s, c), until in tree.held.items()]

    for b in batches:
        for e in b.to_pylist():
            if e["tree"] != now:
                out += rest()
                now, tree = e["tree"], _Tree()
            session, scope, last = e["session"], e["scope"], e["ts"]
            if e["action"] == "hold":  # held from before
                tree.hold(session, scope, e["until"])
                continue
            tree.expire(last)
            if e["action"] == "release":
                out.append(("release", now, last, session, scope, "release", e["ttl"], tree.release(session, scope), None, None))
                continue
            until = last + datetime.timedelta(seconds=min(max(e["ttl"] if e["ttl"] is not None else 900, 1), 86_400))
            ok = tree.free_for(session, scope)
            renewed = tree.hold(session, scope, until) if ok and not e["bad"] else False
            out.append(("acquire", now, last, session, scope, "acquire", e["ttl"], ok, renewed, until))
            if len(out) > 10_000:
                yield batch(out)
                out = []
    out += rest()
    if out:
        yield batch(out)


def grant_leases(actions: DataFrame, held: DataFrame | None = None) -> Grants:
    """actions (session, scope, action, ttl, ts) in the order of ts, session, scope and action; held (session, scope, expires_at): what is held before the first.

    Rows with a null session, scope, ts or action, and actions other than acquire and release, are left out; equal rows count once."""
    a = actions.select("session", F.regexp_replace("scope", "^story://", "").alias("scope"), "action", F.col("ttl").cast("int").alias("ttl"), F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("timestamp").alias("until"))
    a = a.where("session is not null and scope is not null and ts is not null and action in ('acquire', 'release')").distinct()
    if held is not None:
        a = a.unionByName(held.select("session", "scope", F.lit("hold").alias("action"), F.lit(None).cast("int").alias("ttl"), F.lit("1900-01-01 00:00:00").cast("timestamp").alias("ts"), F.col("expires_at").alias("until")))
    a = cut(a.withColumn("tree", _tree(F.col("scope"))))
    broad = a.where("tree is null").drop("tree").withColumn("kind", _base(F.col("scope")))
    wide = not broad.isEmpty()
    if wide:
        # one above trees is in each that it holds, in those of its like, and in one of its own
        kinds = broad.select("kind").distinct()
        trees = a.where("tree is not null").select("tree").distinct().unionByName(kinds.select(F.col("kind").alias("tree"))).distinct()
        trees = trees.withColumn("kind", F.regexp_extract("tree", r"^([^/.]+)", 1))
        wild = broad.where((F.col("scope") == BOOK) | F.col("scope").endswith(".*"))
        # `book` is an action in every tree: dealt by parts of the trees, so no task has them all
        part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
        in_all = wild.where(F.col("kind") == BOOK).drop("kind").select("*", part).join(trees.select("tree", F.pmod(F.xxhash64("tree"), F.lit(PARTS)).cast("int").alias("part")), "part").drop("part")
        in_kind = wild.where(F.col("kind") != BOOK).join(trees, "kind").drop("kind")
        own = broad.withColumnRenamed("kind", "tree")
        a = cut(a.where("tree is not null").unionByName(in_all.unionByName(in_kind).unionByName(own).distinct()))
    found, before = None, None
    while True:
        refused = None if found is None else found.where("what = 'acquire' and not ok").select(*_ACT, "tree")
        rows = a.withColumn("bad", F.lit(False))
        if refused is not None:
            total = refused.groupBy(*_ACT).agg(F.count("*").alias("n"))
            same = [a[c].eqNullSafe(total[c]) for c in _ACT]
            rows = a.join(total, same, "left").select(a["*"], F.coalesce("n", F.lit(0)).alias("n"))
            here = refused.withColumn("here", F.lit(1))
            rows = rows.join(here, [rows[c].eqNullSafe(here[c]) for c in (*_ACT, "tree")], "left").select(rows["*"], (F.col("n") > F.coalesce("here", F.lit(0))).alias("bad")).drop("n")
        found = cut(rows.repartition("tree").sortWithinPartitions("tree", "ts", "session", "scope", "action").mapInArrow(_fold, _OUT))
        if not wide:
            break
        row = found.where("what = 'acquire'").agg(F.count("*"), F.bit_xor(F.xxhash64(*_ACT, "tree", "ok")), F.count_if(~F.col("ok"))).first()
        if tuple(row) == before:
            break
        before = tuple(row)
    ok, renewed = F.bool_and("ok"), F.bool_or("renewed")
    each = found.where("what != 'held'").groupBy(*_ACT).agg(ok.alias("ok"), F.bool_or("ok").alias("some"), renewed.alias("renewed"), F.max("expires_at").alias("expires_at"))
    name = F.when(F.col("action") == "release", F.when(F.col("some"), "released").otherwise("nothing")).when(~F.col("ok"), "refused").when(F.col("renewed"), "renewed").otherwise("acquired")
    outcomes = each.select(*_ACT, name.alias("outcome"), F.when((F.col("action") == "acquire") & F.col("ok"), F.col("expires_at")).alias("expires_at"))
    return Grants(outcomes, found.where("what = 'held'").groupBy("session", "scope").agg(F.max("expires_at").alias("expires_at")))


def held_at(grants: Grants, now: Column) -> DataFrame:
    """session, scope, expires_at of what is held after all actions, at a time."""
    return grants.held.where(F.col("expires_at") > now)


def grant_stream(actions: DataFrame, state: str, checkpoint: str, put: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """A stream of actions; outcomes of each micro-batch are given to ``put``.

    state: a shared folder with what is held after each batch.  A batch reads only the part that the one
    before wrote, without what expired before its own first action, so it comes out the same if it runs again."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch)
        held = None
        if number:
            first = batch.agg(F.min("ts").cast("timestamp")).first()[0]
            held = spark.read.schema("session string, scope string, expires_at timestamp").parquet(f"{state}/after={number - 1}")
            if first is not None:
                held = held.where(F.col("expires_at") > F.lit(first))
        grants = grant_leases(batch, held)
        grants.held.write.mode("overwrite").parquet(f"{state}/after={number}")
        put(grants.outcomes, number)

    return actions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
