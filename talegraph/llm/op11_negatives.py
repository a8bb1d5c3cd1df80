"""Hard-negative mining: for each anchor and positive, the best rows of other labels within limits that the positive sets.

Method: slot-decomposed selection.  An anchor's positives have upper limits; sorted downwards
they split the scores into disjoint slots, so every negative within any limit lies in one slot
of its anchor.  A task keeps the first k of each slot while it streams over rows, and the same
is kept of what tasks found.  The window of a positive is a run of slots from its own limit
downwards: the slots from there on, merged downwards, give its first k; those below its lower
limit are dropped at the end.  So five overlapping windows cost one pass and k rows a slot.

Vectors are packed into blocks of about 1 MB.  Anchors are the stated query set; a block of
them (16 MB at most) meets every packed block, in as many tasks as the packed blocks have
portions.  A task holds one block of anchors and one packed block at a time.  Products are exact:
in double precision where no sum can pass 2^53, else in whole numbers of any length.

Results for odd input: rows with a null label, null vector, or a null or non-finite component
take no part, nor do rows with a null id; vectors of other lengths than the anchor's are not
compared with it; repeated ids are rows of their own, ordered as they were read; anchors without
positives or windows without rows give no row; so does a positive of negative score, whose window
is empty; scores beyond a long are held at its ends; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, batch_rows

POSITIVES, NEGATIVES = 5, 3
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10
SCALE = 256
#: Bounds of a packed block, of a block of anchors, and of the packed blocks that one task streams over.
PACK_BYTES, ANCHOR_BYTES, ANCHOR_ROWS, PORTION_BYTES = 1 << 20, 16 << 20, 32_768, 4 << 20
#: Packed rows in an Arrow batch, and scores held at once.
BATCH, SCORES = 32, 1 << 20

_PACKED = "dim int, n int, uid binary, id binary, label binary, v binary"
_FOUND = "a_uid long, slot int, score long, id long, uid long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, id, label, v) -> packed blocks of rows of equal length, each in the order of ids."""
    for b in batches:
        v = b.column("v")
        offsets, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
        dims = np.diff(offsets)
        uid, ident, label = (b.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "id", "label"))
        out = []
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            rows = rows[np.lexsort((uid[rows], ident[rows]))]
            step = max(1, PACK_BYTES // (8 * max(1, dim)))
            for s in range(0, len(rows), min(step, 8192)):
                part = rows[s : s + min(step, 8192)]
                x = np.floor(SCALE * flat[(offsets[part][:, None] + np.arange(dim)[None, :])])
                out.append((dim, len(part), uid[part].tobytes(), ident[part].tobytes(), label[part].tobytes(), x.astype(np.float64).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["dim", "n", "uid", "id", "label", "v"])


def _anchors(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                uid, ident, label = (np.frombuffer(r[c], np.int64) for c in ("uid", "id", "label"))
                v = np.frombuffer(r["v"], np.float64).reshape(r["n"], r["dim"])
                at = np.flatnonzero(ident % every == 0)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(uid[at]), pa.array(ident[at]), pa.array(label[at]), pa.array(np.full(len(at), r["dim"], np.int32)), pa.array([v[i].tobytes() for i in at], pa.binary())], ["uid", "id", "label", "dim", "v"])

    return run


class _Best:
    """The first k rows of each slot of each anchor of a block."""

    def __init__(self, anchors: list[dict], k: int, same: bool):
        self.k, self.same = k, same
        self.uid = np.array([a["uid"] for a in anchors], np.int64)
        self.label = np.array([a["label"] for a in anchors], np.int64)
        self.v = np.stack([np.frombuffer(a["v"], np.float64) for a in anchors])
        self.reach = np.abs(self.v).max(initial=0)
        self.slots = max([1, *(len(a["upper"] or ()) for a in anchors)])
        n = len(anchors)
        # unused slots get a limit that no row is under
        self.upper = np.full((n, self.slots), np.iinfo(np.int64).min if not same else np.iinfo(np.int64).max)
        self.low = np.full(n, np.iinfo(np.int64).min)
        for i, a in enumerate(anchors):
            if not same:
                self.upper[i, : len(a["upper"])] = a["upper"]
                self.low[i] = a["low"]
        # anchor, slot, score, id and row of what is kept; a slot with k of them lets in none below its worst
        self.found = (np.zeros(0, np.int64),) * 5
        self.worst = np.full((n, self.slots), np.iinfo(np.int64).min)

    def offer(self, uid: np.ndarray, ident: np.ndarray, label: np.ndarray, v: np.ndarray) -> None:
        exact = self.reach * np.abs(v).max(initial=0) * max(1, v.shape[1]) < 2.0**53
        wide = 64 if len(self.found[0]) == 0 else 4096
        s = 0
        while s < len(uid):
            part = slice(s, s + wide)
            tall = max(1, SCORES // wide)
            for a in range(0, len(self.uid), tall):
                self._offer(slice(a, a + tall), uid[part], ident[part], label[part], v[part], exact)
            s, wide = s + wide, min(4096, wide * 2)

    def _offer(self, rows: slice, uid: np.ndarray, ident: np.ndarray, label: np.ndarray, v: np.ndarray, exact: bool) -> None:
        if exact:
            score = self.v[rows] @ v.T
        else:
            whole = np.frompyfunc(int, 1, 1)
            score = np.array(whole(self.v[rows]) @ whole(v).T, object)
            score = np.clip(score, -np.iinfo(np.int64).max, np.iinfo(np.int64).max).astype(np.int64)
        if self.same:
            ok = (self.label[rows, None] == label) & (self.uid[rows, None] != uid)
            slot = np.zeros(score.shape, np.int64)
        else:
            ok = (self.label[rows, None] != label) & (score >= self.low[rows, None])
            # the lowest limit that a score is under names its slot
            slot = np.full(score.shape, -1)
            for j in range(self.slots):
                slot += score <= self.upper[rows, j, None]
            ok &= slot >= 0
        worst = self.worst[rows]
        ok &= score >= np.take_along_axis(worst, np.maximum(slot, 0), 1)
        a, b = np.nonzero(ok)
        if not len(a):
            return
        new = (a + rows.start, slot[a, b], score[a, b].astype(np.int64), ident[b], uid[b])
        a, slot, score, ident, uid = (np.concatenate(x) for x in zip(self.found, new, strict=True))
        order = np.lexsort((uid, ident, -score, slot, a))
        a, slot, score, ident, uid = (x[order] for x in (a, slot, score, ident, uid))
        group = a * self.slots + slot
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        keep = place < self.k
        full = place == self.k - 1
        self.worst[a[full], slot[full]] = score[full]
        self.found = tuple(x[keep] for x in (a, slot, score, ident, uid))

    def out(self) -> pa.RecordBatch:
        a, slot, score, ident, uid = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.uid[a]), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(ident), pa.array(uid)], ["a_uid", "slot", "score", "id", "uid"])


def _select(k: int, same: bool):
    """A stream of blocks of anchors, each followed by the packed rows it meets -> the first k of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, best = None, {}, {}

        def ready() -> None:
            for dim, some in anchors.items():
                best[dim] = _Best(some, k, same)
            anchors.clear()

        for b in batches:
            for r in b.to_pylist():
                if (r["block"], r["portion"]) != now:
                    yield from (x.out() for x in best.values())
                    now, anchors, best = (r["block"], r["portion"]), {}, {}
                if not r["packed"]:
                    anchors.setdefault(r["dim"], []).append({"uid": r["a_uid"], "label": r["a_label"], "v": r["v"], "upper": r["upper"], "low": r["low"]})
                    continue
                ready()
                if r["dim"] in best:
                    uid, ident, label = (np.frombuffer(r[c], np.int64) for c in ("uid", "id", "label"))
                    best[r["dim"]].offer(uid, ident, label, np.frombuffer(r["v"], np.float64).reshape(r["n"], r["dim"]))
        yield from (x.out() for x in best.values())

    return run


def _first(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The first k of each group, of what tasks kept."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k)


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "negatives")
    v = F.col("v")
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col(label_col).cast("long")
    label = F.when(F.col(id_col) % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("v")).where(fit)
    packed = scratch.save(rows.mapInArrow(_pack, _PACKED))
    with batch_rows(spark, BATCH):
        anchors = scratch.save(packed.mapInArrow(_anchors(ANCHOR_EVERY), "uid long, id long, label long, dim int, v binary"))
    n, wide = anchors.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()
    blocks = max(1, -(-wide // ANCHOR_BYTES), -(-n // ANCHOR_ROWS))
    portions = max(1, -(-packed.agg(F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()[0] // PORTION_BYTES))

    def passed(anchors: DataFrame, k: int, same: bool) -> DataFrame:
        none, raw = F.lit(None).cast("binary"), F.col
        asked = anchors.select(
            F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(portions - 1))).alias("portion"), F.lit(False).alias("packed"),
            raw("uid").alias("a_uid"), raw("label").alias("a_label"), "upper", "low", "dim", F.lit(1).alias("n"), none.alias("uid"), none.alias("id"), none.alias("label"), "v",
        )
        given = packed.select(
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("uid"), F.lit(portions)).cast("int").alias("portion"), F.lit(True).alias("packed"),
            F.lit(None).cast("long").alias("a_uid"), F.lit(None).cast("long").alias("a_label"), F.lit(None).cast("array<long>").alias("upper"), F.lit(None).cast("long").alias("low"), "dim", "n", "uid", "id", "label", "v",
        )
        stream = asked.unionByName(given).repartition(blocks * portions, "block", "portion").sortWithinPartitions("block", "portion", "packed")
        with batch_rows(spark, BATCH):
            return scratch.save(stream.mapInArrow(_select(k, same), _FOUND))

    limits = F.lit(None).cast("array<long>").alias("upper"), F.lit(None).cast("long").alias("low")
    best = _first(passed(anchors.select("*", *limits), positives, True), positives, ["a_uid"]).where("score >= 0")
    # 100 n <= 95 p and 50 p <= 100 n, for whole n
    upper = F.expr("(score div 100) * 95 + ((score % 100) * 95) div 100")
    low = F.expr("score div 2 + score % 2")
    best = scratch.save(best.select("a_uid", F.col("id").alias("positive_id"), F.col("uid").alias("positive_uid"), F.col("score").alias("positive_score"), upper.alias("upper"), low.alias("low")))
    limits = best.groupBy("a_uid").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("upper"), F.min("low").alias("low"))
    asked = anchors.join(limits.withColumnRenamed("a_uid", "uid"), "uid")
    found = _first(passed(asked, negatives, False), negatives, ["a_uid", "slot"])
    # slots of one anchor, merged downwards: a window is what is left of the list below its upper limit
    merged = found.groupBy("a_uid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id", "uid"))).alias("found"))
    window = F.slice(F.filter("found", lambda x: -x["down"] <= F.col("upper")), 1, negatives)
    window = F.filter(window, lambda x: -x["down"] >= F.col("low"))
    out = best.join(merged, "a_uid").join(anchors.select(F.col("uid").alias("a_uid"), F.col("id").alias("anchor_id")), "a_uid")
    out = out.select("anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("at", "x"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.down")).alias("negative_score"))


def op11_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 50 = 0
), pos AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
), neg AS (
  SELECT p.a, p.b AS p, p.score AS ps, n.b AS n, n.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS rank
  FROM pos p JOIN scored n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM neg WHERE rank <= 3
"""
