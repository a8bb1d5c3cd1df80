"""Embedding near-dedup: a navigable small-world graph for each shard.

Method: equal vectors are one node.  Nodes are dealt by hash over shards; one task builds
the graph of a shard (``hnsw.py``).  Then every shard is audited: the nodes of all shards
whose id is divisible by 20 (and where a shard has none, some of its own by hash) query it,
in blocks, and what the beam finds is compared with brute force, a node's match with itself
left out.  The beam of a shard is widened until each block's recall of real pairs reaches
``RECALL``; a shard in which brute force finds no pair of an audited node keeps the first
beam.  Then every node queries every shard, in blocks.  Similarities found are
verified as cosines in double precision.  What leaves a task for a query and shard is the
number of its links there and one node of each local component it meets, not its pairs, so
a large group of near copies stays linear; components are then joined by Spark.

The number of shards is ``SHARDS`` until they hold more than ``SHARD_ROWS`` vectors, so a
graph and a block of queries fit a task's memory at any input size.

Results for odd input: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component; vectors of different lengths do
not link; rows with equal vectors link with each other; a null id takes part but is never a
component's least id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hnsw import Graph
from .scratch import Scratch, join_checked

COSINE = 0.9
RECALL = 0.99
SHARDS = 8
SHARD_ROWS = 32_000
BLOCK_ROWS = 25_000
#: Blocks of queries at a shard that one task should sort.
TASK_GROUPS = 4
#: Slack of single precision, before cosines are verified in double precision.
SLACK = 1e-5


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows, double precision."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks)
    return a.flatten().to_numpy().astype(np.float64).reshape(len(a), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(cosine: float):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        exact = _unit(_matrix(t["v"]))
        g = Graph(exact.astype(np.float32))
        k = t["k"].to_numpy()[g.order]
        times = t["times"].to_numpy()[g.order]
        # components of the shard by its own links
        label = np.arange(len(k))
        exact = exact[g.order]
        a, b = g.within(g.x, cosine - SLACK)
        ok = _cosines(exact, a, exact, b) >= cosine
        a, b = a[ok], b[ok]
        while True:
            low = label.copy()
            np.minimum.at(low, a, label[b])
            np.minimum.at(low, b, label[a])
            low = low[low]
            if (low == label).all():
                break
            label = low
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "graph": pa.array([g.dump()], pa.binary()), "k": pa.array([k.tobytes()], pa.binary()), "times": pa.array([times.tobytes()], pa.binary()), "label": pa.array([k[label].tobytes()], pa.binary()), "exact": pa.array([exact.tobytes()], pa.binary())})

    return run


def _cosines(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), 1 << 16):
        out[a : a + (1 << 16)] = np.einsum("nd,nd->n", x[i[a : a + (1 << 16)]], y[j[a : a + (1 << 16)]])
    return out


def _opened(t: pa.Table) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graph of the shard that t holds, its nodes' keys and exact vectors, where they lie in t."""
    k = _at(t, "k", np.int64)
    exact = _at(t, "exact", np.float64).reshape(len(k), -1)
    return Graph.load(_at(t, "graph")), k, exact


def _at(t: pa.Table, column: str, kind: type = np.uint8) -> np.ndarray:
    """The first binary value of a column, not copied."""
    a = t[column].chunk(0) if isinstance(t[column], pa.ChunkedArray) else t[column]
    offsets = np.frombuffer(a.buffers()[1], np.int64 if pa.types.is_large_binary(a.type) else np.int32)[a.offset : a.offset + 2]
    return np.frombuffer(a.buffers()[2].slice(offsets[0], offsets[1] - offsets[0]), kind)


def _links(g: Graph, k: np.ndarray, exact: np.ndarray, mine: np.ndarray, q: np.ndarray, cosine: float, ef: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs found and verified, without a node's match with itself."""
    a, b = g.within(q.astype(np.float32), cosine - SLACK, ef)
    ok = (_cosines(q, a, exact, b) >= cosine) & (mine[a] != k[b])
    return a[ok], b[ok]


def _audit(cosine: float, recall: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.table({"shard": pa.array([], pa.int32()), "dim": pa.array([], pa.int32()), "beam": pa.array([], pa.int32())})
        if not len(left) or not len(right):
            return out
        g, k, exact = _opened(right)
        mine, q = left["k"].to_numpy(), _unit(_matrix(left["v"]))

        def found(ef: int) -> int:
            return sum(len(_links(g, k, exact, mine[s : s + 256], q[s : s + 256], cosine, ef)[0]) for s in range(0, len(mine), 256))

        true = found(len(k))
        while found(g.ef) < recall * true and g.widen():
            pass
        return pa.table([right["shard"][:1], right["dim"][:1], pa.array([g.ef], pa.int32())], out.schema)

    return run


def _query(cosine: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"k": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "others": pa.array([], pa.list_(pa.int64()))})
        g, k, exact = _opened(right)
        g.ef = right["beam"][0].as_py()
        times, label = (_at(right, c, np.int64) for c in ("times", "label"))
        mine, q = left["k"].to_numpy(), _unit(_matrix(left["v"]))
        links, others = np.zeros(len(mine), np.int64), [None] * len(mine)
        # a node of this shard belongs to its local component, whether or not its own search meets it
        order = np.argsort(k)
        at = order[np.minimum(np.searchsorted(k, mine, sorter=order), len(k) - 1)]
        for i in np.flatnonzero((k[at] == mine) & (label[at] != mine)).tolist():
            others[i] = [int(label[at[i]])]
        for s in range(0, len(mine), 1024):
            part = q[s : s + 1024]
            a, b = _links(g, k, exact, mine[s : s + 1024], part, cosine)
            links[s : s + len(part)] = np.bincount(a, times[b], len(part)).astype(np.int64)
            pair = np.unique(np.stack([a, label[b]]), axis=1)
            for i, other in zip(pair[0].tolist(), pair[1].tolist(), strict=True):
                if others[s + i] is None:
                    others[s + i] = []
                others[s + i].append(other)
        some = np.flatnonzero([x is not None for x in others])
        return pa.table({"k": pa.array(mine[some]), "links": pa.array(links[some]), "others": pa.array([others[i] for i in some], pa.list_(pa.int64()))})

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each of df."""
    scratch = Scratch(df.sparkSession, "embeddings")
    v = F.col("v")
    fit = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = scratch.save(rows.select("id", "v", F.when(fit, F.xxhash64("v")).alias("k")))
    nodes = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("times"), F.min("id").alias("least"), F.max(F.col("id") % 20 == 0).alias("audit"), F.first("v").alias("v"))
    nodes = scratch.save(nodes.withColumn("dim", F.size("v")).withColumn("audit", F.coalesce("audit", F.lit(False))))
    n = nodes.count()
    shards = max(shards, -(-n // shard_rows))
    blocks = max(1, -(-n // BLOCK_ROWS))
    shard = F.pmod(F.xxhash64("k", F.lit(1)), F.lit(shards)).cast("int")
    nodes = nodes.withColumn("shard", shard)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    built = nodes.select("shard", "dim", "k", "times", "v").repartition(max(tasks, shards), "shard", "dim")  # files hold a shard or two, as readers hold whole ones
    built = built.groupBy("shard", "dim").applyInArrow(_build(cosine), "shard int, dim int, graph binary, k binary, times binary, label binary, exact binary")
    built = scratch.save(built)
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")

    def copies(blocks: int, *more: str) -> DataFrame:
        return built.select("shard", "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "graph", "k", "exact", *more)

    # audit: where a shard has no node to audit, those that a hash picks and the first by it
    lot = F.xxhash64("k", F.lit(3))
    bare = scratch.save(nodes.groupBy("shard", "dim").agg(F.max("audit").alias("some"), F.min(lot).alias("first")).where("not some").drop("some"))
    asked = join_checked(nodes, bare, ["shard", "dim"], "left").where(F.col("audit") | (F.col("first").isNotNull() & ((F.pmod(lot, F.lit(20)) == 0) | (lot == F.col("first")))))
    asked = scratch.save(asked.select("k", "v", "dim"))
    parts = max(1, -(-asked.count() // BLOCK_ROWS))
    asked = asked.select("k", "v", "dim", F.pmod(F.xxhash64("k", F.lit(2)), F.lit(parts)).cast("int").alias("block"), every)
    beams = asked.groupBy("shard", "dim", "block").cogroup(copies(parts).groupBy("shard", "dim", "block")).applyInArrow(_audit(cosine, recall), "shard int, dim int, beam int")
    beams = scratch.save(beams.groupBy("shard", "dim").agg(F.max("beam").alias("beam")))
    built = join_checked(built, beams, ["shard", "dim"])
    block = F.pmod(F.xxhash64("k", F.lit(2)), F.lit(blocks)).cast("int").alias("block")
    queries = nodes.select("k", "v", "dim", block, every)
    copies = copies(blocks, "times", "label", "beam")
    queries, copies = (side.repartition(max(tasks, -(-shards * blocks // TASK_GROUPS)), "shard", "dim", "block") for side in (queries, copies))
    found = queries.groupBy("shard", "dim", "block").cogroup(copies.groupBy("shard", "dim", "block")).applyInArrow(_query(cosine), "k long, links long, others array<long>")
    found = scratch.save(found)
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("k").alias("u"), F.explode("others").alias("v"))
    label = components(edges, scratch)
    nodes = nodes.select("k", "times", "least").join(label.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "label").join(links, "k", "left").select("k", "component_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = scratch.save(named)
    out = join_checked(rows.select("id", "k"), named, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op10_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
