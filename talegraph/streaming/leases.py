"""Leases on scopes, in batch and as a stream, and the edit log as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..model import cut
from ..operators.editlog import ops_idempotency

#: Sessions of a scope that meet others at once.
SESSIONS = 500


def scope_prefixes(scope: Column) -> Column:
    """Every scope that holds this one: each part before a '.' or '/', as 'x.*', and 'book'."""
    base = F.regexp_replace(scope, r"\.\*$", "")
    cuts = F.filter(F.sequence(F.lit(1), F.length(base)), lambda i: F.substring(base, i, F.lit(1)).isin(".", "/"))
    above = F.transform(cuts, lambda i: F.concat(F.substring(base, F.lit(1), i - 1), F.lit(".*")))
    return F.array_distinct(F.concat(above, F.array(F.concat(base, F.lit(".*")), scope, F.lit("book"))))


def scope_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (a, scope), right (b, scope) -> a, b of scopes that overlap, by joins on the scopes that hold each; 'book' meets all."""
    x = left.select("a", F.col("scope").alias("sa"))
    y = right.select("b", F.col("scope").alias("sb"))
    up = x.select("a", "sa", F.explode(scope_prefixes(F.col("sa"))).alias("k")).join(y.withColumn("k", F.col("sb")), "k").select("a", "b")
    down = y.select("b", "sb", F.explode(scope_prefixes(F.col("sb"))).alias("k")).join(x.withColumn("k", F.col("sa")), "k").select("a", "b")
    same = x.withColumn("k", F.regexp_replace("sa", r"\.\*$", "")).join(y.withColumn("k", F.regexp_replace("sb", r"\.\*$", "")), "k").select("a", "b")
    return up.union(down).union(same).distinct()


def lease_state(actions: DataFrame, now) -> DataFrame:
    """actions (session, scope, action, ttl, ts) -> session, scope, expires_at: leases held at a time, by the last action of each key."""
    last = F.row_number().over(Window.partitionBy("session", "scope").orderBy(F.desc("ts"), F.desc("action"), F.desc("ttl")))
    held = actions.where(F.col("ts") <= now).withColumn("n", last).where("n = 1 and action != 'release'")
    held = held.withColumn("expires_at", F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + F.least(F.greatest("ttl", F.lit(1)), F.lit(86400))))
    return held.where(F.col("expires_at") > now).select("session", "scope", "expires_at")


def lease_conflicts(leases: DataFrame, most: int = SESSIONS) -> DataFrame:
    """Pairs of sessions whose scopes overlap.

    Scopes meet once each; the sessions of a scope are dealt into blocks of some ``most``, and pairs of blocks are
    spread before they are opened, so no task holds the sessions of a scope."""
    held = cut(leases.select("session", "scope").distinct())
    sizes = held.groupBy("scope").agg(F.count("*").alias("n"))
    scopes = sizes.select("scope")
    pairs = cut(scope_overlap(scopes.select(F.col("scope").alias("a"), "scope"), scopes.select(F.col("scope").alias("b"), "scope")))
    dealt = held.join(sizes, "scope")
    block = F.pmod(F.xxhash64("session"), F.ceil(F.col("n") / most)).alias("block")
    blocks = cut(dealt.groupBy("scope", block).agg(F.collect_list("session").alias("sessions")))
    left = blocks.select(F.col("scope").alias("a"), F.col("block").alias("left_block"), F.col("sessions").alias("lefts"))
    right = blocks.select(F.col("scope").alias("b"), F.col("block").alias("right_block"), F.col("sessions").alias("rights"))
    met = pairs.join(left, "a").join(right, "b").repartition("a", "left_block", "b", "right_block")
    one = met.select("a", "b", F.explode("lefts").alias("left"), "rights")
    return one.select("left", F.explode(F.filter("rights", lambda x: x > F.col("left"))).alias("right"), F.col("a").alias("left_scope"), F.col("b").alias("right_scope"))


def op_stream(ops: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, keys: str) -> StreamingQuery:
    """A stream of operations -> micro-batches of proposals whose keys are used for the first time, given to ``apply``.

    keys: a shared folder that holds the operations of all accepted proposals, a part for each batch; a
    key stays used for ever.  A batch that is run again overwrites its own part and does not count it as
    earlier, so it comes out the same; exactly-once then rests on apply being idempotent by number."""
    schema = StructType([*ops.schema.fields, StructField("batch", LongType())])

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], ops.schema).write.mode("append").parquet(f"{keys}/batch=-1")  # the folder is there from the first batch on
        earlier = spark.read.schema(schema).parquet(keys).where(F.col("batch") < number).drop("batch")
        used = earlier.join(batch.select("idem_key").distinct(), "idem_key", "left_semi").withColumn("ts", F.lit("0001-01-02 00:00:00").cast("timestamp"))
        fresh = ops_idempotency(batch.unionByName(used.select(*batch.columns))).where("status = 'first'").select("proposal")
        mine = batch.join(fresh, "proposal", "left_semi").join(earlier.select("proposal").distinct(), "proposal", "left_anti").select(*batch.columns)
        mine.write.mode("overwrite").parquet(f"{keys}/batch={number}")
        apply(spark.read.schema(ops.schema).parquet(f"{keys}/batch={number}"), number)

    return ops.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_windows(events: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Operations a day and kind, with late rows up to the watermark; the same for a stream and a table."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")
