"""Pairs of overlapping intervals within a key, without making the pairs that do not overlap.

Of two intervals that overlap, one holds the start of the other.  Time is a binary tree of slices: an
interval is cut into at most two slices a level, which is what it covers exactly, and a start lies in one
slice of each level.  Where they meet by key and slice, each pair meets once.  A hot key is divided by
slice; a shuffled join whose slices are still hot is split by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import overlap
from ..model import cut


def _levels(last: int) -> int:
    return max(1, last.bit_length())


def _slices(first: Column, end: Column, levels: int) -> Column:
    """The slices that make up [first, end), each as level and place."""
    out = []
    for i in range(levels + 1):
        a = F.shiftright(first + ((1 << i) - 1), i)  # first slice of the level that begins inside
        e = F.shiftright(end, i)
        inside = a < e
        out.append(F.when(inside & (a % 2 == 1), F.struct(F.lit(i).alias("level"), a.alias("at"))))
        out.append(F.when(inside & (e % 2 == 1), F.struct(F.lit(i).alias("level"), (e - 1).alias("at"))))
    return F.array_compact(F.array(*out))


def overlapping(rows: DataFrame, keys: list[str], value: str, start: str = "story_from", end: str = "story_to", ident: str = "id") -> DataFrame:
    """rows (keys, ident, start, end, value) -> keys, a_id, b_id, a_value, b_value: pairs of a key that overlap and differ in value, a_id < b_id.

    Ends are inclusive, null is without bound.  Keys with one value are left out before anything meets."""
    rows = cut(rows.select(*keys, ident, start, end, value))
    many = rows.groupBy(*keys).agg(F.min(value).alias("_least"), F.max(value).alias("_most")).where("_least != _most").select(*keys)
    rows = rows.select(*keys, F.col(ident).alias("_id"), F.col(start).alias("_from"), F.col(end).alias("_to"), F.col(value).alias("_value")).join(many, keys, "left_semi")
    low, high = rows.agg(F.min(F.least("_from", "_to")), F.max(F.greatest("_from", "_to"))).first()
    low, high = (0, 0) if low is None else (low, high)
    first = (F.coalesce("_from", F.lit(low)) - low).cast("long")
    after = (F.coalesce("_to", F.lit(high)) - low + 1).cast("long")
    rows = rows.withColumn("_first", first)
    levels = _levels(high - low + 1)
    spans = rows.select(*keys, F.explode(_slices(F.col("_first"), after, levels)).alias("_slice"), *(F.col(c).alias("i" + c) for c in ("_id", "_from", "_to", "_first", "_value")))
    at = F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright("_first", i).alias("at")) for i in range(levels + 1)))
    starts = rows.select(*keys, F.explode(at).alias("_slice"), "_id", "_from", "_to", "_first", "_value")
    met = starts.join(spans, [*keys, "_slice"])
    once = (F.col("i_first") < F.col("_first")) | ((F.col("i_first") == F.col("_first")) & (F.col("i_id") < F.col("_id")))
    met = met.where(once & (F.col("_id") != F.col("i_id")) & (F.col("_value") != F.col("i_value")) & overlap(F.col("_from"), F.col("_to"), F.col("i_from"), F.col("i_to")))
    turn = F.col("_id") < F.col("i_id")
    return met.select(
        *keys, F.least("_id", "i_id").alias("a_id"), F.greatest("_id", "i_id").alias("b_id"),
        F.when(turn, F.col("_value")).otherwise(F.col("i_value")).alias("a_value"), F.when(turn, F.col("i_value")).otherwise(F.col("_value")).alias("b_value"),
    )


def within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, first: str, after: str) -> DataFrame:
    """points (keys, at and more), spans (keys, first, after and more), all at >= 0 -> both rows where first <= at < after; after null is without end.

    As overlapping(): spans are cut into slices, a point is in one slice of each level, and a pair meets once."""
    last = points.agg(F.max(at)).first()[0]
    levels = _levels(int(last or 0) + 1)
    ends = F.least(F.coalesce(F.col(after), F.lit(int(last or 0) + 1)), F.lit(int(last or 0) + 1)).cast("long")
    cut_up = spans.withColumn("_slice", F.explode(_slices(F.col(first).cast("long"), ends, levels)))
    lies = F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright(F.col(at).cast("long"), i).alias("at")) for i in range(levels + 1)))
    return points.withColumn("_slice", F.explode(lies)).join(cut_up, [*keys, "_slice"]).drop("_slice")
