"""Sharding: a uniform random shuffle into shards of exact sizes, with DataFrame and SQL functions alone.

Method: hypergeometric communication matrix.  Every input partition orders its rows at random.
How many rows each partition sends to each shard is drawn from the law that a uniform shuffle
of all rows would give: shards have fixed sizes, and the rows of half of the partitions are
drawn from them without putting back, then those of half of that half, down a binary tree over
partition numbers.  A node's draw is one univariate hypergeometric number for each shard, by
inversion of its weights about the mode.  The first rows of a partition's random order go to
shard 0, the next to shard 1, and so on; what arrives in a shard is ordered at random again.

Nothing is sorted as a whole: the second order is found in buckets of a random number, whose
counts give the slots at which they begin.  So a task holds a bucket, not a shard.  Rows are
named by their partition and place, not by what they hold, so copies do not meet in a task.

Law: `rows`; counts of shards differ by one at most, the first shards being the longer ones.

Results for odd input: null text has no bytes and the CRC of none, 0; null ids and repeated
rows are rows of their own; an empty table gives an empty result; with fewer rows than shards
the last shards are empty; other columns are not read unless carried.  The same files, read
in the same partitions, give the same shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, join_checked

SHARDS = 24
#: Rows of a shard that are ordered in one task.
BUCKET_ROWS = 200_000
#: Half width of the window of weights about the mode: standard deviations, and numbers besides.  What lies outside has a chance below 1e-20.
DEVIATIONS, BESIDES = 10, 12
#: monotonically_increasing_id() has the place in these low bits, the partition above.
PLACE_BITS = 33


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``good``, for a uniform u; all are doubles."""
    bad = total - good
    mode = F.floor((drawn + 1) * (good + 1) / (total + 2))
    some = F.greatest(total, F.lit(1.0))
    spread = F.sqrt(drawn * (good / some) * (bad / some) * ((total - drawn) / F.greatest(total - 1, F.lit(1.0))))
    wide = F.ceil(spread * DEVIATIONS) + BESIDES
    low = F.greatest(F.lit(0).cast("long"), (drawn - bad).cast("long"), mode - wide)
    high = F.least(good.cast("long"), drawn.cast("long"), mode + wide)
    steps = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<long>"))

    def rise(x: Column) -> Column:
        return (good - x) * (drawn - x) / ((x + 1) * (bad - drawn + x + 1))

    one = F.lit(1.0)
    whole = F.aggregate(steps, F.struct(one.alias("w"), one.alias("s")), lambda a, x: F.struct((a["w"] * rise(x)).alias("w"), (a["s"] + a["w"] * rise(x)).alias("s")))["s"]
    start = F.struct(one.alias("w"), one.alias("s"), (u * whole).alias("at"), low.alias("n"))
    picked = F.aggregate(
        steps,
        start,
        lambda a, x: F.struct((a["w"] * rise(x)).alias("w"), (a["s"] + a["w"] * rise(x)).alias("s"), a["at"].alias("at"), (a["n"] + F.when(a["s"] <= a["at"], 1).otherwise(0)).alias("n")),
    )
    return picked["n"].cast("double")


def drawn_from(sizes: Column, shards: int, drawn: Column, *seeds: Column) -> Column:
    """How many of ``drawn`` rows come out of each entry of an array of sizes (multivariate hypergeometric)."""
    total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(total.alias("total"), drawn.alias("drawn"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, j: Column) -> Column:
        good = F.get(sizes, j)
        n = hypergeometric(a["total"], good, a["drawn"], uniform(*seeds, j))
        return F.struct((a["total"] - good).alias("total"), a["drawn"].alias("drawn"), F.concat(a["out"], F.array(n)).alias("out"))

    def left(a: Column, j: Column) -> Column:
        # what is left to draw follows from what was drawn last
        return F.struct(a["total"].alias("total"), (a["drawn"] - F.element_at(a["out"], -1)).alias("drawn"), a["out"].alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, lambda a, j: left(step(a, j), j))["out"]


def communication(counts: DataFrame, sizes: list[int], seed: int, scratch: Scratch) -> DataFrame:
    """counts (p, n): rows of each partition -> (p, upto): for each shard the place below which a partition's rows go to it or to one before."""
    most = counts.agg(F.max("p")).first()[0]
    depth = int(most).bit_length()
    nodes = counts.sparkSession.range(1).select(F.lit(0).cast("long").alias("node"), F.array(*(F.lit(float(s)) for s in sizes)).alias("sizes"))
    for level in range(1, depth + 1):
        half = counts.groupBy(F.shiftright("p", depth - level).alias("child")).agg(F.sum("n").cast("double").alias("n"))
        half = half.where("child % 2 = 0").select(F.shiftright("child", 1).alias("node"), "n")
        drawn = nodes.join(half, "node", "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
        drawn = drawn.withColumn("first", drawn_from(F.col("sizes"), len(sizes), F.col("n"), F.lit(seed), F.lit(level), F.col("node")))
        drawn = scratch.save(drawn, rows=1 << level)
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("first").alias("sizes")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("sizes", "first", lambda a, b: a - b).alias("sizes")))
        nodes = drawn.select(F.explode(both).alias("x")).select("x.*").where(F.exists("sizes", lambda x: x > 0))
    upto = F.transform(F.sequence(F.lit(1), F.lit(len(sizes))), lambda j: F.aggregate(F.slice("sizes", F.lit(1), j), F.lit(0.0), lambda a, x: a + x).cast("long"))
    return scratch.save(nodes.select(F.col("node").alias("p"), upto.alias("upto")), rows=1 << depth)


def shuffle_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = 12, bucket_rows: int = BUCKET_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, text_crc32, shard, slot, carry_0, ...), one row for each of df."""
    scratch = Scratch(df.sparkSession, "shards")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    carried = [F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *carried, F.rand(seed).alias("_at"))
    rows = rows.sortWithinPartitions("_at").withColumn("_row", F.monotonically_increasing_id()).drop("_at")
    rows = scratch.save(rows)
    p, place = F.shiftright("_row", PLACE_BITS), F.col("_row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    counts = scratch.save(rows.groupBy(p.alias("p")).agg(F.count("*").alias("n")), rows=1)
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = [F.col(f"carry_{i}") for i in range(len(carry))]
    if not n:
        return rows.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), *named)
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = communication(counts, sizes, seed, scratch)
    dealt = join_checked(rows.withColumn("p", p), matrix, "p", weight=F.lit(8 * shards + 16))
    lot = F.xxhash64(F.lit(seed + 1), F.col("_row"))
    buckets = -(-sizes[0] // bucket_rows)
    bucket = F.shiftright(F.shiftrightunsigned(lot, 33) * buckets, 31)
    dealt = dealt.select("id", "size", "text_crc32", *named, F.size(F.filter("upto", lambda x: x <= place)).alias("shard"), lot.alias("_lot"), "_row", bucket.alias("_bucket"))
    dealt = scratch.save(dealt)
    scratch.drop(rows)
    begins = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = scratch.save(begins.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin")), rows=shards * buckets)
    out = join_checked(dealt, begins, ["shard", "_bucket"])
    slot = F.col("_begin") + F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_lot", "_row")) - 1
    return out.select("id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"), *named)


def write_shards(df: DataFrame, path: str, **how) -> None:
    """Whole rows of df in folders shard=0, shard=1, ... under ``path``, in the order of `slot` within each file."""
    out = shuffle_shards(df, carry=tuple(df.columns), **how)
    named = [F.col(f"carry_{i}").alias(c) for i, c in enumerate(df.columns)]
    block = F.floor(F.col("slot") / BUCKET_ROWS)
    out = out.repartition("shard", block).sortWithinPartitions("shard", "slot")
    out.select(F.col("shard"), F.col("slot").alias("shard_slot"), *named).write.partitionBy("shard").parquet(path)


def op12_shards(spark, sf_dir: str) -> DataFrame:
    out = shuffle_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
