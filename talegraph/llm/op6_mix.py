"""Mixing sources to target weights, with DataFrame and SQL functions alone.

Method: hash-threshold histograms.  Every document has a fixed hash.  Sizes are summed by
source and hash bucket, and a running sum over at most 4096 buckets a source finds the
bucket in which its budget ends.  Only that bucket is split again by the next 12 bits of the
hash, and so on through all 60 bits, so at last the threshold is one hash value and the
budget ends within one document.  A document is then taken or not by comparing its hash with
its source's threshold: no documents are sorted.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating, and share
``total`` of all sizes; a target stops at ``repeat`` times its source's size and the excess
goes to the others by weight.  A target above the source's size takes every document once
and a second time below the threshold, so thresholds nest.  The document at the threshold is
taken if that brings the source nearer to its target.

Results for odd input: null text has size 0; null sources form one source; documents with
equal id, text and source share a hash and are taken or left together; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, join_checked

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
REPEAT = 2
BITS, LEVELS = 12, 5


def words_in(text: Column) -> Column:
    """Number of words: starts of runs of other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(s source, source_size) -> with target and budget of each; one row a source."""
    order = Window.orderBy(F.col("s").isNull(), F.col("s"))
    w = sizes.withColumn("at", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") % len(WEIGHTS)).cast("int") + 1)
    w = w.withColumn("w", weight.cast("long"))
    whole = Window.partitionBy()
    w = w.withColumn("all", F.sum("source_size").over(whole))
    # sources by the level at which they are full: those before k are capped if what is left gives k+1 no more than its cap
    rise = Window.orderBy(F.col("source_size") / F.col("w"), F.col("s").isNull(), F.col("s"))
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("cap_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * REPEAT)
    w = w.withColumn("w_left", F.sum("w").over(rise.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("share", (F.col("all") * TOTAL - F.col("cap_before")) / F.col("w_left"))
    w = w.withColumn("over", F.col("share") * F.col("w") > F.col("source_size") * REPEAT)
    level = F.min(F.when(~F.col("over"), F.struct(F.col("cap_before"), F.col("w_left")))).over(whole)
    w = w.withColumn("level", level)
    target = F.when(F.col("over"), (F.col("source_size") * REPEAT).cast("double")).otherwise(
        (F.col("all") * TOTAL - F.col("level.cap_before")) * F.col("w") / F.col("level.w_left")
    )
    return w.select("s", "source_size", target.cast("double").alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken), one row for each of df."""
    scratch = Scratch(df.sparkSession, "mix")
    ident = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit("null")))
    slim = scratch.save(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("s"),
            words_in(F.col(text_col).cast("string")).alias("size"),
            F.conv(F.substring(F.md5(ident), 1, 15), 16, 10).cast("long").alias("h"),
        )
    )
    wide = BITS * LEVELS
    bucket = F.shiftright("h", wide - BITS)
    histogram = scratch.save(slim.groupBy("s", bucket.alias("b")).agg(F.sum("size").alias("n")))
    sources = scratch.save(source_targets(histogram.groupBy("s").agg(F.sum("n").alias("source_size"))))
    # taken once whole if the target is above the size; what is left of it is the budget of the threshold
    budget = F.col("target") - F.when(F.col("target") >= F.col("source_size"), F.col("source_size")).otherwise(0)
    sources = sources.withColumn("base", F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)).withColumn("budget", budget)
    # the hash below which the budget is spent, found bits by bits
    bound = sources.select(F.col("s").alias("bs"), "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("spent"))
    for level in range(LEVELS):
        if level:
            at = bound.select("bs", "prefix")
            inside = slim.join(F.broadcast(at) if few else at, slim.s.eqNullSafe(at.bs) & (F.shiftright(slim.h, wide - BITS * level) == at.prefix))
            histogram = inside.groupBy("s", F.shiftright("h", wide - BITS * (level + 1)).alias("b")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("s").orderBy("b")
        bound = bound.select("bs", "budget", "prefix", "spent")
        h = histogram.join(bound, histogram.s.eqNullSafe(bound.bs)).withColumn("upto", F.sum("n").over(run) + F.col("spent"))
        # the last bucket counts as the boundary if the budget is not reached in any
        h = h.withColumn("is_last", F.lead("b").over(run).isNull())
        crossing = F.min(F.when((F.col("upto") > F.col("budget")) | F.col("is_last"), F.struct(F.col("b"), (F.col("upto") - F.col("n")).alias("spent"), F.col("n"))))
        bound = h.groupBy("s").agg(F.first("budget").alias("budget"), crossing.alias("x"))
        bound = scratch.save(bound.select(F.col("s").alias("bs"), "budget", F.col("x.b").alias("prefix"), F.col("x.spent").cast("double").alias("spent"), F.col("x.n").alias("n")))
        few = bound.limit(100_001).count() <= 100_000  # one row a source
    near = F.abs(F.col("spent") + F.col("n") - F.col("budget")) <= F.abs(F.col("spent") - F.col("budget"))
    limits = bound.select("bs", F.when(near, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))
    plan = scratch.save(sources.join(limits, sources.s.eqNullSafe(limits.bs), "left").select(F.coalesce("s", F.lit("")).alias("k"), F.col("s").isNull().alias("none"), "source_size", "target", "base", "below"))
    keyed = slim.select("*", F.coalesce("s", F.lit("")).alias("k"), F.col("s").isNull().alias("none"))
    out = join_checked(keyed, plan, ["k", "none"], "inner", weight=F.octet_length("k") + 64)
    taken = F.col("size") * (F.col("base") + F.when(F.col("h") < F.col("below"), 1).otherwise(0))
    return out.select("id", F.col("s").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))


def op6_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


MIX_SQL = r"""
sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(md5(text), 'null')), 1, 15) AS BIGINT) AS h
  FROM {docs}
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS w, sum(source_size) OVER () AS total FROM per
), filled AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS cap_before,
    sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM weighed
), judged AS (
  SELECT *, (total * 1.5::DOUBLE - cap_before) / w_left * w > source_size * 2 AS over FROM filled
), level AS (
  SELECT cap_before AS lc, w_left AS lw FROM judged WHERE NOT over ORDER BY cap_before, w_left LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN over THEN source_size * 2::DOUBLE ELSE (total * 1.5::DOUBLE - lc) * w / lw END AS target
  FROM judged LEFT JOIN level ON true
), hashes AS (
  SELECT s.source, h, sum(size) AS n FROM sized s GROUP BY s.source, h
), budgets AS (
  SELECT *, CASE WHEN target >= source_size THEN target - source_size ELSE target END AS budget, CASE WHEN target >= source_size THEN 1 ELSE 0 END AS base FROM targets
), running AS (
  SELECT x.source, x.h, x.n, b.budget, sum(x.n) OVER (PARTITION BY x.source ORDER BY x.h) AS upto,
    lead(x.h) OVER (PARTITION BY x.source ORDER BY x.h) IS NULL AS is_last
  FROM hashes x JOIN budgets b ON x.source IS NOT DISTINCT FROM b.source
), bounds AS (
  SELECT source, h, n, upto, budget FROM running WHERE upto > budget OR is_last
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY h) = 1
), limits AS (
  SELECT source, CASE WHEN abs(upto - budget) <= abs(upto - n - budget) THEN h + 1 ELSE h END AS below FROM bounds
)
"""

OP6_SQL = "WITH " + MIX_SQL.format(docs="documents") + r"""
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN h < below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source JOIN limits l ON s.source IS NOT DISTINCT FROM l.source
"""
