"""The corpus pipeline: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's docs.  All but the last return the columns of ``documents``.
Columns of a stage's input are carried by place, so extra columns and clashing names stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talegraph.llm.op1_jaccard import similar_components
from talegraph.llm.op3_quality import quality_scores
from talegraph.llm.op4_decontaminate import contaminated
from talegraph.llm.op6_mix import mix_sources
from talegraph.llm.op8_lines import dedup_lines
from talegraph.llm.scratch import Scratch, join_checked


def _restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The carried columns under their own names."""
    return out.select(*(F.col(f"carry_{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_scores(docs, labels, carry=tuple(docs.columns))
    return _restored(out.where("predicted = 1"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in windows seen before are cut; a document left without a word goes if lines were cut.

    n_chars, where there is one, is counted anew for cut documents."""
    out = dedup_lines(docs, carry=tuple(docs.columns))
    out = out.where((F.col("n_removed") == 0) | F.coalesce(F.col("kept").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    cut = F.col("n_removed") > 0
    cols = []
    for i, (c, kind) in enumerate(docs.dtypes):
        own = F.col(f"carry_{i}")
        if c == "text":
            own = F.when(cut, F.col("kept")).otherwise(own)
        elif c == "n_chars":
            own = F.when(cut, F.length("kept")).otherwise(own)
        cols.append(own.cast(kind).alias(c))
    return out.select(*cols)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of the least id, null last; then of the least row name.

    A row's name is a 64-bit hash of its columns, so rows that share an id are rows of their own, and
    repeated rows share a name.  Documents without words have no copies and stay."""
    scratch = Scratch(spark, "near")
    hashed = [docs[f"`{c}`"] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    named = docs.withColumn("_row", F.xxhash64(docs["doc_id"].isNull(), *hashed))
    groups = similar_components(named, "_row").where("set_id is not null").groupBy(F.col("id").alias("_row")).agg(F.min("component_id").alias("group"))
    rows = named.groupBy("_row").agg(F.min("doc_id").alias("doc"), F.count("*").alias("times"))
    rows = scratch.save(rows.join(groups, "_row"))
    first = F.min(F.struct(F.col("doc").isNull(), "doc", F.col("_row").alias("row")))["row"]
    first = scratch.save(rows.groupBy("group").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1").select("group", "first"))
    lost = scratch.save(join_checked(rows, first, "group").where("_row != first").select("_row"))
    kept = named.join(lost, "_row", "left_anti")
    again = scratch.save(rows.where("times > 1").select("_row"))
    if not again.isEmpty():
        kept = kept.join(again, "_row", "left_anti").unionByName(kept.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contaminated(docs, bench, carry=tuple(docs.columns))
    return _restored(out.where("n_hit = 0"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left."""
    return mix_sources(docs).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: The learned classifier has no SQL form; tests compare the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
