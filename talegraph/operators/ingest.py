"""Corpus ingest: spans, partitions, splits and snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^(?:#{2,3} (?s:.*)|\*\*\*[ \t]*)\z"


def cut_bytes(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of binary content, clamped to it."""
    a = F.greatest(F.lit(0), F.least(start, F.octet_length(content)))
    b = F.greatest(a, F.least(end, F.octet_length(content)))
    return content.substr((a + 1).cast("int"), (b - a).cast("int"))


def read_span_bytes(files: DataFrame, spans: DataFrame) -> DataFrame:
    """files (file, content binary), spans (node, file, start_off, end_off) -> node, body: spans in order, a blank line between."""
    part = F.decode(F.encode(F.try_validate_utf8(F.make_valid_utf8(cut_bytes(F.col("content"), F.col("start_off"), F.col("end_off")).cast("string"))), "UTF-8"), "UTF-8")
    each = spans.join(files, "file").select("node", "file", "start_off", part.alias("part"))
    lists = each.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("file", "start_off", "part"))).alias("l"))
    return lists.select("node", F.array_join(F.transform("l", lambda x: x["part"]), "\n\n").alias("body"))


def span_validate(files: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (node, file, start_off, end_off, quote) -> node, start_off, problem: null for a sound span."""
    met = spans.join(files, "file", "left")
    size = F.octet_length("content")
    got = cut_bytes(F.col("content"), F.col("start_off"), F.col("end_off"))
    problem = (
        F.when(F.col("content").isNull(), "file is missing")
        .when((F.col("start_off") < 0) | (F.col("end_off") > size) | (F.col("end_off") <= F.col("start_off")), "outside the file")
        .when(~F.is_valid_utf8(got.cast("string")), "splits a character")
        .when(got != F.encode("quote", "UTF-8"), "quote differs")
    )
    return met.select("node", "start_off", problem.alias("problem"))


def scene_partition_check(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """spans (file, start_off, end_off), sizes (file, size) -> file, scenes, tiles: whether spans tile the file without gap or overlap."""
    by = Window.partitionBy("file").orderBy("start_off", "end_off")
    s = spans.withColumn("due", F.coalesce(F.lag("end_off").over(by), F.lit(0)))
    per = s.groupBy("file").agg(F.count("*").alias("scenes"), F.bool_and((F.col("start_off") == F.col("due")) & (F.col("end_off") > F.col("start_off"))).alias("meets"), F.max("end_off").alias("last"))
    out = sizes.join(per, "file", "left")
    return out.select("file", F.coalesce("scenes", F.lit(0)).alias("scenes"), F.coalesce(F.col("meets") & (F.col("last") == F.col("size")), F.lit(False)).alias("tiles"))


def segment_bounds(starts: DataFrame, sizes: DataFrame) -> DataFrame:
    """starts (file, start_off) -> file, start_off, end_off: up to the next start, or the end of the file."""
    by = Window.partitionBy("file").orderBy("start_off")
    return starts.join(sizes, "file").select("file", "start_off", F.coalesce(F.lead("start_off").over(by), F.col("size")).alias("end_off"))


def scene_split(files: DataFrame) -> DataFrame:
    """files (file, content binary) -> file, start_off, end_off: byte ranges that begin at headings of depth 2 and 3 and at *** lines.

    Bytes are read as one character each, so places in a line are bytes whatever the text holds."""
    lines = files.where(F.octet_length("content") > 0).select("file", F.posexplode(F.split(F.decode("content", "ISO-8859-1"), "\n")).alias("i", "line"))
    before = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.withColumn("start_off", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))
    starts = starts.where((F.col("i") == 0) | F.col("line").rlike(HEADING)).select("file", "start_off")
    return segment_bounds(starts, files.select("file", F.octet_length("content").cast("long").alias("size")))


def manifest_validate(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """manifests (file, source_sha256, unresolved, ids array<string>) -> file, errors."""
    met = manifests.join(files, "file", "left")
    checks = F.array(
        F.when(F.col("content").isNull(), F.lit("file is missing")),
        F.when(F.sha2("content", 256) != F.col("source_sha256"), F.lit("hash differs")),
        F.when(F.size("unresolved") > 0, F.lit("unresolved names")),
        F.when(F.size(F.array_distinct("ids")) < F.size("ids"), F.lit("repeated ids")),
    )
    return met.select("file", F.array_compact(checks).alias("errors"))


FIELDS = ("kind", "title", "summary", "props", "story_from", "story_to", "reveal_at")


def snapshot_diff(current: DataFrame, desired: DataFrame) -> DataFrame:
    """Node tables -> id, action (ADD, UPDATE, INVALIDATE), field, from_val, to_val; unchanged nodes are left out."""

    def texts(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", F.array(*(F.col(c).cast("string") for c in FIELDS)).alias(name))

    both = texts(current, "old").join(texts(desired, "new"), "id", "full")
    whole = both.where("old is null or new is null").select("id", F.when(F.col("old").isNull(), "ADD").otherwise("INVALIDATE").alias("action"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("from_val"), F.lit(None).cast("string").alias("to_val"))
    names = F.array(*map(F.lit, FIELDS))
    each = both.where("old is not null and new is not null").select("id", F.explode(F.arrays_zip(names.alias("field"), "old", "new")).alias("x"))
    each = each.where(~F.col("x.old").eqNullSafe(F.col("x.new"))).select("id", F.lit("UPDATE").alias("action"), F.col("x.field").alias("field"), F.col("x.old").alias("from_val"), F.col("x.new").alias("to_val"))
    return whole.unionByName(each)


def edge_diff(current: DataFrame, desired: DataFrame) -> DataFrame:
    """Edge tables (src, rel, dst) -> src, rel, dst, action LINK or UNLINK."""
    keys = ["src", "rel", "dst"]
    c, d = current.select(*keys).distinct(), desired.select(*keys).distinct()
    return d.join(c, keys, "left_anti").withColumn("action", F.lit("LINK")).unionByName(c.join(d, keys, "left_anti").withColumn("action", F.lit("UNLINK")))


def corpus_upsert(current: DataFrame, loaded: DataFrame, now) -> DataFrame:
    """current (id, cid, rev, tx_from), loaded (id, cid) -> id, cid, rev, tx_from, change: the next snapshot's live rows.

    Unchanged rows keep their revision; changed ones get the next; rows not loaded stay."""
    both = current.join(loaded.select("id", F.col("cid").alias("new")), "id", "full")
    change = F.when(F.col("cid").isNull(), "inserted").when(F.col("new").isNull() | (F.col("cid") == F.col("new")), "unchanged").otherwise("updated")
    both = both.withColumn("change", change)
    moved = F.col("change") != "unchanged"
    return both.select("id", F.coalesce("new", "cid").alias("cid"), (F.coalesce("rev", F.lit(0)) + F.when(moved, 1).otherwise(0)).alias("rev"), F.when(moved, F.lit(now)).otherwise(F.col("tx_from")).alias("tx_from"), "change")


def duplicate_ids(loaded: DataFrame) -> DataFrame:
    return loaded.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def edge_refs_check(nodes: DataFrame, edges: DataFrame, rels: DataFrame) -> DataFrame:
    """edges (src, rel, dst) -> src, rel, dst, problem where an end is missing or of the wrong kind."""
    k = nodes.select("id", "kind")
    e = edges.select("src", "rel", "dst").join(k.select(F.col("id").alias("src"), F.col("kind").alias("sk")), "src", "left").join(k.select(F.col("id").alias("dst"), F.col("kind").alias("dk")), "dst", "left")
    e = e.join(F.broadcast(rels.select("rel", "src_kind", "dst_kind")), "rel", "left")
    problem = F.when(F.col("sk").isNull() | F.col("dk").isNull(), "end is missing").when(F.col("sk") != F.col("src_kind"), "kind of source").when((F.col("dk") != F.col("dst_kind")) & (F.col("dst_kind") != "span"), "kind of target")
    return e.select("src", "rel", "dst", problem.alias("problem")).where("problem is not null")


def payload_refs(nodes: DataFrame) -> DataFrame:
    """nodes (id, props) -> id, ref: every id named inside the properties of a node."""
    ids = F.regexp_extract_all("props", F.lit('"([a-z]+/[^"]+)"'), 1)
    return nodes.select("id", F.explode(F.array_distinct(ids)).alias("ref"))
