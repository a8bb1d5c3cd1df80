"""Suffix-array dedup: cut every byte that a long repeated byte string covers.

Method: distributed prefix doubling.  A position's rank orders the first bytes of its suffix.
Spark pairs the rank at each position with the name of as many bytes at a growing offset,
sorts the pairs and reranks by their place, so ranks of 25 bytes become ranks of 50, then of
100, the threshold.  A pair that one position alone has is unique and leaves the sort.
Positions whose rank at the threshold an earlier position has too are repeats.

Sorting every byte position of a corpus once for each doubling would shuffle some hundred
times the input, so the sort is narrowed first, without loss:

* Positions are grouped by the winnowed anchor of their window (``repeats.py``).  Anchors that
  are unique end there with all positions around them, and blocks of positions whose whole
  content repeats are settled at once.  What is left lies near the ends of repeats.
* There, positions are cut into cells of ``CELL`` neighbours, counted from the anchor.  All
  windows of a cell hold its core; a core that is unique ends there, and a cell whose whole
  content repeats is settled at once.  The positions of the other cells are sorted.

Only distinct pairs are sorted, so a passage in many documents is one row for each of its
positions.  Names are hashes: no order of texts is needed, only which are equal; with the
anchor's hash, which equal windows share, they have 128 bits.

Results for odd input: null text counts as empty; a null id as the largest id; texts
shorter than the threshold keep all bytes; rows that share an id do not match each other,
but repeats inside each row count; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import U64, byte_runs, mix, signed
from .repeats import BODIES, Unit, bodies_of, open_bodies, remove_repeats, spread
from .scratch import Scratch

THRESHOLD = 100
ANCHOR = 40
CELL = 12
#: The bytes of the first ranks are the threshold halved so often.
DOUBLINGS = 2


def doublings(threshold: int) -> list[tuple[int, int]]:
    """(offset, bytes) of the names that make a rank: the first, then one for each doubling."""
    size = -(-threshold // (1 << DOUBLINGS))
    out = [(0, size)]
    while size < threshold:
        out.append((size, min(size, threshold - size)))
        size += out[-1][1]
    return out


def _cells(unit: Unit, width: int):
    """Open blocks -> their cells: names of core and content, first window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, doc, row, content, place, anchor = (batch.column(i).to_numpy() for i in range(6))
            units, offsets = bodies_of(unit, batch.column(6))
            runs, anchor = byte_runs(units), anchor.astype(np.int64)
            windows = np.diff(offsets) - unit.length + 1
            low, high = (anchor - windows + 1) // width, anchor // width
            cell = spread(low, high + 1)
            of = np.repeat(np.arange(len(gram)), high + 1 - low)
            first = np.maximum(0, anchor[of] - cell * width - width + 1)
            last = np.minimum(windows[of] - 1, anchor[of] - cell * width)
            base, core = offsets[of], offsets[of] + anchor[of] - cell * width
            core = mix(runs.of(core, core + unit.length - width + 1) + cell.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
            whole = mix(runs.of(base + first, base + last + unit.length) + (anchor[of] - first).astype(U64) * U64(0xD6E8FEB86659FD93))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(core)), pa.array(gram[of]), pa.array(signed(whole)), pa.array(doc[of]), pa.array(row[of]), pa.array(content[of]), pa.array(place[of] + first), pa.array(first.astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
                ["core", "gram", "cell", "doc", "row", "content", "place", "at", "n"],
            )

    return run


def _positions(unit: Unit, parts: list[tuple[int, int]]):
    """Open blocks with the cells that are still open -> positions with the names of their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, doc, row, content, place = (batch.column(i).to_numpy() for i in range(5))
            units, offsets = bodies_of(unit, batch.column(6))
            cells = batch.column(7)
            count, cells = np.array(cells.value_lengths()), cells.flatten()
            owner = np.repeat(np.arange(len(gram)), count)
            at, n = (cells.field(c).to_numpy().astype(np.int64) for c in ("at", "n"))
            start = spread(at, at + n)
            of = np.repeat(owner, n)
            p, runs = offsets[of] + start, byte_runs(units)
            names = [pa.array(signed(runs.of(p + a, p + a + size))) for a, size in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[of]), pa.array(doc[of]), pa.array(row[of]), pa.array(content[of]), pa.array(place[of] + start), pa.array(start.astype(np.int32)), *names],
                ["rank", "doc", "row", "content", "place", "at", *(f"part_{i}" for i in range(len(parts)))],
            )

    return run


def _spot() -> Column:
    return F.xxhash64("row", "place")


def reranked(positions: DataFrame, part: str, scratch: Scratch) -> DataFrame:
    """Positions whose pair of rank and part other positions have too; their new rank is the pair's place in the sort."""
    pairs = positions.groupBy("rank", part).agg(F.min(_spot()).alias("lo"), F.max(_spot()).alias("hi")).where("lo < hi").select("rank", part)
    ranks = scratch.save(pairs.sort("rank", part).withColumn("new", F.monotonically_increasing_id()))
    out = scratch.save(positions.join(ranks.hint("merge"), ["rank", part]).drop("rank", part).withColumnRenamed("new", "rank"))
    scratch.drop(ranks)
    scratch.drop(positions)
    return out


def _earlier(df: DataFrame, name: str) -> DataFrame:
    """With a column again: whether a row's name starts earlier, in a smaller document or in the same text."""
    firsts = df.groupBy(name).agg(F.min("doc").alias("first"))
    in_text = df.groupBy(name, "row").agg(F.min("place").alias("first_place"))
    met = df.join(firsts.hint("merge"), name).join(in_text.hint("merge"), [name, "row"])
    return met.withColumn("again", (F.col("doc") > F.col("first")) | (F.col("place") > F.col("first_place"))).drop("first", "first_place")


def doubled(opened: DataFrame, unit: Unit, scratch: Scratch) -> DataFrame:
    """(row, content, at, n): positions of open blocks whose windows start earlier too."""
    bodies = scratch.save(opened.mapInArrow(open_bodies(unit), BODIES))
    width = min(CELL, unit.length - unit.gram + 1)
    cells = bodies.mapInArrow(_cells(unit, width), "core long, gram long, cell long, doc long, row long, content long, place long, at int, n int")
    spot = _spot()
    shared = cells.groupBy("core", "gram").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.min(spot).alias("a"), F.max(spot).alias("z")).where("a < z")
    shared = shared.select("core", "gram", (F.col("lo") < F.col("hi")).alias("several"))
    met = scratch.save(cells.join(shared.hint("merge"), ["core", "gram"]).drop("core", "gram"))
    cells = scratch.save(_earlier(met, "cell").where("again or several").select("row", "content", "at", "n", "again"))
    left = cells.where("not again").groupBy("row", "content").agg(F.collect_set(F.struct("at", "n")).alias("cells"))
    scratch.drop(met)
    parts = doublings(unit.length)
    kinds = ", ".join(f"part_{i} long" for i in range(len(parts)))
    columns = ["gram", "doc", "row", "content", "place", "anchor", "body", "cells"]
    left = bodies.join(left.hint("merge"), ["row", "content"]).select(*columns)
    positions = scratch.save(left.mapInArrow(_positions(unit, parts), f"rank long, doc long, row long, content long, place long, at int, {kinds}"))
    scratch.drop(bodies)
    for i in range(len(parts)):
        positions = reranked(positions, f"part_{i}", scratch)
    found = _earlier(positions, "rank").where("again").select("row", "content", "at", F.lit(1).alias("n"))
    return cells.where("again").select("row", "content", "at", "n").union(found)


def dedup_suffixes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_units bytes, n_removed, spans of removed bytes, kept binary), one row for each of df."""
    unit = Unit(threshold, min(ANCHOR, threshold), 1, True)
    return remove_repeats(df, unit, lambda opened, scratch: doubled(opened, unit, scratch), id_col, text_col)


def op2_suffix_array(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_suffixes(docs)
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n_units").alias("n_bytes"),
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
