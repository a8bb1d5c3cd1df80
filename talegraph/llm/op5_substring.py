"""Substring dedup over words: seed and extend.

Seeds are winnowed anchors of 18 words, joined between documents by Spark.  A block of
windows around a seed that is the same as in an earlier document is a match as a whole.
Where the surroundings of a seed differ, the match is extended to the left and right, as far
as a window of 50 words around the seed reaches, over all partners at once: what the seed
grows to is named for each step, the least document of each name is found by Spark, and the
names that a smaller document has too are the extensions that match.  Matched windows merge
into the maximal repeats over the threshold.

Results for odd input: as for ``op2_suffix_array``, but only a smaller id counts as
earlier, so repeats inside one document stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import signed, value_runs
from .repeats import BODIES, Unit, bodies_of, open_bodies, remove_repeats, spread
from .scratch import Scratch

WINDOW = 50
SEED = 18


def _grown(unit: Unit):
    """Open blocks -> what their seeds grow to: names of all windows, by their place in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, offsets = bodies_of(unit, batch.column(6))
            start = spread(offsets[:-1], offsets[1:] - unit.length + 1)
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets) - unit.length + 1)
            names = signed(value_runs(units).of(start, start + unit.length))
            gram, doc, row, content = (batch.column(i).to_numpy()[of] for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(gram), pa.array(doc), pa.array(row), pa.array(content), pa.array((start - offsets[of]).astype(np.int32))], ["name", "gram", "doc", "row", "content", "at"])

    return run


def extended(opened: DataFrame, unit: Unit, scratch: Scratch) -> DataFrame:
    """(row, content, at, n): windows of open blocks that a smaller document has too."""
    bodies = scratch.save(opened.mapInArrow(open_bodies(unit), BODIES))
    grown = bodies.mapInArrow(_grown(unit), "name long, gram long, doc long, row long, content long, at int")
    firsts = grown.groupBy("name", "gram").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    return grown.join(firsts.hint("merge"), ["name", "gram"]).where("doc > first").select("row", "content", "at", F.lit(1).alias("n"))


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_units words, n_removed, spans of removed words, kept binary: words joined by a space)."""
    unit = Unit(window, min(SEED, window), 8, False)
    return remove_repeats(df, unit, lambda opened, scratch: extended(opened, unit, scratch), id_col, text_col)


def op5_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_substrings(docs)
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n_units").alias("n_words"),
        "n_removed",
        F.sha2("kept", 256).alias("kept_sha256"),
    )
