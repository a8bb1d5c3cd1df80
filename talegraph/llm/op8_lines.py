"""Line dedup: remove lines that lie in a window of three lines seen earlier.

Method: lines are the parts of a text between line feeds, an overlapping window is three
consecutive lines of one document.  Windows are hashed, repeated hashes found over the
whole corpus (combined before the shuffle), and the lines covered by a window that also
starts earlier - in a smaller id, or earlier in the same text - are merged and removed.
Windows are judged on the input, not on what is left.

Results for odd input: null and empty texts have no lines; a text of fewer than three lines
keeps all; windows of three blank lines don't count; a null id counts as the largest id;
rows that share an id do not match each other; repeats inside each row count; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import IS_WORD, U64, hash_words, mix, pieces, signed
from .repeats import _lists, match_lists, ordered
from .scratch import TEXT_ROWS, Scratch, arrow_rows, join_checked

WINDOW = 3


class Lines:
    """Lines of the texts of one piece and hashes of their windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        feeds = np.flatnonzero(data == 10)
        full = np.diff(offsets) > 0
        tail = offsets[1:][full]
        self.ends = np.sort(np.concatenate([feeds, tail]), kind="stable")
        self.starts = np.sort(np.concatenate([feeds + 1, offsets[:-1][full]]), kind="stable")
        counts = np.zeros(len(full), np.int64)
        counts[full] = 1
        counts += np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1])
        self.before = np.concatenate([[0], np.cumsum(counts)])
        h = hash_words(data, self.starts, self.ends, False, 5)
        marks = np.concatenate([[0], np.cumsum(IS_WORD[data])])
        blank = marks[self.ends] == marks[self.starts]
        n = max(0, len(h) - window + 1)
        name, empty = np.zeros(n, U64), np.ones(n, bool)
        for j in range(window if n else 0):
            name += h[j : j + n] * U64(2 * j + 0x9E3779B97F4A7C15)
            name = mix(name)
            empty &= blank[j : j + n]
        text = np.repeat(np.arange(len(counts)), counts)[:n]
        self.at = np.flatnonzero((np.arange(n) + window <= self.before[1:][text]) & ~empty) if n else np.zeros(0, np.int64)
        self.text, self.name = text[self.at], name[self.at]
        order = np.lexsort((self.at, self.name, self.text))
        head = np.ones(len(order), bool)
        head[1:] = (self.text[order][1:] != self.text[order][:-1]) | (self.name[order][1:] != self.name[order][:-1])
        self.new = np.zeros(len(order), bool)  # first of its name in its text
        self.new[order[head]] = True


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, data, offsets in pieces(batch.column(1)):
                x = Lines(data, offsets, window)
                if x.new.any():
                    text = x.text[x.new]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(x.name[x.new])), pa.array(docs[lo:hi][text]), pa.array(rows[lo:hi][text])], ["w", "doc", "row"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, koff = _lists(batch.column(2))
            known = known.to_numpy()
            for lo, hi, data, offsets in pieces(batch.column(1)):
                x = Lines(data, offsets, window)
                again = (match_lists(x.text, signed(x.name), known[koff[lo] : koff[hi]], koff[lo : hi + 1] - koff[lo]) >= 0) | ~x.new
                n = len(x.starts)
                cover = np.bincount(x.at[again], minlength=n + 1) - np.bincount(x.at[again] + window, minlength=n + 1)
                gone = np.cumsum(cover)[:n] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[x.before[1:]] - total[x.before[:-1]]
                raw, kept, which = data.tobytes(), [], []
                for i in range(hi - lo):
                    a, b = x.before[i], x.before[i + 1]
                    if not removed[i]:
                        kept.append(raw[offsets[i] : offsets[i + 1]].decode())
                        which.append([])
                        continue
                    keep = np.flatnonzero(~gone[a:b]) + a
                    kept.append(b"\n".join([raw[p:q] for p, q in zip(x.starts[keep], x.ends[keep], strict=True)]).decode())
                    which.append(np.flatnonzero(gone[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(x.before)), pa.array(removed.astype(np.int64)), pa.array(which, pa.list_(pa.int64())), pa.array(kept, pa.string()), *(batch.column(i).slice(lo, hi - lo) for i in range(3, batch.num_columns))], ["id", "n_lines", "n_removed", "removed_lines", "kept", *batch.schema.names[3:]])

    return run


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_lines, n_removed, removed_lines array<long>, kept text, then the columns of ``carry`` as carry_0...)."""
    scratch = Scratch(df.sparkSession, "lines")
    arrow_rows(df.sparkSession, TEXT_ROWS)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    docs = docs.withColumn("doc", ordered(docs)).withColumn("row", F.xxhash64(F.col("id").isNull(), "id", "text"))
    rows = scratch.save(docs.select("doc", "text", "row").mapInArrow(_windows(window), "w long, doc long, row long"))
    again = rows.groupBy("w").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    known = scratch.save(rows.join(again, "w").where("doc > first").groupBy("row").agg(F.collect_set("w").alias("known")))
    extra = [f"carry_{i}" for i in range(len(carry))]
    found = join_checked(docs, known, "row", "left", weight=F.size("known") * 8 + 24).select("id", "text", "known", *extra)
    kinds = "".join(f", {c} {kind}" for c, kind in docs.select(*extra).dtypes) if extra else ""
    return found.mapInArrow(_cut(window), f"id long, n_lines long, n_removed long, removed_lines array<long>, kept string{kinds}")


def op8_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents
), wins AS (
  SELECT doc_id, unnest(range(1, len(ls) - 1)) AS p, ls FROM lines WHERE len(ls) >= 3
), named AS (
  SELECT doc_id, p, ls[p] || chr(10) || ls[p+1] || chr(10) || ls[p+2] AS w FROM wins
  WHERE regexp_matches(ls[p] || ls[p+1] || ls[p+2], '[^\x20\x09-\x0D]')
), firsts AS (
  SELECT w, min(doc_id) AS d FROM named GROUP BY w
), starts AS (
  SELECT n.w, min(p) AS p0 , n.doc_id FROM named n GROUP BY n.w, n.doc_id
), dup AS (
  SELECT n.doc_id, n.p FROM named n JOIN firsts f ON n.w = f.w JOIN starts s ON s.w = n.w AND s.doc_id = n.doc_id
  WHERE n.doc_id > f.d OR n.p > s.p0
), gone AS (
  SELECT DISTINCT doc_id, unnest([p, p+1, p+2]) AS l FROM dup
), split AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS l FROM lines
), kept AS (
  SELECT s.doc_id, string_agg(line, chr(10) ORDER BY s.l) AS text, count(*) AS n
  FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.l = g.l WHERE g.l IS NULL GROUP BY s.doc_id
)
SELECT x.doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM lines x LEFT JOIN kept k ON x.doc_id = k.doc_id
"""
