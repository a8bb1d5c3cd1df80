"""Repeats over whole corpora: every window of units (bytes, words) that also starts earlier.

Plan, for texts of any number and length:

1. *Anchors.*  Winnowing cuts the windows of each text into blocks that share an anchor
   (``blocks.py``).  One row a block: anchor hash, content hash, document, row.
2. *Classes.*  Anchors are aggregated; one that stands in one document with one content is
   unique, and so are all windows around it.  Of the blocks of other anchors, those whose
   content also is in a smaller document are wholly repeats.  Of the first of each content,
   only those whose anchor has other contents can still hold repeated windows: the *open*
   blocks.
3. *Windows.*  The operator finds the repeated windows of the open blocks: by names of what
   a seed grows to (``op5_substring``) or by prefix doubling (``op2_suffix_array``).
4. *Cover.*  Repeated windows are merged into maximal runs, which are cut from the text.

The earliest occurrence of any window lies in a block that is the first of its content (if
an earlier block had the same content, it would hold an earlier occurrence), so comparing
only first blocks loses nothing.

Hot passages: minima by anchor, content and window are combined before each shuffle, and
joined back by equal keys, whose skew Spark can split; no task holds a group.

Rows with a null id count as the largest id; rows that share an id do not match each other.
Lists are kept for each row, which a hash of id and text names, so rows that share an id, or
have none, never gather in one place.  Null texts are empty.  Contents and windows are
compared by 64-bit hashes of themselves and of their anchors together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks
from .bytescan import U64, RunHash, Words, byte_runs, pieces, signed, text_buffers, value_runs
from .scratch import TEXT_ROWS, Scratch, arrow_rows

LAST_ID = (1 << 63) - 1
#: Open blocks that leave a task in one batch.
BODY_ROWS = 4_000


@dataclass(frozen=True)
class Unit:
    """What a window is made of.

    same_text: whether an earlier start in the same text counts.
    """

    length: int
    gram: int
    bytes_wide: int
    same_text: bool

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, RunHash, np.ndarray, Words | None]:
        """Units, their run hashes, units before each text, words if units are words."""
        if self.bytes_wide == 1:
            return data, byte_runs(data), offsets, None
        w = Words(data, offsets, False)
        return w.hashes, value_runs(w.hashes), w.before, w


def _first_in_text(x: Blocks) -> np.ndarray:
    """For each block, the index of the first block of its text with its content."""
    order = np.lexsort((x.lo, x.content, x.text))
    t, c = x.text[order], x.content[order]
    start = np.ones(len(order), bool)
    start[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
    head = np.empty(len(order), np.int64)
    head[order] = order[np.flatnonzero(start)[np.cumsum(start) - 1]] if len(order) else order
    return head


def ordered(docs: DataFrame) -> Column:
    """Ids in order, null after all others: as LAST_ID, if need be with the others moved down by one."""
    lo, hi, none = docs.agg(F.min("id"), F.max("id"), F.coalesce(F.bool_or(F.col("id").isNull()), F.lit(False))).first()
    shift = int(none and hi == LAST_ID and lo > -LAST_ID - 1)
    return F.coalesce(F.col("id") - shift, F.lit(LAST_ID))


def _anchor_rows(unit: Unit, named: bool):
    """named: with the row that each anchor is of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, data, offsets in pieces(batch.column(1)):
                _, runs, before, _ = unit.scan(data, offsets)
                x = Blocks(runs, before, unit.length, unit.gram)
                keep = _first_in_text(x) == np.arange(len(x.lo))
                if keep.any():
                    text = x.text[keep]
                    cols = [x.gram[keep].view(np.int64), x.content[keep].view(np.int64), docs[lo:hi][text], *([rows[lo:hi][text]] if named else [])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "content", "doc", "row"][: len(cols)])

    return run


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an array column; null lists are empty."""
    flat = column.flatten()
    lengths = np.array(column.value_lengths().fill_null(0))
    return flat, np.concatenate([[0], np.cumsum(lengths)])


BODIES = "gram long, doc long, row long, content long, place long, anchor int, body binary"


def open_bodies(unit: Unit):
    """Rows (doc, text, row, open contents) -> BODIES: the units of the open blocks.

    place: where the block starts in its text; anchor: where its anchor starts in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            wanted, woff = _lists(batch.column(3))
            wanted = wanted.to_numpy()
            for lo, hi, data, offsets in pieces(batch.column(1)):
                units, runs, before, _ = unit.scan(data, offsets)
                x = Blocks(runs, before, unit.length, unit.gram)
                if not len(x.lo):
                    continue
                at = match_lists(x.text, signed(x.content), wanted[woff[lo] : woff[hi]], woff[lo : hi + 1] - woff[lo])
                every = np.flatnonzero((at >= 0) & (_first_in_text(x) == np.arange(len(x.lo))))
                for i in range(0, len(every), BODY_ROWS):
                    pick = every[i : i + BODY_ROWS]
                    text, a, b = x.text[pick], x.lo[pick], x.hi[pick] + unit.length
                    sizes = np.concatenate([[0], np.cumsum((b - a) * unit.bytes_wide)]).astype(np.int32)
                    body = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(sizes), pa.py_buffer(np.ascontiguousarray(units[spread(a, b)]).view(np.uint8))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(x.gram[pick])), pa.array(docs[lo:hi][text]), pa.array(rows[lo:hi][text]), pa.array(signed(x.content[pick])), pa.array((a - before[text]).astype(np.int64)), pa.array((x.anchor[pick] - a).astype(np.int32)), body],
                        ["gram", "doc", "row", "content", "place", "anchor", "body"],
                    )

    return run


def bodies_of(unit: Unit, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Units of all bodies, and where each begins."""
    data, offsets = text_buffers(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    return (data if unit.bytes_wide == 1 else np.frombuffer(data.tobytes(), U64)), offsets // unit.bytes_wide


def spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integers of all ranges [a, b), one range after another."""
    n = b - a
    if not len(n) or not n.sum():
        return np.zeros(0, np.int64)
    return np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def all_matches(text: np.ndarray, content: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (block, place in flat) of all entries of a block's text that name its content."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((flat, owner))
    t, c = owner[order], flat[order]
    head = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])) if len(order) else np.zeros(0, np.int64)
    at = match_lists(text, content, c[head], np.searchsorted(t[head], np.arange(len(offsets))))
    blocks = np.flatnonzero(at >= 0)
    first = head[at[blocks]] if len(head) else head
    size = np.diff(np.append(head, len(order)))[at[blocks]] if len(head) else first
    return np.repeat(blocks, size), order[spread(first, first + size)]


def match_lists(text: np.ndarray, content: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Place in flat of each (text, content), or -1; flat holds the contents of text i at offsets[i]:offsets[i+1]."""
    out = np.full(len(text), -1, np.int64)
    if not len(flat) or not len(text):
        return out
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    names = np.unique(flat)
    place = np.searchsorted(names, content)
    place[place == len(names)] = 0
    there = names[place] == content
    key = owner.astype(np.int64) * len(names) + np.searchsorted(names, flat)
    order = np.argsort(key, kind="stable")
    want = text[there].astype(np.int64) * len(names) + place[there]
    at = np.searchsorted(key[order], want)
    at[at == len(key)] = 0
    hit = key[order][at] == want
    where = np.flatnonzero(there)[hit]
    out[where] = order[at[hit]]
    return out


def _cover(unit: Unit):
    """Rows (id, text, whole blocks, blocks with windows, those windows) -> what is left of each text, and the removed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, noff = _lists(batch.column(2))
            some, soff = _lists(batch.column(3))
            names, some = names.to_numpy(), [some.field(c).to_numpy().astype(np.int64) for c in ("content", "at", "n")]
            for lo, hi, data, offsets in pieces(batch.column(1)):
                units, runs, before, words = unit.scan(data, offsets)
                x = Blocks(runs, before, unit.length, unit.gram)
                gone = np.zeros(int(before[-1]) + 1, np.int64)
                if len(x.lo):
                    whole = match_lists(x.text, signed(x.content), names[noff[lo] : noff[hi]], noff[lo : hi + 1] - noff[lo]) >= 0
                    if unit.same_text:
                        whole |= _first_in_text(x) != np.arange(len(x.lo))
                    part, at = all_matches(x.text, signed(x.content), some[0][soff[lo] : soff[hi]], soff[lo : hi + 1] - soff[lo])
                    at = soff[lo] + at
                    hit = x.lo[part] + some[1][at]
                    a, b = np.concatenate([x.lo[whole], hit]), np.concatenate([x.hi[whole], hit + some[2][at] - 1]) + unit.length
                    gone = np.bincount(a, minlength=len(gone)) - np.bincount(b, minlength=len(gone))
                out = np.cumsum(gone)[:-1] > 0
                edge = np.zeros(len(out) + 1, bool)
                edge[before[:-1][before[:-1] < len(out)]] = True
                start = out & (np.concatenate([[True], ~out[:-1]]) | edge[:-1]) if len(out) else out
                stop = out & (np.concatenate([~out[1:], [True]]) | edge[1:]) if len(out) else out
                starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
                each = np.searchsorted(starts, before)
                counts = np.diff(before)
                total = np.concatenate([[0], np.cumsum(out)])
                removed = total[before[1:]] - total[before[:-1]]
                owner = np.repeat(np.arange(hi - lo), np.diff(each))
                if words is None:
                    kept_sizes = counts - removed
                    body = data[~out]
                    kept = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(kept_sizes)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))]).cast(pa.binary())
                else:
                    keep = np.flatnonzero(~out)
                    per = np.searchsorted(keep, before)
                    joined = []
                    raw = data.tobytes()
                    s, e = words.starts[keep], words.ends[keep]
                    for i in range(hi - lo):
                        joined.append(b" ".join([raw[p:q] for p, q in zip(s[per[i] : per[i + 1]], e[per[i] : per[i + 1]], strict=True)]))
                    kept = pa.array(joined, pa.binary())
                runs_list = pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), pa.StructArray.from_arrays([pa.array((starts - before[owner]).astype(np.int64)), pa.array((stops - before[owner]).astype(np.int64))], ["start", "end"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), runs_list, kept], ["id", "n_units", "n_removed", "spans", "kept"])

    return run


def remove_repeats(df: DataFrame, unit: Unit, repeated: Callable[[DataFrame, Scratch], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """(id, n_units, n_removed, spans array<struct<start, end>>, kept binary), one row for each of df.

    repeated: (doc, text, row, open contents) -> (row, content, at, n), n repeated windows of open blocks from at on."""
    spark = df.sparkSession
    scratch = Scratch(spark, "repeats")
    arrow_rows(spark, TEXT_ROWS)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("row", F.xxhash64(F.col("id").isNull(), "id", "text")).withColumn("doc", ordered(docs))
    keyed = docs.select("doc", "text", "row")
    shared = keyed.mapInArrow(_anchor_rows(unit, False), "gram long, content long, doc long").groupBy("gram").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.min("doc").alias("a"), F.max("doc").alias("z"))
    shared = shared.where("lo < hi or a < z" if unit.same_text else "a < z")
    shared = scratch.save(shared.select("gram", (F.col("lo") < F.col("hi")).alias("several")))
    rows = keyed.mapInArrow(_anchor_rows(unit, True), "gram long, content long, doc long, row long")
    met = scratch.save(rows.join(shared.hint("merge"), "gram"))
    firsts = met.groupBy("gram", "content").agg(F.min("doc").alias("first"))
    judged = met.join(firsts.hint("merge"), ["gram", "content"])
    again = F.col("doc") > F.col("first")
    per_row = judged.groupBy("row").agg(F.collect_set(F.when(again, F.col("content"))).alias("again"), F.collect_set(F.when(~again & F.col("several"), F.col("content"))).alias("opened"))
    per_row = scratch.save(per_row.where("size(again) > 0 or size(opened) > 0"))
    for t in (shared, met):
        scratch.drop(t)
    opened = per_row.where("size(opened) > 0").select("row", "opened")
    windows = repeated(keyed.join(opened.hint("merge"), "row").select("doc", "text", "row", "opened"), scratch)
    windows = windows.groupBy("row").agg(F.collect_set(F.struct("content", "at", "n")).alias("windows"))
    both = scratch.save(per_row.select("row", "again").join(windows, "row", "left").where("size(again) > 0 or windows is not null"))
    found = docs.join(both.hint("merge"), "row", "left")
    return found.select("id", "text", "again", "windows").mapInArrow(_cover(unit), "id long, n_units long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
