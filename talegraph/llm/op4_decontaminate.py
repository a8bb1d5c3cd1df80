"""Benchmark decontamination by winnowing.

Method: fingerprints are the least hash of the 5-grams in every window of 10 words, so each
shared span of 10 words or more has a fingerprint in both texts.  Test and training
fingerprints are joined, and each hit is extended to both sides: the windows of 10 words
around it that occur in the item are found and their words marked.  An item of fewer words
is one window, sought at every place.

Benchmarks are small beside a corpus: while the fingerprint table is within
``INDEX_BYTES`` (it is counted first) it is broadcast and documents are scanned where they
lie, with no shuffle of text.  With a larger benchmark all of it is joined by Spark:
fingerprints that both sides have are kept for each text, the text's windows around them are
named, and these names are joined to those of the items' windows, so a pair of document and
item is a row only where they share a whole window, however common a fingerprint is.

Results for odd input: a null or empty text has no words, as an item it occurs nowhere; a
null item id counts as ""; items with one id are one; a null document id is kept; repeated
rows have equal results; empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import IS_ALNUM, U64, RunHash, Words, signed, sliding_min, value_runs, words_of
from .scratch import TEXT_ROWS, Scratch, arrow_rows

WINDOW = 10
GRAM = 5
INDEX_BYTES = 16 << 20

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"


def winnowed(runs: RunHash, before: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of the texts of one piece."""
    total = int(before[-1])
    n = total - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.arange(total - gram + 1)
    grams = runs.of(at, at + gram)
    width = window - gram + 1
    least = sliding_min(grams, width)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))[:n]
    whole = np.arange(n) + window <= before[1:][text]
    picked = np.zeros(len(grams), bool)
    for j in range(width):  # every place that holds a window's least, so ties lose nothing
        picked[j : j + n] |= whole & (grams[j : j + n] == least[:n])
    at = np.flatnonzero(picked)
    return at, grams[at]


class Index:
    """Items' fingerprints with their places, and the hashes of their windows."""

    def __init__(self, items: list[tuple[str, str]], window: int, gram: int):
        self.window, self.gram = window, gram
        ids = sorted({i for i, _ in items})
        self.ids = ids
        number = {x: k for k, x in enumerate(ids)}
        fp, owner, place, short, short_owner = [], [], [], {}, {}
        wins, base = [], 0
        for lo, hi, w in words_of(pa.array([t or "" for _, t in items], pa.large_string()), True, IS_ALNUM):
            runs, who = value_runs(w.hashes), np.array([number[i] for i, _ in items[lo:hi]])
            at, g = winnowed(runs, w.before, window, gram)
            text = w.owner()
            fp.append(g)
            owner.append(who[text[at]] if len(at) else np.zeros(0, np.int64))
            place.append(at + base)
            # hash of the window that starts at each place; 0 where none does
            n = len(w.hashes)
            win = np.zeros(n, U64)
            full = np.flatnonzero(np.arange(n) + window <= w.before[1:][text]) if n else np.zeros(0, np.int64)
            win[full] = runs.of(full, full + window)
            wins.append(win)
            base += n
            counts = w.counts()
            for i in np.flatnonzero((counts > 0) & (counts < window)):
                a, b = w.before[i], w.before[i + 1]
                short.setdefault(int(b - a), []).append(runs.of(np.array([a]), np.array([b]))[0])
                short_owner.setdefault(int(b - a), []).append(who[i])
        fp, owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (fp, owner, place))
        order = np.argsort(fp, kind="stable")
        self.fp, self.owner, self.place = fp[order].astype(U64), owner[order], place[order]
        self.wins = np.concatenate([np.zeros(window, U64), *wins, np.zeros(window, U64)])
        self.short = {m: self._sorted(np.array(h, U64), np.array(short_owner[m])) for m, h in short.items()}

    @staticmethod
    def _sorted(h: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h, kind="stable")
        return h[order], who[order]

    def nbytes(self) -> int:
        return self.fp.nbytes + self.owner.nbytes + self.place.nbytes + self.wins.nbytes + sum(len(i) + 60 for i in self.ids)

    def hits(self, w: Words, runs: RunHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, item number) of every occurrence of a window in the words of a piece."""
        out = []
        at, g = winnowed(runs, w.before, self.window, self.gram)
        for p, who, q in self._met(self.fp, at, g, self.owner, self.place):
            text = w.owner()
            for back in range(self.window - self.gram + 1):  # extend: windows that begin so many words before the hit
                i = p - back
                ok = (i >= 0) & (i + self.window <= len(w.hashes))
                i, k, j = i[ok], who[ok], q[ok] - back + self.window
                ok = (text[i] == text[i + self.window - 1]) & (self.wins[j] != 0)
                i, k, j = i[ok], k[ok], j[ok]
                ok = runs.of(i, i + self.window) == self.wins[j]
                out.append((i[ok], i[ok] + self.window, k[ok]))
        for m, (names, owners) in self.short.items():
            n = len(w.hashes) - m + 1
            if n <= 0:
                continue
            text = w.owner()
            at = np.flatnonzero(text[:n] == text[m - 1 :])
            for p, who, _ in self._met(names, at, runs.of(at, at + m), owners, owners):
                out.append((p, p + m, who))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    @staticmethod
    def _met(names: np.ndarray, at: np.ndarray, g: np.ndarray, owner: np.ndarray, place: np.ndarray):
        """Joins places to all entries of their name; the number of entries taken at once is bounded."""
        a, b = np.searchsorted(names, g), np.searchsorted(names, g, "right")
        some = b > a
        at, a, b = at[some], a[some], b[some]
        while len(at):
            n = max(1, int(np.searchsorted(np.cumsum(b - a), 1 << 20, "right")))
            k = (b - a)[:n]
            entry = np.repeat(a[:n] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            yield np.repeat(at[:n], k), owner[entry], place[entry]
            at, a, b = at[n:], a[n:], b[n:]


def _result(w: Words, ids: list[str], start: np.ndarray, end: np.ndarray, item: np.ndarray) -> list[pa.Array]:
    """The columns of RESULT for the texts of a piece."""
    n = len(w.hashes)
    cover = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    hit = np.cumsum(cover)[:n] > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    count = total[w.before[1:]] - total[w.before[:-1]]
    items: list[list[str]] = [[] for _ in count]
    spans: list[list[dict]] = [[] for _ in count]
    if len(start):
        text = w.owner()[start]
        for t, k in np.unique(np.stack([text, item]), axis=1).T:
            items[t].append(ids[k])
        for t in np.flatnonzero(count):
            a, b = w.before[t], w.before[t + 1]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
            spans[t] = [{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)]
            items[t].sort()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [pa.array(w.counts()), pa.array(count.astype(np.int64)), pa.array(items, pa.list_(pa.string())), pa.array(spans, kind)]


def _scan(shared, carried: int):
    """Texts in column 0; the others are carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for lo, hi, w in words_of(batch.column(0), True, IS_ALNUM):
                cols = _result(w, index.ids, *index.hits(w, value_runs(w.hashes)))
                rest = [batch.column(i + 1).slice(lo, hi - lo) for i in range(carried)]
                yield pa.RecordBatch.from_arrays([*rest, *cols], [*batch.schema.names[1:], "n_words", "n_hit", "items", "spans"])

    return run


def _short_runs(w: Words, runs: RunHash, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of m words."""
    n = len(w.hashes) - m + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    text = w.owner()
    at = np.flatnonzero(text[:n] == text[m - 1 :])
    return at, runs.of(at, at + m)


def _fingerprints(window: int, gram: int, short: list[int]):
    """(key, text) -> (key, fp); short: lengths of short items, whose runs count at every place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in words_of(batch.column(1), True, IS_ALNUM):
                runs, text = value_runs(w.hashes), w.owner()
                met = [winnowed(runs, w.before, window, gram), *(_short_runs(w, runs, m) for m in short)]
                owners, names = np.concatenate([text[at] for at, _ in met]), np.concatenate([g for _, g in met])
                pair = np.unique(np.stack([owners.astype(np.int64), signed(names)]), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(pair[0])), pa.array(pair[1])], ["key", "fp"])

    return run


def _item_windows(window: int):
    """(item, text) -> (item, win): names of its windows, or of all its words if they are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in words_of(batch.column(1), True, IS_ALNUM):
                runs, text, counts = value_runs(w.hashes), w.owner(), w.counts()
                at, names = _short_runs(w, runs, window)
                few = np.flatnonzero((counts > 0) & (counts < window))
                owners = np.concatenate([text[at], few]).astype(np.int64)
                names = np.concatenate([names, runs.of(w.before[few], w.before[few + 1])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(owners)), pa.array(signed(names))], ["item", "win"])

    return run


def _met_windows(window: int, gram: int, short: list[int]):
    """(key, text, fps) -> (key, win, at, size): the windows around the fingerprints that items have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, off = batch.column(2).flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.array(batch.column(2).value_lengths()))])
            for lo, hi, w in words_of(batch.column(1), True, IS_ALNUM):
                runs, text = value_runs(w.hashes), w.owner()
                known = np.unique(fps[off[lo] : off[hi]])
                at, g = winnowed(runs, w.before, window, gram)
                at = at[np.isin(signed(g), known)]
                start = np.unique((at[:, None] - np.arange(window - gram + 1)).reshape(-1))
                start = start[(start >= 0) & (start + window <= len(w.hashes))]
                start = start[text[start] == text[start + window - 1]]
                found = [(start, runs.of(start, start + window), window)]
                for m in short:
                    at, g = _short_runs(w, runs, m)
                    ok = np.isin(signed(g), known)
                    found.append((at[ok], g[ok], m))
                at, names = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                size = np.repeat([x[2] for x in found], [len(x[0]) for x in found])
                owner = text[at] if len(at) else at
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(owner)), pa.array(signed(names)), pa.array(at - w.before[owner]), pa.array(size.astype(np.int32))], ["key", "win", "at", "size"])

    return run


def _marked(carried: int):
    """(text, hits, items, carried) -> RESULT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, items = batch.column(1), batch.column(2)
            off = np.concatenate([[0], np.cumsum(np.array(hits.value_lengths().fill_null(0)))])
            at, size = (hits.flatten().field(c).to_numpy().astype(np.int64) for c in ("at", "size"))
            for lo, hi, w in words_of(batch.column(0), True, IS_ALNUM):
                text = np.repeat(np.arange(hi - lo), np.diff(off[lo : hi + 1]))
                start = w.before[text] + at[off[lo] : off[hi]]
                none = np.zeros(len(start), np.int64)
                cols = _result(w, [""], start, start + size[off[lo] : off[hi]], none)
                cols[2] = pa.array([sorted(x) if x else [] for x in items.slice(lo, hi - lo).to_pylist()], pa.list_(pa.string()))
                rest = [batch.column(i + 3).slice(lo, hi - lo) for i in range(carried)]
                yield pa.RecordBatch.from_arrays([*rest, *cols], [*batch.schema.names[3:], "n_words", "n_hit", "items", "spans"])

    return run


def contaminated(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = (), index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(id, carry_0..., n_words, n_hit, items, spans of words), one row for each of df."""
    spark = df.sparkSession
    arrow_rows(spark, TEXT_ROWS)
    gram = min(GRAM, window)
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text")).where("length(text) > 0").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item") + 40), F.lit(0))).first()[0]
    extra = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    docs = df.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), *extra)
    kinds = ", ".join(f"{c} {kind}" for c, kind in docs.drop("text").dtypes)
    # an index takes some 8 bytes a byte of text
    if size * 8 <= index_bytes:
        index = Index([(r.item, r.text) for r in items.sort("item", "text").toLocalIterator()], window, gram)
        return docs.mapInArrow(_scan(spark.sparkContext.broadcast(index), 1 + len(carry)), f"{kinds}, {RESULT}")
    scratch = Scratch(spark, "decontaminate")
    n_words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    short = sorted(r[0] for r in items.select(n_words.alias("n")).where(f"n > 0 and n < {window}").distinct().collect())  # fewer than window
    item_fps = scratch.save(items.mapInArrow(_fingerprints(window, gram, short), "key string, fp long").select("fp").distinct())
    item_wins = scratch.save(items.mapInArrow(_item_windows(window), "item string, win long").distinct())
    keyed = docs.withColumn("key", F.md5("text"))
    texts = keyed.select("key", "text").where("length(text) > 0")
    fps = texts.mapInArrow(_fingerprints(window, gram, short), "key string, fp long").join(item_fps.hint("merge"), "fp", "left_semi")
    fps = scratch.save(fps.groupBy("key").agg(F.collect_set("fp").alias("fps")))
    near = texts.join(fps.hint("merge"), "key").dropDuplicates(["key"]).select("key", "text", "fps")
    met = scratch.save(near.mapInArrow(_met_windows(window, gram, short), "key string, win long, at long, size int"))
    met = met.join(item_wins.select("win").distinct().hint("merge"), "win", "left_semi")
    hits = met.groupBy("key").agg(F.collect_list(F.struct("at", "size")).alias("hits"))
    named = met.select("key", "win").distinct().join(item_wins.hint("merge"), "win").groupBy("key").agg(F.collect_set("item").alias("named"))
    found = scratch.save(hits.join(named, "key"))
    out = keyed.join(found.hint("merge"), "key", "left").select("text", "hits", "named", *docs.drop("text").columns)
    return out.mapInArrow(_marked(1 + len(carry)), f"{kinds}, {RESULT}")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, bench).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
