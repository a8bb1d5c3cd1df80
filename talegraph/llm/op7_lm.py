"""Language-model scoring with Brown's class-based bigrams.

Method, each step over all training documents:

1. Count every token, with the shape of its word (length, digits, marks, script).
2. Bigrams between the ``CORE`` most frequent words, with all others as their shapes.  On
   these bounded counts exchange clustering moves one core word at a time to the class that
   gains most mutual information, until a sweep moves none.  This seeds the classes.
3. Exchange over the whole vocabulary of words seen ``MIN_COUNT`` times or more, which grows
   with the corpus: in a sweep Spark counts, for each word, the classes before and after it
   (combined in each task, dealt by word), every word moves to the class that explains its
   neighbours best, and the new class table goes to the tasks.  ``SWEEPS_ALL`` sweeps.
   Rarer and unseen words keep the class of their shape.
4. Class bigrams of the whole corpus under the final classes.

The score of a text is the sum over its tokens of log10 P(class | class before) +
log10 P(token | class), smoothed so that both are proper distributions, with one kind for all
unseen words of a shape.  A text begins after an end.

Tables of words reach the tasks by broadcast and hold ``HEAD`` words at most, some 100 MB; past
that the least count rises, with ties drawn by hash.  The counts of all other words, however
many, stay in Spark: their tokens are joined to them, one row for each document and word.

Results for odd input: a null text is empty and consists of its end; a null id is trained
on and not held out; repeated rows count as often as they occur in training and are scored
alike; if all rows are held out, every token is unseen; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import U64, Words, mix, signed, value_runs, words_of
from .scratch import COMBINED_ROWS, Scratch, arrow_rows

CORE, CLASSES = 512, 48
MIN_COUNT = 16
HEAD = 1 << 22
SWEEPS, SWEEPS_ALL = 6, 2
#: Cells of (word, class) that a task holds before it passes them on, and words in a part of them.
HELD_CELLS, PART_WORDS = 1 << 22, 1 << 13
SHAPES = 48
END = signed(mix(np.array([0x51ED270B, 1], U64)))[0]
SMOOTH = 50.0

_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_WIDE = np.arange(256) >= 128


def shapes(w: Words) -> np.ndarray:
    """A number below SHAPES for each word."""
    if not len(w.hashes):
        return np.zeros(0, np.int64)
    length = w.ends - w.starts
    size = np.searchsorted([3, 5, 8, 12, 20], length)  # 0..5
    last = w.data[w.ends - 1]
    mark = (last < 0x30) | ((last > 0x39) & (last < 0x41)) | ((last > 0x5A) & (last < 0x61)) | ((last > 0x7A) & (last < 0x80))

    def holds(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[w.data])])
        return total[w.ends] > total[w.starts]

    return size * 8 + mark * 4 + holds(_DIGIT) * 2 + holds(_WIDE)


def with_ends(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts, each closed by its end: hashes, shapes (-1 for ends), tokens before each text."""
    n = len(w.hashes)
    before = w.before + np.arange(len(w.before))
    tokens, kind = np.full(n + len(w.before) - 1, END), np.full(n + len(w.before) - 1, -1, np.int64)
    at = np.arange(n) + w.owner()
    tokens[at], kind[at] = signed(w.hashes), shapes(w)
    return tokens, kind, before


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[tuple] = []
        for _, _, w in words_of(batch.column(0), True):
            tokens, kind, _ = with_ends(w)
            h, at, n = np.unique(tokens, return_index=True, return_counts=True)
            held.append((h, kind[at], n))
        if held:
            h, k, n = (np.concatenate(x) for x in zip(*held, strict=True))
            h, at, back = np.unique(h, return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k[at].astype(np.int32)), pa.array(np.bincount(back, n).astype(np.int64))], ["h", "shape", "n"])


class Table:
    """Sorted hashes with a number each; ``of`` gives the default for the others."""

    def __init__(self, h: np.ndarray, value: np.ndarray):
        order = np.argsort(h)
        self.h, self.value = h[order], value[order]

    def of(self, h: np.ndarray, default: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return default
        at = np.searchsorted(self.h, h)
        at[at == len(self.h)] = 0
        return np.where(self.h[at] == h, self.value[at], default)


def _prior(unit: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The unit before each token; a text begins after an end."""
    out = np.concatenate([[0], unit[:-1]])
    out[before[:-1]] = 0
    return out


def _bigrams(shared, size: int):
    """Counts of (unit, next unit), as unit * size + next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, total = shared.value, np.zeros(size * size, np.int64)
        for batch in batches:
            for _, _, w in words_of(batch.column(0), True):
                tokens, kind, before = with_ends(w)
                unit = units.of(tokens, kind + 1)
                total += np.bincount(_prior(unit, before) * size + unit, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return run


def _neighbours(shared, size: int, parts: int):
    """Counts of the classes before and after each word of the table, dealt over parts by word.

    A row holds the cells of one part: word // parts * 2 * size + side * size + class, in order,
    as differences, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, words = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            key, n = key[at], np.add.reduceat(n, at) if len(at) else n
            held.clear()
            word, rest = np.divmod(key, 2 * size)
            part, cell = word % parts, word // parts * 2 * size + rest
            order = np.lexsort((cell, part))
            part, cell, n = part[order], cell[order], n[order]
            edge = np.searchsorted(part, np.arange(parts + 1))
            for i in range(parts):
                c, k = cell[edge[i] : edge[i + 1]], n[edge[i] : edge[i + 1]]
                if len(c):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.diff(c, prepend=0).astype(np.int32).tobytes()], pa.binary()), pa.array([k.astype(np.int32).tobytes()], pa.binary())], ["part", "cells", "counts"])

        for batch in batches:
            for _, _, w in words_of(batch.column(0), True):
                tokens, kind, before = with_ends(w)
                unit, word = units.of(tokens, kind + 1), words.of(tokens, np.full(len(tokens), -1))
                after = np.concatenate([unit[1:], [0]])
                ok = (word >= 0) & (tokens != END)
                key = word[ok] * 2 * size
                held.append(np.unique(np.concatenate([key + _prior(unit, before)[ok], key + size + after[ok]]), return_counts=True))
                if sum(len(k) for k, _ in held) > HELD_CELLS:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _best_classes(shared, size: int, parts: int, words: int):
    """All rows of some parts -> for each of their words the class that explains its neighbours best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = shared.value  # log P(class before | named class), log P(class after | named class)
        around: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part not in around:
                    around[part] = np.zeros((-(-(words - part) // parts), 2 * size), np.float32)
                cell = np.cumsum(np.frombuffer(cells, np.int32), dtype=np.int64)
                around[part].reshape(-1)[cell] += np.frombuffer(counts, np.int32)
        for part, x in around.items():
            best = np.argmax(x[:, :size] @ before.T + x[:, size:] @ after.T, axis=1)
            some = np.flatnonzero(x.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array((some * parts + part).astype(np.int64)), pa.array(best[some].astype(np.int32))], ["word", "class"])

    return run


def exchange(counts: np.ndarray, movable: np.ndarray, first: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Exchange clustering.  counts[u, v]: bigrams of units; movable units are moved among
    ``classes`` classes, others keep the classes of ``first`` that come after those."""
    label = first.copy()
    k = int(label.max(initial=0)) + 1
    k = max(k, classes)

    def plogp(x):
        return x * np.log(np.maximum(x, 1))

    onto = np.zeros((len(label), k))
    onto[np.arange(len(label)), label] = 1
    out, into = counts @ onto, counts.T @ onto  # unit -> class, class -> unit
    grid = onto.T @ out
    for _ in range(sweeps):
        moved = 0
        for u in movable:
            c = label[u]
            o, i, s = out[u].copy(), into[u].copy(), counts[u, u]
            grid[c] -= o
            grid[:, c] -= i
            grid[c, c] += s
            o[c] -= s
            i[c] -= s
            row, col = grid.sum(1)[:classes], grid.sum(0)[:classes]
            g = grid[:classes]
            gain = (plogp(g + o) - plogp(g)).sum(1) + (plogp(grid[:, :classes].T + i) - plogp(grid[:, :classes].T)).sum(1)
            d = grid[np.arange(classes), np.arange(classes)]
            oc, ic = o[:classes], i[:classes]
            gain += plogp(d + oc + ic + s) - plogp(d + oc) - plogp(d + ic) + plogp(d)
            gain -= plogp(row + o.sum() + s) - plogp(row) + plogp(col + i.sum() + s) - plogp(col)
            best = int(np.argmax(gain))
            best = c if gain[c] >= gain[best] - 1e-9 else best
            o[c] += s
            i[c] += s
            if best != c:
                moved += 1
                label[u] = best
                out[:, c] -= counts[:, u]
                out[:, best] += counts[:, u]
                into[:, c] -= counts[u]
                into[:, best] += counts[u]
                o, i = out[u].copy(), into[u].copy()
            grid[best] += o
            grid[:, best] += i
            grid[best, best] -= s
        if not moved:
            break
    return label


@dataclass
class Model:
    """What is learned.  Classes: 0 the end, then the shapes, then the named ones."""

    classes: Table  # of words in the head
    step: np.ndarray  # log10 P(class | class before)
    heads: np.ndarray  # words in the head, in order, the end among them
    seen: np.ndarray  # whether they occur in training
    base: np.ndarray  # their base scores
    emit: np.ndarray  # log10 P(word | class)
    below: np.ndarray  # by shape: what counts + 0.5 of all other words are divided by
    base_below: float
    tokens: int  # in training


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids = batch.column(0)
            marks = ids.to_numpy(zero_copy_only=False) if not ids.null_count else np.array([-1 if x is None else x for x in ids.to_pylist()], np.int64)
            for lo, hi, w in words_of(batch.column(1), True):
                tokens, kind, before = with_ends(w)
                unit = m.classes.of(tokens, kind + 1)
                at = np.searchsorted(m.heads, tokens)
                at[at == len(m.heads)] = 0
                known = m.heads[at] == tokens
                n = hi - lo
                text = np.repeat(np.arange(n), np.diff(before))
                base = np.bincount(text[known], m.base[at[known]], n).astype(np.float64)
                score = np.bincount(text, m.step[_prior(unit, before), unit], n) + np.bincount(text[known], m.emit[at[known]], n)
                seen = np.bincount(text[known], m.seen[at[known]], n).astype(np.int64)
                runs = value_runs(tokens.view(U64))
                name = signed(mix(runs.of(before[:-1], before[1:]) + mix(marks[lo:hi].astype(np.int64).view(U64) + U64(1))))
                rare = np.flatnonzero(~known)
                # rare words once for each text, and a row that says how often the text was seen
                pair = np.stack([text[rare], tokens[rare], kind[rare]])
                pair, times = np.unique(pair, axis=1, return_counts=True) if len(rare) else (np.zeros((3, 0), np.int64), np.zeros(0, np.int64))
                off = pa.array(np.searchsorted(pair[0], np.arange(n + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([pa.array(pair[1]), pa.array(pair[2].astype(np.int32)), pa.array(times.astype(np.int64))], ["h", "shape", "n"]))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n), pa.array(name), pa.array(np.diff(before)), pa.array(seen), pa.array(base), pa.array(score.astype(np.float64)), lists], ["id", "name", "n_tokens", "head_known", "head_base", "head_score", "rare"])

    return run


def head_words(counts: DataFrame, min_count: int, most: int) -> DataFrame:
    """The end and the words seen ``min_count`` times or more, or the most frequent of them if those are over ``most``.

    Found from some hundred ranges of counts, so no words are sorted."""
    band = F.floor(F.log2("n") * 16).cast("int")
    frequent = counts.where(F.col("n") >= min_count)
    bands = sorted(((r[0], r[1]) for r in frequent.groupBy(band.alias("b")).agg(F.count("*")).collect()), reverse=True)
    taken, chosen = 0, F.lit(True)
    for b, n in bands:
        if taken + n > most:  # of the words of this range, those whose hash is low
            cut = F.col("h") < F.lit(((most - taken) << 64) // n - (1 << 63))
            chosen = (band > b) | ((band == b) & cut)
            break
        taken += n
    return counts.where(((F.col("n") >= min_count) & chosen) | (F.col("h") == F.lit(int(END))))


def train_model(train: DataFrame, counts: DataFrame, min_count: int = MIN_COUNT, sweeps: int = SWEEPS_ALL, head: int = HEAD) -> Model:
    """train: text.  counts: (h, shape, n) of its tokens, a saved table."""
    spark = train.sparkSession
    sc = spark.sparkContext
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = head_words(counts, min_count, head).toArrow()
    h, n, shape = rows["h"].to_numpy(), rows["n"].to_numpy().astype(np.float64), rows["shape"].to_numpy().astype(np.int64)
    if END not in h:
        h, n, shape = np.append(h, END), np.append(n, 0.0), np.append(shape, -1)
    order = np.lexsort((h, -n))
    h, n, shape = h[order], n[order], shape[order]
    words = np.flatnonzero(h != END)

    def table(which: np.ndarray, classes: np.ndarray) -> Table:
        return Table(np.append(h[which], END), np.append(classes, 0))

    def bigrams(classes: Table, size: int) -> np.ndarray:
        cells = train.mapInArrow(_bigrams(sc.broadcast(classes), size), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size * size)
        out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        return out.reshape(size, size)

    # units: 0 the end, then the shapes, then core words
    fixed, core = SHAPES + 1, words[:CORE]
    grid = bigrams(table(core, np.arange(len(core)) + fixed), fixed + len(core))
    first = np.concatenate([np.arange(fixed) + CLASSES, np.arange(len(core)) % CLASSES])
    label = exchange(grid, np.arange(len(core)) + fixed, first, CLASSES)
    # classes from here on: 0 the end, 1..SHAPES the shapes, then the named classes
    size = fixed + CLASSES
    onto = np.zeros((len(first), size))
    onto[np.arange(len(first)), np.concatenate([np.arange(fixed), label[fixed:] + fixed])] = 1
    steps = onto.T @ grid @ onto
    classes = table(core, label[fixed:] + fixed)
    chosen = shape[words] + 1
    chosen[: len(core)] = label[fixed:] + fixed
    number = Table(h[words], np.arange(len(words)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(words) // PART_WORDS))
    for sweep in range(sweeps if len(words) else 0):
        if sweep:
            steps = bigrams(classes, size)
        after = np.log((steps[fixed:] + 0.5) / (steps[fixed:].sum(1, keepdims=True) + 0.5 * size))
        # the share of a word in its class counts too: log P(C | before) - log N(C) is, but for a constant, log P(before | C)
        before = np.log((steps[:, fixed:].T + 0.5) / (steps[:, fixed:].sum(0)[:, None] + 0.5 * size))
        cells = train.mapInArrow(_neighbours(sc.broadcast((classes, number)), size, parts), "part int, cells binary, counts binary")
        fits = sc.broadcast((before.astype(np.float32), after.astype(np.float32)))
        moved = cells.repartition(parts, "part").mapInArrow(_best_classes(fits, size, parts, len(words)), "word long, class int").toArrow()
        chosen[moved["word"].to_numpy()] = moved["class"].to_numpy() + fixed
        classes = table(words, chosen)
    steps = bigrams(classes, size)

    # P(class | class before), backed by how often a class follows any
    follow = (steps.sum(0) + 0.5) / (steps.sum() + 0.5 * size)
    step = np.log10((steps + SMOOTH * follow) / (steps.sum(1, keepdims=True) + SMOOTH))
    # P(token | class): named classes by their members, shapes by the rest and one unseen kind
    of = classes.of(h, shape + 1)
    members = np.bincount(of[words], n[words], size).astype(np.float64)
    rest = counts.where(F.col("shape") >= 0).groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()  # SHAPES rows
    mass, types = np.zeros(size), np.zeros(size)
    mass[rest["shape"].to_numpy(np.int64) + 1] = rest["n"].to_numpy(np.float64)
    types[rest["shape"].to_numpy(np.int64) + 1] = rest["kinds"].to_numpy(np.float64)
    mass -= np.bincount(shape[words] + 1, n[words], size)
    types -= np.bincount(shape[words] + 1, minlength=size)
    below = mass + 0.5 * (types + 1)
    emit = np.log10(np.maximum(n, 0.5) / np.maximum(members[of], 0.5))
    emit[h == END] = 0.0
    base_all = total + 0.5 * (kinds + 1)
    order = np.argsort(h)
    return Model(classes, step, h[order], (n > 0)[order], np.log10((n + 0.5) / base_all)[order], emit[order], below, float(base_all), int(total))


def held_out() -> Column:
    """Documents that are not trained on; a null id is."""
    return F.coalesce(F.crc32(F.col("id").cast("string")) % 5, F.lit(0)) == 1


def token_counts(train: DataFrame) -> DataFrame:
    """(h, shape, n) of every token."""
    return train.mapInArrow(_count, "h long, shape int, n long").groupBy("h").agg(F.first("shape").alias("shape"), F.sum("n").alias("n"))


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, sweeps: int = SWEEPS_ALL, head: int = HEAD) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), one row for each of df."""
    spark = df.sparkSession
    arrow_rows(spark, COMBINED_ROWS)
    scratch = Scratch(spark, "lm")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    train = docs.where(~held_out()).select("text")
    counts = scratch.save(token_counts(train))
    model = train_model(train, counts, min_count, sweeps, head)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.mapInArrow(_score(shared), "id long, name long, n_tokens long, head_known long, head_base double, head_score double, rare array<struct<h: long, shape: int, n: long>>")
    rows = scratch.save(rows)
    rare = rows.select("name", F.explode("rare").alias("r"))
    seen = rare.join(counts.select(F.col("h").alias("rh"), F.col("n").alias("c")), F.col("r.h") == F.col("rh"), "left")
    c, times = F.coalesce("c", F.lit(0)), F.col("r.n")
    denominators = F.element_at(F.array(*(F.lit(float(x)) for x in model.below[1 : SHAPES + 1])), F.col("r.shape") + 1)
    tail = seen.groupBy("name").agg(
        F.sum(times * F.log10((c + 0.5) / F.lit(model.base_below))).alias("base"),
        F.sum(times * F.log10((c + 0.5) / denominators)).alias("score"),
        F.sum(F.when(c > 0, times).otherwise(0)).alias("known"),
    )
    alike = rows.groupBy("name").agg(F.count("*").alias("times"))  # repeated rows share a name
    tail = tail.join(alike, "name")
    out = rows.drop("rare").join(tail, "name", "left")

    def both(head_part: str, tail_part: str):
        return F.col(head_part) + F.coalesce(F.col(tail_part) / F.col("times"), F.lit(0.0))

    out = out.select(
        "id",
        held_out().alias("held_out"),
        "n_tokens",
        F.round(both("head_known", "known")).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        both("head_base", "base").alias("base_score"),
        both("head_score", "score").alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op7_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs).withColumnRenamed("id", "doc_id")
