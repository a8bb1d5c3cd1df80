"""N-gram Jaccard join: documents whose sets of word shingles overlap by 80 % or more.

Method: the product of the sparse document by n-gram incidence matrix with its transpose,
taken in blocks of columns.  A pair can only reach the threshold if each side has at most
``n - ceil(0.8 n)`` n-grams that the other lacks, which gives bounds by size:

* Block 1 holds the n-grams whose hash lies in the lowest ``FIRST_BLOCK`` of the hash
  range.  A set with more n-grams of its own there (in no other set) than the bound allows
  has no partner; most documents end here, at one shuffle of 30 % of the n-grams.
* Block 2 holds the other n-grams, of the sets still in, under the same bound.  N-grams of
  one set alone are zero columns of the product and go.
* Columns are then ordered from rare to common.  Partners must share one of the first
  ``n - ceil(0.8 n) + 1`` n-grams of each; those that only this set has come first and use
  up that allowance.  The product of these columns gives the pairs that can link at all: the
  places of the shared n-gram in both orders bound the overlap, and pairs below what their
  sizes ask for are discarded in the join.
* The product goes on for these pairs over ``BLOCKS`` blocks of columns: a cell (pair, n-gram)
  meets the cell of the partner, and overlap counts are summed by pair.  After each block
  pairs go whose count and what both sides have left cannot reach the bound.

Sets with a common n-gram among the first form a bucket.  A bucket is not squared: it is
first multiplied by one row, its centre, the set with the fewest n-grams of its own, as the
centre of copies tends to be.  Links join components, and sets of one component need no more
work with each other, so from then on only sets outside the largest component of their
bucket meet the others (8, 64, 512... of them a round, or all once that is few beside the
incidence itself).  A group of many copies costs a row for each.  Nothing is left out.

Equal sets are one class from the start, so exact copies never meet as pairs.  Classes are
named by 64 bits; names that two sets share are found by a second hash and told apart.

Texts are joined by shuffle at every size, so what is shuffled grows with the input.

Results for odd input: a null or empty text, or one without words, has an empty set and is
linked with nothing; fewer than ``size`` words make one shingle; a null id has no
component_id, but its text links others as any does; rows that share an id are nodes of
their own, whose component_id is the least id among all rows linked; repeated rows are
copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import U64, Words, mix, signed, words_of
from .components import components
from .scratch import COMBINED_ROWS, Scratch, arrow_rows, join_checked

SIZE = 5
#: Share of the hash range in the first block.
FIRST_BLOCK = 0.3
#: Blocks of columns over which overlap counts are accumulated.
BLOCKS = 3
#: Pairs that meet in a round, as a multiple of the rows in buckets.
ROUND_X = 16

_STEPS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | U64(1)


def shingle_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """For each text of the piece its distinct shingles' hashes, sorted."""
    h, before = w.hashes, w.before
    n = len(h) - size + 1
    grams = np.zeros(max(n, 0), U64)
    for j in range(size if n > 0 else 0):
        grams += h[j : j + n] * _STEPS[j]
    grams = mix(grams)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield mix(np.sum(h[a:b] * _STEPS[: b - a], keepdims=True) + np.full(1, b - a, U64) * _STEPS[63])
        else:
            yield grams[:0]


def set_name(s: np.ndarray) -> int:
    """One 64-bit name for a set of shingles."""
    return int(signed(mix(np.sum(mix(s), keepdims=True) * U64(2) + U64(len(s))))[0])


def second_name(s: np.ndarray) -> int:
    """Another one, to tell sets apart that share the first."""
    return int(signed(mix(np.sum(mix(s ^ U64(0xA0761D6478BD642F)), keepdims=True) * U64(6) + U64(len(s))))[0])


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in words_of(batch.column(1), True):
                n, names, seconds = [], [], []
                for s in shingle_sets(w, size):
                    n.append(len(s))
                    names.append(set_name(s) if len(s) else None)
                    seconds.append(second_name(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(seconds, pa.int64())], ["id", "row", "n", "c", "d"])

    return run


def _first_block(size: int, share: float):
    top = U64(int(share * 2**64) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: set[int] = set()  # sets of this batch: copies add nothing
            for _, _, w in words_of(batch.column(0), True):
                grams, names = [], []
                for s in shingle_sets(w, size):
                    if not len(s) or (c := set_name(s)) in done:
                        continue
                    done.add(c)
                    k = int(np.searchsorted(s, top, "right"))
                    grams.append(s[:k])
                    names.append(np.full(k, c, np.int64))
                if not grams:
                    continue
                g, c = np.concatenate(grams), np.concatenate(names)
                order = np.argsort(g, kind="stable")
                g, c = g[order], c[order]
                head = np.ones(len(g), bool)
                head[1:] = g[1:] != g[:-1]
                at = np.flatnonzero(head)
                if not len(at):
                    continue
                count = np.diff(np.append(at, len(g)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(g[at])), pa.array(c[at]), pa.array(count > 1)], ["g", "c", "many"])

    return run


def _whole_sets(size: int):
    """(text, class) -> the sets of the classes, once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, done = batch.column(1).to_numpy(), set()
            for lo, hi, w in words_of(batch.column(0), True):
                rows = []
                for c, s in zip(want[lo:hi].tolist(), shingle_sets(w, size), strict=True):
                    if c not in done:
                        done.add(c)
                        rows.append((c, s))
                if rows:
                    ends = np.cumsum([0, *(len(s) for _, s in rows)]).astype(np.int32)
                    grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate([s for _, s in rows]))))
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array(np.diff(ends).astype(np.int64)), grams], ["c", "n", "grams"])

    return run


def _allowed(n):
    """N-grams of a set of n that a partner may lack: n - ceil(0.8 n)."""
    return n - F.ceil(n * 4 / 5).cast("long")


def _block(grams, b: int):
    """The n-grams of one block of columns."""
    return F.filter(grams, lambda g: F.pmod(g, F.lit(BLOCKS)) == b)


def _named_sets(docs: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """(id, row, n, c): for each row its set's size and class."""
    sets = scratch.save(docs.select("id", "text", "row").mapInArrow(_sets(size), "id long, row long, n long, c long, d long"))
    twins = scratch.save(sets.where("c is not null").groupBy("c").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("c", F.lit(True).alias("twin")))
    if not twins.isEmpty():
        sets = join_checked(sets, twins, "c", "left").withColumn("c", F.when(F.col("twin"), F.xxhash64("c", "d")).otherwise(F.col("c")))
    return sets.select("id", "row", "n", "c")


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, n_shingles, set_id, component_id), one row for each of df."""
    spark = df.sparkSession
    arrow_rows(spark, COMBINED_ROWS)
    scratch = Scratch(spark, "jaccard")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("row", F.xxhash64(F.col("id").isNull(), "id", "text"))
    sets = _named_sets(docs, size, scratch)

    # classes, with one row that has each; block 1
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("row")
    classes = scratch.save(sets.where("c is not null").groupBy("c").agg(first, F.min("id").alias("least"), F.first("n").alias("n")))
    rows = docs.select("text").mapInArrow(_first_block(size, FIRST_BLOCK), "g long, c long, many boolean").repartition("g")
    single = rows.groupBy("g").agg(F.min("c").alias("c"), F.max("c").alias("d"), F.max("many").alias("many")).where("c = d and not many")
    own = single.groupBy("c").agg(F.count("*").alias("own"))
    left = classes.join(own.hint("merge"), "c", "left").where(F.coalesce("own", F.lit(0)) <= _allowed(F.col("n"))).select("c", "row")
    left = scratch.save(left)

    # block 2: whole sets of those left, the n-grams that no other of them has
    texts = docs.join(left.hint("merge"), "row").select("text", "c")
    whole = scratch.save(texts.mapInArrow(_whole_sets(size), "c long, n long, grams array<long>"))
    repeated = scratch.save(whole.groupBy("c").count().where("count > 1").select("c"))
    if not repeated.isEmpty():  # repeated rows that came in several batches
        whole = whole.join(repeated, "c", "left_anti").union(whole.join(repeated, "c").dropDuplicates(["c"]))
    cells = whole.select("c", F.explode("grams").alias("g"))
    shared = scratch.save(cells.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"))
    common = cells.join(shared.hint("merge"), "g").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("cols"))
    common = whole.select("c", "n").join(common, "c").withColumn("own", F.col("n") - F.size("cols")).where(F.col("own") <= _allowed(F.col("n")))
    common = scratch.save(
        common.select(
            "c", "n", "own",
            F.slice(F.col("cols.g"), F.lit(1), (_allowed(F.col("n")) + 1 - F.col("own")).cast("int")).alias("prefix"),
            *(_block(F.col("cols.g"), b).alias(f"block_{b}") for b in range(BLOCKS)),
        )
    )
    for t in (left, whole, shared):
        scratch.drop(t)

    label = _bucket_labels(common, scratch)
    scratch.drop(common)
    named = classes.select("c", "least").join(label.withColumnRenamed("node", "c").hint("merge"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = scratch.save(named.join(least, "label").select("c", "component_id"))
    scratch.drop(classes)
    out = join_checked(sets, named, "c", "left")
    own_id = F.when(F.col("id").isNotNull(), F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select("id", F.col("n").alias("n_shingles"), F.col("c").alias("set_id"), own_id.alias("component_id"))


def multiplied(pairs: DataFrame, common: DataFrame) -> DataFrame:
    """Pairs (c, u) -> links (u, v): the product of their rows, over blocks of columns.

    A pair stays in as long as its count and what the side with less has left can reach the
    overlap that both sizes ask for: 9 * overlap >= 4 * (n + un)."""
    sizes = [F.size(f"block_{b}") for b in range(BLOCKS)]
    after = [sum(sizes[b + 1 :], F.lit(0)) for b in range(BLOCKS)]
    met = pairs.select("c", "u", F.lit(0).cast("long").alias("count"))
    centres = common.join(pairs.select(F.col("u").alias("c")).distinct(), "c", "left_semi")
    for b in range(BLOCKS):
        # the sides of these joins grow with the input, so they are shuffled at every size
        mine = common.select("c", "n", after[b].alias("rest"), f"block_{b}")
        cells = met.join(mine.hint("merge"), "c").select("c", "u", "count", "n", "rest", F.explode_outer(f"block_{b}").alias("g"))
        theirs = centres.select(F.col("c").alias("u"), F.explode(f"block_{b}").alias("g"), F.lit(1).alias("one"))
        summed = cells.join(theirs.hint("merge"), ["u", "g"], "left").groupBy("c", "u", "count", "n", "rest").agg((F.col("count") + F.count("one")).alias("upto"))
        other = centres.select(F.col("c").alias("u"), F.col("n").alias("un"), after[b].alias("urest"))
        met = summed.join(other.hint("merge"), "u").where("9 * (upto + least(rest, urest)) >= 4 * (n + un)").select("c", "u", F.col("upto").alias("count"))
    return met.select(F.col("c").alias("u"), F.col("u").alias("v"))


def _bucket_labels(common: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): components of the sets by links, found until no pair is open."""
    spark = common.sparkSession
    links = spark.createDataFrame([], "u long, v long")
    members = common.select("c", "n", "own", F.posexplode("prefix").alias("at", "g")).withColumn("left", F.col("n") - F.col("own") - F.col("at"))
    several = members.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g")
    open_ = scratch.save(members.join(several.hint("merge"), "g").select("g", "c", "n", "own", "left", F.col("c").alias("label")))
    cells = open_.count()
    # inside a component nothing is open; and if this is the first n-gram that a pair shares, it
    # shares no more than what either side has from here on, which must reach the bound
    can_link = "label != ul and least(left, uleft) * 9 >= (n + un) * 4"
    upto, label = 0, spark.createDataFrame([], "node long, label long")
    while cells:
        if not upto:
            best = open_.groupBy("g").agg(F.min(F.struct("own", "c", "n", "label", "left")).alias("m"))
            turn = best.select("g", F.col("m.c").alias("u"), F.col("m.n").alias("un"), F.col("m.label").alias("ul"), F.col("m.left").alias("uleft"))
            pairs = open_.join(turn.hint("merge"), "g").where("c != u").where(can_link)
            upto, over = 1, None
        else:
            # sets outside the largest component of a bucket, in a fixed order that a hash gives
            groups = open_.groupBy("g", "label").agg(F.count("*").alias("k")).groupBy("g").agg(F.max_by("label", F.struct("k", "label")).alias("top"), F.sum("k").alias("k"), F.max("k").alias("most"))
            groups = scratch.save(groups.where("k > most"))
            work = groups.agg(F.sum(F.col("k").cast("double") * (F.col("k") - F.col("most")))).first()[0] or 0.0
            upto *= 8
            all_ = work <= ROUND_X * cells
            place = F.pmod(F.xxhash64("c", "g"), F.lit(1 << 30)) / float(1 << 30) * (F.col("k") - F.col("most"))
            marked = open_.join(groups.hint("merge"), "g").withColumn("turn", (F.col("label") != F.col("top")) & (F.lit(all_) | (place < upto)))
            marked = scratch.save(marked.select("g", "c", "n", "own", "left", "label", "turn"), cells)
            turn = marked.where("turn").select("g", F.col("c").alias("u"), F.col("n").alias("un"), F.col("label").alias("ul"), F.col("left").alias("uleft"))
            # those that have their turn meet all, each other once
            pairs = marked.join(turn.hint("merge"), "g").where((~F.col("turn") | (F.col("c") < F.col("u")))).where(can_link)
            scratch.drop(open_)
            open_, over = marked.drop("turn"), marked
        pairs = scratch.save(pairs.select("c", "u").distinct(), cells)
        found = scratch.save(multiplied(pairs, common), cells)
        links = scratch.save(links.union(found), cells)
        scratch.drop(pairs)
        scratch.drop(found)
        label = scratch.save(components(links, scratch), cells)
        rest = open_ if over is None else over.where("not turn").drop("turn")
        rest = rest.drop("label").join(label.withColumnRenamed("node", "c").hint("merge"), "c", "left").withColumn("label", F.coalesce("label", "c"))
        rest = scratch.save(rest.select("g", "c", "n", "own", "left", "label"), cells)
        apart = rest.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("g")
        kept = scratch.save(rest.join(apart.hint("merge"), "g").select("g", "c", "n", "own", "left", "label"), cells)
        for t in (rest, over or open_):
            scratch.drop(t)
        open_ = kept
        if open_.isEmpty():
            break
        scratch.drop(label)
    return label


def op1_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = similar_components(docs)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
