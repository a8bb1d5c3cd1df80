"""Quality classifier: a sparse ensemble of rules over text statistics.

Method: statistics of each whole text (sizes, ratios of character classes, repetition) are
taken in one pass.  On a bounded sample of labelled rows a small random forest is grown;
each path from a root to a node is a rule, a conjunction of thresholds.  A logistic
regression with a lasso penalty weighs the rules, most fall to zero, and those left are
compiled into one Spark column expression, so scoring is a projection.

The sample is all labelled rows up to ``SAMPLE_ROWS``; beyond that, those whose id's hash is
below the share that gives this number (an id with many rows is in with all or none).  Ids
are counted and drawn first, so only the texts drawn are read to learn, and every text is
then measured and scored in one pass in which nothing is written.

Results for odd input: a null text counts as empty and is scored like any other; a null id
is never learned from and is not held out; several labels of one id count as the least;
null labels are left out; without labels the score is 0.5, with one class only its rate;
repeated rows are scored alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import Words, pieces
from .scratch import TEXT_ROWS, Scratch, arrow_rows, drawn, join_checked

SAMPLE_ROWS = 20_000
TREES, DEPTH = 24, 3
LASSO = 1e-3
CUT = 0.7

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "symbols", "pipes", "wide", "stops",
    "words_again", "words_new", "top_word", "line_words", "lines_again", "upper_words", "long_words", "marked_words",
)


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _class("0123456789")
_MARK = _class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SYMBOL = _class("#$%&*+/<=>@\\^_`{|}~")
_WIDE = np.arange(256) >= 128


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a piece."""
    w = Words(data, offsets, True)
    size, n = np.diff(offsets).astype(np.float64), w.counts().astype(np.float64)
    some, any_n = np.maximum(size, 1), np.maximum(n, 1)
    upper, lower = _sums(_UPPER[data], offsets), _sums(_LOWER[data], offsets)
    wide = _sums(_WIDE[data], offsets)
    again = np.zeros(len(w.hashes), bool)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    length = w.ends - w.starts
    last = data[w.ends - 1] if len(w.ends) else data[:0]
    new, top, line_new = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    text = data.tobytes()
    lines = np.ones(len(n))
    for i in range(len(n)):
        if n[i]:
            _, counts = np.unique(w.hashes[w.before[i] : w.before[i + 1]], return_counts=True)
            new[i], top[i] = len(counts), counts.max()
            parts = text[offsets[i] : offsets[i + 1]].split(b"\n")
            lines[i], line_new[i] = len(parts), len(set(parts))
    all_upper = np.zeros(len(w.hashes), bool)
    if len(w.hashes):
        ups, lows = (np.concatenate([[0], np.cumsum(c[data])]) for c in (_UPPER, _LOWER))
        all_upper = (ups[w.ends] - ups[w.starts] >= 2) & (lows[w.ends] == lows[w.starts])
    cols = [
        np.log1p(size), np.log1p(n), _sums(length, w.before) / any_n, upper / np.maximum(upper + lower, 1),
        _sums(_DIGIT[data], offsets) / some, _sums(_MARK[data], offsets) / some, _sums(_SYMBOL[data], offsets) / some,
        _sums(data == ord("|"), offsets) / some, wide / some, _sums(data == ord("."), offsets) / any_n,
        _sums(again, w.before) / any_n, new / any_n, top / any_n, n / lines, 1 - line_new / lines,
        _sums(all_upper, w.before) / any_n, _sums(length > 24, w.before) / any_n, _sums(_SYMBOL[last] | (last == ord("!")), w.before) / any_n,
    ]
    return np.stack(cols, axis=1)


def _measure(carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(0)):
                x = statistics(data, offsets)
                rest = [batch.column(i + 1).slice(lo, hi - lo) for i in range(carried)]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c) for c in x.T)], [*batch.schema.names[1:], *STATISTICS])

    return run


def _measured_columns(docs: DataFrame) -> str:
    kinds = (f"`{c}` {kind}" for c, kind in docs.drop("text").dtypes)
    return ", ".join([*kinds, *(f"{c} double" for c in STATISTICS)])


Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(model) -> list[Rule]:
    """Paths to all nodes of the forest, as sorted conditions (statistic, above, threshold)."""
    found: set[Rule] = set()

    def walk(node, path: Rule) -> None:
        if path:
            found.add(tuple(sorted(set(path))))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            at, cut = split.featureIndex(), split.threshold()
            walk(node.leftChild(), (*path, (at, False, cut)))
            walk(node.rightChild(), (*path, (at, True, cut)))

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), ())
    return sorted(found)


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for at, above, cut in rule:
        c = F.col(STATISTICS[at])
        out = out & ((c > cut) if above else (c <= cut))
    return out


def score_column(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The probability of label 1."""
    total = F.lit(float(intercept))
    for rule, weight in rules:
        total = total + F.when(rule_column(rule), F.lit(float(weight))).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit_rules(sample: DataFrame) -> tuple[list[tuple[Rule, float]], float]:
    """sample: STATISTICS and label (double) -> weighted rules and intercept."""
    rates = sample.agg(F.count("*"), F.avg("label")).first()
    if not rates[0] or rates[1] in (0.0, 1.0):
        rate = 0.5 if not rates[0] else min(max(rates[1], 1e-4), 1 - 1e-4)
        return [], float(np.log(rate / (1 - rate)))
    x = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(sample)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.7, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=7).fit(x)
    rules = tree_rules(forest)
    if not rules:
        return [], float(np.log(rates[1] / (1 - rates[1])))
    named = sample.select("label", *(rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    named = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(named).select("label", "rules").persist()
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(named)
    named.unpersist()
    weights = lasso.coefficients.toArray()
    return [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6], float(lasso.intercept)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, held_out, score, predicted, carry_0...), one row for each of df."""
    scratch = Scratch(df.sparkSession, "quality")
    arrow_rows(df.sparkSession, TEXT_ROWS)
    fold = F.coalesce(F.crc32(F.col("id").cast("string")) % 4, F.lit(0))
    ids = df.select(F.col(id_col).alias("id"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    known = known.where(fold != 2).groupBy("id").agg(F.min("label").alias("label"))
    n = ids.where(fold != 2).join(known, "id").count()
    chosen = scratch.save(known.where(drawn(F.col("id"), sample_rows, n, 3)))
    learn = join_checked(df.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")), chosen, "id").select("text", "id", "label")
    measured = learn.mapInArrow(_measure(2), _measured_columns(learn))
    sample = scratch.save(measured.repartition(6, "id").sortWithinPartitions("id", *STATISTICS).select(*STATISTICS, "label"))
    rules, intercept = fit_rules(sample)
    score = score_column(rules, intercept)
    extra = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    docs = df.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), *extra)
    measured = docs.mapInArrow(_measure(1 + len(carry)), _measured_columns(docs))
    out = measured.select("id", (fold == 2).alias("held_out"), score.alias("score"), *(c for c in measured.columns if c.startswith("carry_")))
    return out.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels).select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")
