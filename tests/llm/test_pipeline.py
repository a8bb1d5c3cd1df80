"""Each stage of the pipeline against a plain version, on what the stage before kept."""

import os

import brute
import pytest

import corpus_pipeline
from talegraph.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not there")
def test_stages(spark):
    scratch = Scratch(spark, "test-pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    def texts(df):
        return {r.doc_id: r.text for r in df.collect()}

    before = texts(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.save(stage(spark, docs, SF))
        if name == "mix":
            break
        assert out.columns == columns
        after = texts(out)
        pairs = list(before.items())
        if name == "quality":
            assert after.items() <= before.items()
            wrong = [i for i in before if i in labels and (i in after) != (labels[i] == 1)]
            assert len(wrong) <= 0.05 * len(labels)
        elif name == "lines":
            want = {i: (n, gone, kept) for i, (n, gone, kept) in brute.lines(pairs).items()}
            for i, (_, gone, kept) in want.items():
                if i in after:
                    assert brute.digest(after[i]) == kept
                else:
                    assert gone and not brute.WORD.search("\n".join(brute.left_lines(pairs)[i]))
        elif name == "near_duplicates":
            assert after == {i: before[i] for i, (_, c) in brute.jaccard(pairs).items() if i == c}
        elif name == "decontaminate":
            hit = brute.contamination(pairs, bench)
            assert after == {i: t for i, t in before.items() if not hit[i][4]}
        docs, before = out, after
    rows = out.collect()
    assert {r.doc_id: r["size"] for r in rows} == {i: len(brute.WORD.findall(t)) for i, t in before.items()}
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)


def test_near_duplicates_by_row(spark):
    text = " ".join(f"word{i}" for i in range(60))
    near, other, lone = text + " more", " ".join(f"other{i}" for i in range(60)), " ".join(f"lone{i}" for i in range(60))
    rows = [
        (1, text, "a"), (1, text, "a"),  # repeated rows: one stays
        (5, near, "b"), (5, lone, "b"),  # an id with a copy of 1 and a clean text: the clean row stays
        (None, other, "c"), (None, other + " more", "d"), (None, other, "c"),  # copies among null ids: one stays
        (None, near, "e"),  # a copy of 1
        (8, None, "f"), (None, "", "g"), (None, "", "g"),  # without words: all stay
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(r for r in left if r[0] is not None and r[1]) == [(1, text, "a"), (5, lone, "b")]
    assert [r[2] for r in left if r[0] is None and r[1]] in (["c"], ["d"])
    assert sorted(r[2] for r in left if not r[1]) == ["f", "g", "g"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null and repeated ids, extra columns whose names clash: no crash, and all columns come back."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, doc string, carry_0 string"
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rest = (None, None, None, "x", "y", "z", "c")
    for rows in ([], [(None, None, *rest), (None, "", *rest), (7, "a b c", *rest), (7, "a b c", *rest), (7, "other text", *rest)]):
        docs = spark.createDataFrame(rows, columns)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= len(rows)
            if name != "mix":
                assert out.columns == docs.columns
