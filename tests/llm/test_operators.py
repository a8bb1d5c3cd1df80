"""Each operator against a plain version, and on odd input."""

import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talegraph.llm import op1_jaccard, op2_suffix_array, op3_quality, op4_decontaminate, op5_substring, op6_mix, op7_lm, op8_lines, op9_secrets, op10_embeddings
from talegraph.llm.hnsw import Graph

SCHEMA = "doc_id long, text string, id string, doc string, source string, n_chars long"


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", None, s, None) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(300)] + ["añejo", "straße", "日本"]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n"]) for _ in range(n))

    shared, passage = prose(130), prose(60)
    docs = []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            t = prose(120)
        elif kind == 1:
            t = prose(30) + " " + passage + " " + prose(30)
        elif kind == 2:
            w = shared.split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif kind == 3:
            t = docs[rng.randrange(len(docs))][1]
        elif kind == 4:
            t = passage + " " + prose(5) + " " + passage
        else:
            t = "a\nb b\nc\n" + prose(20) + "\na\nb b\nc"
        docs.append((i, t))
    docs += [(60, None), (61, ""), (62, " \t\n"), (63, "one two"), (64, "One TWO"), (65, "x" * 250), (66, "x" * 250), (67, "é" * 99), (68, "AKIA" + "Q" * 16)]
    docs.append((69, " ".join(["tic"] * 5000)))
    return docs


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return table(spark, [(i, t, "s%d" % (i % 3)) for i, t in corpus]).repartition(5).cache()


def got(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select(*cols).collect()}


def test_jaccard(docs, corpus):
    out = got(op1_jaccard.similar_components(docs), "id", "n_shingles", "component_id")
    assert out == brute.jaccard(corpus)


def test_jaccard_by_rounds(docs, corpus, monkeypatch):
    monkeypatch.setattr(op1_jaccard, "ROUND_X", 0)
    assert got(op1_jaccard.similar_components(docs), "id", "n_shingles", "component_id") == brute.jaccard(corpus)


def test_suffixes(docs, corpus):
    out = op2_suffix_array.dedup_suffixes(docs)
    assert got(out, "id", "n_units", "n_removed", F.size("spans"), F.sha2("kept", 256)) == brute.suffixes(corpus)


def test_substrings(docs, corpus):
    out = op5_substring.dedup_substrings(docs)
    assert got(out, "id", "n_units", "n_removed", F.sha2("kept", 256)) == brute.substrings(corpus)


def test_lines(docs, corpus):
    out = op8_lines.dedup_lines(docs)
    assert got(out, "id", "n_lines", "n_removed", F.sha2("kept", 256)) == brute.lines(corpus)


@pytest.mark.parametrize("index_bytes", [1 << 24, 0])
def test_decontamination(spark, docs, corpus, index_bytes):
    bench = [(1, " ".join(corpus[1][1].split()[20:60])), (2, "tic tic tic"), (3, None), (4, ""), (10, "never seen in any text at all or so we hope it is"), (2, "one TWO")]
    df = spark.createDataFrame(bench, "item_id long, text string")
    out = op4_decontaminate.contaminated(docs, df, index_bytes=index_bytes)
    cols = ["id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0]
    assert got(out, *cols) == brute.contamination(corpus, bench)


def test_mix(docs, corpus):
    rows = op6_mix.mix_sources(docs).collect()
    sizes = {i: len(brute.WORD.findall(t or "")) for i, t in corpus}
    assert {r.id: r["size"] for r in rows} == sizes
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(sizes.values())) < 1e-6
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine)
    again = {r.id: r.taken for r in op6_mix.mix_sources(docs.repartition(3)).collect()}
    assert again == {r.id: r.taken for r in rows}


def test_language_model(docs, corpus):
    out = {r.id: r for r in op7_lm.score_texts(docs).collect()}
    tokens = {i: [*brute.WORD.findall(brute.lower(t)), "\0"] for i, t in corpus}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(ws), sum(w in counts for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_class_model_by_brute_force(docs, corpus, monkeypatch):
    """The score, from the classes that were learned and counts taken by hand."""
    learned = []
    train = op7_lm.train_model
    monkeypatch.setattr(op7_lm, "train_model", lambda *args: learned.append(train(*args)) or learned[0])
    out = {r.id: r.score for r in op7_lm.score_texts(docs, min_count=3).collect()}
    m = learned[0]
    rows = {}
    for i, t in corpus:
        data = np.frombuffer((t or "").encode(), np.uint8)
        tokens, kind, _ = op7_lm.with_ends(op7_lm.Words(data, np.array([0, len(data)]), True))
        rows[i] = list(zip(tokens.tolist(), kind.tolist(), m.classes.of(tokens, kind + 1).tolist()))
    taught = [r for i, r in rows.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    size = len(m.step)
    words, pairs, shape = Counter(), Counter(), {}
    for r in taught:
        before = 0
        for h, k, c in r:
            words[h] += 1
            shape[h] = k
            pairs[before, c] += 1
            before = c
    assert any(c > op7_lm.SHAPES for r in taught for _, _, c in r)
    head = {h for h, n in words.items() if n >= 3 and h != op7_lm.END}
    of = {h: c for r in taught for h, _, c in r}
    members, mass, kinds = Counter(), Counter(), Counter()
    for h, n in words.items():
        if h in head:
            members[of[h]] += n
        elif h != op7_lm.END:
            mass[shape[h]] += n
            kinds[shape[h]] += 1
    total = sum(pairs.values())
    into, from_ = Counter(), Counter()
    for (a, b), n in pairs.items():
        into[b] += n
        from_[a] += n
    for i, r in rows.items():
        want, before = 0.0, 0
        for h, k, c in r:
            want += math.log10((pairs[before, c] + op7_lm.SMOOTH * (into[c] + 0.5) / (total + 0.5 * size)) / (from_[before] + op7_lm.SMOOTH))
            if h in head:
                want += math.log10(words[h] / members[c])
            elif h != op7_lm.END:
                want += math.log10((words[h] + 0.5) / (mass[k] + 0.5 * (kinds[k] + 1)))
            before = c
        assert math.isclose(out[i], want, rel_tol=1e-9)


def test_language_model_at_the_edges(spark, docs, corpus):
    held = [(i, "some words of no training", None) for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = op7_lm.score_texts(table(spark, held)).collect()
    assert len(rows) == len(held) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and r.base_score == 0 for r in rows)
    many = " ".join(f"once{i}" for i in range(30_000))  # a very long text, no word of which is frequent
    (row,) = op7_lm.score_texts(table(spark, [(None, many, None)])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (30_001, 30_001, 30_001) and math.isfinite(row.score)
    counts = spark.createDataFrame([(h, 1, 20) for h in range(-500, 500)] + [(int(op7_lm.END), -1, 1)], "h long, shape int, n long")
    kept = [r.h for r in op7_lm.head_words(counts, 16, 100).collect()]
    assert int(op7_lm.END) in kept  # ties past the bound are drawn by hash


def test_exchange_mends_classes():
    """A local search: from a start that is mostly right it finds the classes that alternate."""
    rng = np.random.default_rng(0)
    counts = np.zeros((20, 20))
    for _ in range(4000):  # even units follow odd ones and the other way round
        a = rng.integers(20)
        counts[a, 2 * rng.integers(10) + (1 - a % 2)] += 1
    first = np.arange(20) % 2
    first[[0, 3, 8, 13]] ^= 1
    label = op7_lm.exchange(counts, np.arange(20), first, 2)
    assert label.tolist() == (np.arange(20) % 2).tolist()


def test_quality_learns_a_rule(spark):
    rows = [(i, ("word%d and other things here. " % i) * 8 if i % 3 else "NOISE NOISE NOISE !!! " * 12, "s") for i in range(240)] + [(900, None, None), (901, "", None)]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(240)] + [(None, 1), (1, None)], "doc_id long, quality int")
    out = {r.id: r for r in op3_quality.quality_scores(table(spark, rows), labels).collect()}
    assert len(out) == 242
    held = [r for i, r in out.items() if r.held_out and i < 900]
    assert held and all(r.predicted == (1 if r.id % 3 else 0) for r in held)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in op3_quality.quality_scores(docs, none).collect()} == {0.5}


def test_secrets(spark):
    rng = random.Random(1)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(4000))
    rows = [(i, f"some words añ here password={hexes[i * 18:i * 18 + 18]} and more words follow", "s") for i in range(150)]
    rows += [(i, "nothing to see in this plain text of words", "s") for i in range(150, 260)]
    rows += [(300, "secret: token: abcdef", "s"), (301, "AKIA123 AKIA" + "Z" * 16 + " Token = 'abc.def-1'", "s"), (302, None, "s"), (303, "f" * 24 + " " + "e" * 23, "s")]
    out = {r.id: [tuple(s) for s in r.spans] for r in op9_secrets.secret_spans(table(spark, rows)).collect()}
    assert out[0] == [("assign", 19, 46)]
    assert [s for s in out[300] if s[0] != "crf"] == []
    assert [s for s in out[301] if s[0] != "crf"] == [("access", 8, 28), ("assign", 29, 47)]
    assert [s for s in out[303] if s[0] != "crf"] == [("hex", 0, 24)] and out[302] == []
    assert not any(out[i] for i in range(150, 260))


def test_chain_finds_secrets_of_no_base_pattern(spark):
    """Learned from one set of keywords, it finds values behind words that no base pattern knows."""
    rng = random.Random(8)
    chars = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    prose = ["river", "stone", "walked", "under", "the", "old", "bridge", "and", "saw", "light", "on", "water"]

    def words(n):
        return " ".join(rng.choice(prose) for _ in range(n))

    def value():
        return "".join(rng.choice(chars) for _ in range(22)) + "7Q"

    rows = [(i, f"{words(12)} password: {value()} {words(12)}", "s") for i in range(160)] + [(i, words(30), "s") for i in range(200, 400)]
    unseen = {}
    for i in range(500, 560):
        before, secret = words(9), value()
        unseen[i] = (len(before) + len(" credential: "), len(before) + len(" credential: ") + len(secret))
        rows.append((i, f"{before} credential: {secret} {words(9)}", "s"))
    out = {r.id: [(s.start, s.end) for s in r.spans if s.kind == "crf"] for r in op9_secrets.secret_spans(table(spark, rows)).collect()}
    found = sum(any(a <= s and e <= b for a, b in out[i]) for i, (s, e) in unseen.items())
    added = sum(len(v) for v in out.values())
    assert found >= 0.9 * len(unseen)  # recall
    assert added <= found / 0.9  # precision


def test_viterbi_is_exact():
    rng = np.random.default_rng(2)
    crf = op9_secrets.Crf()
    crf.w = rng.normal(size=crf.w.shape)
    crf.move = rng.normal(size=(3, 3))
    x = np.stack([rng.integers(0, n, 9) for n in op9_secrets.TABLES], axis=1)
    e = crf.scores(x)
    best = max(np.ndindex(*([3] * 9)), key=lambda t: sum(e[i, t[i]] for i in range(9)) + sum(crf.move[t[i], t[i + 1]] for i in range(8)))
    assert tuple(crf.decode(x, np.array([0, 9]))) == best


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x[100:160] = x[100] + rng.normal(scale=0.1, size=(60, 16))
    x[200:210] = x[200]
    rows = [(i, v.tolist(), None) for i, v in enumerate(x)] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, [], 1), (505, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, k int")
    out = {r.id: r for r in op10_embeddings.near_vectors(df, shards=3).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    found = sum(out[i].n_links for i in range(400))
    assert 0.95 * (near.sum() - 400) <= found <= near.sum() - 400
    assert all(out[i].component_id == 200 for i in range(200, 210))
    assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in range(500, 506))


def test_audit_counts_real_pairs_of_other_shards():
    """Five nodes that no link leads to: their copies, in other shards, are missed until the beam is the whole shard."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 16))
    shard = pa.table({"k": pa.array(np.arange(1000)), "times": pa.array(np.ones(1000, np.int64)), "v": pa.array(x.tolist())})
    built = op10_embeddings._build(0.9)((pa.scalar(0), pa.scalar(16)), shard)
    g = Graph.load(built["graph"][0].as_py())
    lost = np.arange(995, 1000)
    for layer in g.layers:
        layer.near[np.isin(layer.near, lost)] = -1
    cut = built.set_column(built.schema.get_field_index("graph"), "graph", pa.array([g.dump()], pa.binary()))
    copies = g.x[lost] + rng.normal(scale=0.01, size=(5, 16))
    own = pa.table({"k": pa.array(np.arange(900)), "v": pa.array(x[:900].tolist())})
    others = pa.concat_tables([own, pa.table({"k": pa.array(np.arange(5000, 5005)), "v": pa.array(copies.tolist())})])
    audit = op10_embeddings._audit(0.9, 0.99)
    assert audit(others, cut)["beam"].to_pylist() == [1000]
    assert audit(others, built)["beam"].to_pylist()[0] < 1000


def test_empty_tables(spark):
    e = table(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        op1_jaccard.similar_components(e), op2_suffix_array.dedup_suffixes(e), op3_quality.quality_scores(e, labels), op4_decontaminate.contaminated(e, bench), op5_substring.dedup_substrings(e),
        op6_mix.mix_sources(e), op7_lm.score_texts(e), op8_lines.dedup_lines(e), op9_secrets.secret_spans(e), op10_embeddings.near_vectors(vectors),
    ):
        assert df.count() == 0


def test_null_and_repeated_ids(spark):
    long = " ".join("t%d" % i for i in range(80))
    rows = [(None, long, None), (None, long, None), (7, long, None), (7, long, None), (None, None, None)]
    df = table(spark, rows)
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    for out in (
        op1_jaccard.similar_components(df), op2_suffix_array.dedup_suffixes(df), op3_quality.quality_scores(df, labels), op4_decontaminate.contaminated(df, bench), op5_substring.dedup_substrings(df),
        op6_mix.mix_sources(df), op7_lm.score_texts(df), op8_lines.dedup_lines(df), op9_secrets.secret_spans(df),
    ):
        assert out.count() == 5
    removed = [(r.id, r.n_removed) for r in op5_substring.dedup_substrings(df).collect()]
    assert sorted(removed, key=str) == [(7, 0), (7, 0), (None, 0), (None, 80), (None, 80)]
    assert {r.component_id for r in op1_jaccard.similar_components(df).where("id is not null").collect()} == {7}


def test_null_ids_carry_links_and_come_last(spark):
    base = " ".join(f"word{i}" for i in range(100))
    w = base.split()
    near = " ".join([*w[:2], "changed", *w[3:]])  # linked to base
    far = " ".join([*w[:2], "changed", *w[3:90], "too", *w[91:]])  # to near
    rows = [(1, base, None), (None, near, None), (3, far, None), (4, "other words", None)]
    out = {r.id: r.component_id for r in op1_jaccard.similar_components(table(spark, rows)).collect() if r.id is not None}
    assert out == {1: 1, 3: 1, 4: 4}
    last = (1 << 63) - 1  # an id of its own, before a null one
    both = op5_substring.dedup_substrings(table(spark, [(last, base, None), (None, base, None), (None, base, None)]))
    assert sorted((r.id is None, r.n_removed) for r in both.collect()) == [(False, 0), (True, 100), (True, 100)]
    text = "\n".join(w[:20])
    both = op8_lines.dedup_lines(table(spark, [(last, text, None), (None, text, None)]))
    assert sorted((r.id is None, r.n_removed) for r in both.collect()) == [(False, 0), (True, 20)]
    both = op2_suffix_array.dedup_suffixes(table(spark, [(last, base, None), (None, base, None)]))
    assert sorted((r.id is None, r.n_removed) for r in both.collect()) == [(False, 0), (True, len(base))]


def test_very_long_texts(spark):
    rng = random.Random(6)
    passage = " ".join("p%d" % rng.randrange(10**6) for _ in range(200))
    long = " ".join("w%d" % rng.randrange(10**5) for _ in range(300_000)) + " " + passage  # over two pieces
    rows = [(1, passage, None), (2, long, None)]
    df = table(spark, rows)
    assert got(op5_substring.dedup_substrings(df), "id", "n_removed")[2] == (200,)
    assert got(op2_suffix_array.dedup_suffixes(df), "id", "n_removed")[2][0] >= len(passage)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert got(op4_decontaminate.contaminated(df, bench), "id", "n_hit") == {1: (200,), 2: (200,)}
    assert got(op1_jaccard.similar_components(df), "id", "component_id") == {1: (1,), 2: (2,)}


def test_exact_share_of_a_sample():
    from pyspark.sql import functions as F

    from talegraph.llm.scratch import drawn

    assert "true" in str(drawn(F.lit(1), 10, 10, 1))
    assert str((20_000 << 64) // (4 * 10**10) - (1 << 63)) in str(drawn(F.lit(1), 20_000, 4 * 10**10, 1))
