"""Hard negatives, shards and the prefix trie against plain versions, and on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from talegraph.llm import op11_negatives, op12_shards, op13_trie

VECTORS = "vec_id long, embedding array<float>, label int, uid string, v int"
TURNS = "conv_id long, turn long, role string, text string, name string, depth int"
DOCS = "doc_id long, text string, p int, shard string"


# --- hard negatives -------------------------------------------------------------------------
def brute_negatives(rows):
    def fit(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    r = []
    for i, (ident, v, label) in enumerate(rows):
        if ident is not None and label is not None and fit(v):
            r.append((i, ident, (label + 1) % 10 if ident % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a in r:
        if a[1] % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[3], b[3], strict=True)), b[1], b[0], b[2]) for b in r if b[0] != a[0] and len(b[3]) == len(a[3]))
        for p in [b for b in scored if b[3] == a[2]][:5]:
            hits = [b for b in scored if b[3] != a[2] and 50 * -p[0] <= 100 * -b[0] <= 95 * -p[0]][:3]
            out += [(a[1], p[1], k + 1, b[1], -p[0], -b[0]) for k, b in enumerate(hits)]
    return sorted(out)


def _vectors(seed, n, dim, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    # coarse steps, so that scores tie
    return [(i, [round(scale * (c + rng.gauss(0, 0.6)) * 4) / 4 for c in centres[rng.randrange(4)]], rng.randrange(3)) for i in range(n)]


def _mined(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(parts)
    out = op11_negatives.hard_negatives(df)
    assert [x.split()[0] for x in out.schema.simpleString()[7:-1].split(",")] == ["anchor_id:bigint", "positive_id:bigint", "rank:int", "negative_id:bigint", "positive_score:bigint", "negative_score:bigint"]
    return sorted(tuple(x) for x in out.collect())


def test_negatives_against_brute_force(spark, monkeypatch):
    rows = _vectors(1, 700, 6)
    assert _mined(spark, rows) == brute_negatives(rows)
    # many blocks of anchors, portions and packed blocks
    for name, size in (("PACK_BYTES", 3000), ("ANCHOR_BYTES", 200), ("PORTION_BYTES", 5000), ("SCORES", 640)):
        monkeypatch.setattr(op11_negatives, name, size)
    assert _mined(spark, rows, 1) == brute_negatives(rows)


def test_negatives_odd(spark):
    rows = _vectors(2, 120, 3)
    rows += [(200, None, 1), (201, [1.0, None, 2.0], 1), (202, [1.0, float("nan"), 2.0], 1), (203, [float("inf"), 0.0, 0.0], 1), (204, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(250, [1.0, 2.0], 1), (251, [1.0, 2.0], 1), (252, [1.0, 1.75], 2), (300, [], 1), (301, [], 2), (350, [0.0, 0.0, 0.0], 2)]
    rows += [rows[50], rows[50], rows[3], rows[4]]  # repeated rows, an anchor among them
    got = _mined(spark, rows)
    assert got == brute_negatives(rows) and any(x[0] == 250 for x in got)
    assert _mined(spark, []) == []


def test_negatives_large_numbers(spark):
    rows = [(i, [x * 2.0**20 for x in v], label) for i, v, label in _vectors(3, 110, 4)]
    assert _mined(spark, rows) == brute_negatives(rows)


# --- shards ---------------------------------------------------------------------------------
def test_hypergeometric(spark):
    for total, good, drawn in ((40, 13, 17), (9, 9, 4), (50, 1, 3), (30, 20, 25), (5, 0, 5), (1, 1, 1), (8, 3, 0)):
        n = 40_000
        x = op12_shards.hypergeometric(F.lit(float(total)), F.lit(float(good)), F.lit(float(drawn)), op12_shards.uniform(F.lit(total), F.col("id")))
        got = {int(r[0]): r[1] for r in spark.range(n).select(x.alias("x")).groupBy("x").count().collect()}
        law = {k: n * math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn) for k in range(max(0, drawn - total + good), min(good, drawn) + 1)}
        assert set(got) <= set(law)
        assert all(abs(got.get(k, 0) - m) < 6 * math.sqrt(m) + 6 for k, m in law.items())


def test_communication_matrix_has_its_sums(spark):
    sizes = [7, 7, 6, 6]
    counts = {0: 5, 1: 9, 3: 0, 5: 12}
    scratch = op12_shards.Scratch(spark, "test")
    seen = Counter()
    for seed in range(3):
        rows = op12_shards.communication(spark.createDataFrame(list(counts.items()), "p long, n long"), sizes, seed, scratch).collect()
        got = {r.p: [b - a for a, b in zip([0, *r.upto], r.upto, strict=False)] for r in rows}
        assert {p: sum(x) for p, x in got.items()} == {p: n for p, n in counts.items() if n}
        assert [sum(x) for x in zip(*got.values(), strict=True)] == sizes
        seen[str(got)] += 1
    assert len(seen) > 1


def test_shards(spark, tmp_path):
    rows = [(i, "text %d" % (i % 9) * (i % 50), 1, "x") for i in range(997)] + [(None, None, 1, "x")] * 40 + [(5, "é", 1, "x")] * 5
    spark.createDataFrame(rows, DOCS).repartition(6).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    out = op12_shards.shuffle_shards(df, bucket_rows=10, carry=("p", "shard")).collect()
    assert Counter((r.id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert {r.carry_1 for r in out} == {"x"}
    again = op12_shards.shuffle_shards(df, bucket_rows=10).collect()
    assert sorted(map(str, (r[:5] for r in out))) == sorted(map(str, (r[:5] for r in again)))


def test_shards_are_uniform(spark):
    """Each row is in each shard, and in the first half of it, as often as any other, whatever its partition."""
    df = spark.createDataFrame([(i, "t", 1, "x") for i in range(48)], DOCS).repartitionByRange(5, "doc_id")
    met, low, runs = Counter(), Counter(), 12
    for seed in range(runs):
        for r in op12_shards.shuffle_shards(df, shards=4, seed=seed, bucket_rows=5).collect():
            met[r.id // 12, r.shard] += 1
            low[r.id // 12, r.slot < 6] += 1
    for (_, _), n in met.items():
        assert abs(n - 12 * runs / 4) < 5 * math.sqrt(12 * runs / 4)
    for n in low.values():
        assert abs(n - 12 * runs / 2) < 5 * math.sqrt(12 * runs / 2)


def test_shards_of_few_and_none(spark, tmp_path):
    few = op12_shards.shuffle_shards(spark.createDataFrame([(1, "a", 1, "x"), (2, "b" * 200_000, 1, "x")], DOCS)).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0)]
    none = op12_shards.shuffle_shards(spark.createDataFrame([], DOCS))
    assert none.count() == 0 and none.columns == ["id", "size", "text_crc32", "shard", "slot"]
    df = spark.createDataFrame([(i, "w", 1, "x") for i in range(50)], "doc_id long, text string, p int, own string")
    op12_shards.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and set(df.columns) <= set(back.columns)


# --- prefix trie ----------------------------------------------------------------------------
def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, name, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:])
    nodes = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    kids = Counter(n[:-1] for n in nodes if n)
    out = []
    for n, members in nodes.items():
        below = [(m, x) for m, x in nodes.items() if m[: len(n)] == n]
        saved = sum((len(x) - 1) * len(m[-1][1].split()) for m, x in below if m)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), kids[n], sum(not kids[m] for m, _ in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _talks(seed, n):
    rng = random.Random(seed)
    lines = ["hi", "how are you", "fine thanks a lot", "", "what is new", "nothing much"]
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 4, 6])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(lines[: 2 + t])))
    return rows


def _trie(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], TURNS).repartition(parts)
    return sorted((tuple(r)[:8] for r in op13_trie.prefix_trie(df).collect()), key=str)


def test_trie_against_brute_force(spark):
    rows = _talks(5, 130)
    assert _trie(spark, rows) == brute_trie(rows)


def test_trie_odd(spark, monkeypatch):
    rows = _talks(6, 45) + [(None, 0, "user", "x"), (61, None, None, None), (62, 0, "user", None), (62, 0, "user", None), (63, None, "a", "b"), (63, 3, "a", "b"), (63, 3, "b", "a"), (-7, 1, "u", "negative id")]
    rows += [(80, t, "user", "long %d" % (t % 7)) for t in range(700)] + [(81, t, "user", "long %d" % (t % 7)) for t in range(700)] + [(82, 10**12, "user", "late"), (83, 0, "user", "word " * 60_000)]
    assert _trie(spark, rows) == brute_trie(rows)
    monkeypatch.setattr(op13_trie, "LIST_BITS", 2)  # lists of ends in several parts
    monkeypatch.setattr(op13_trie, "PART_BITS", 3)
    assert _trie(spark, rows) == brute_trie(rows)
    assert _trie(spark, []) == []


def test_trie_finds_colliding_fingerprints(spark, monkeypatch):
    """With bases that lose the order of turns the groups are mixed; the next attempt has others."""
    true, tried = op13_trie._bases, []

    def bases(attempt):
        tried.append(attempt)
        return [1] * 4 if attempt == 0 else true(attempt)

    monkeypatch.setattr(op13_trie, "_bases", bases)
    rows = [(c, t, "u", x) for c, talk in ((20, "ab"), (40, "ba"), (60, "abc"), (80, "bac"), (100, "c")) for t, x in enumerate(talk)]
    assert _trie(spark, rows) == brute_trie(rows) and max(tried) == 1


def test_trie_verifies_names(spark):
    scratch = op13_trie.Scratch(spark, "test")
    turns = spark.createDataFrame([("n",), ("n",), ("m",)], "name string")
    same = spark.createDataFrame([("n", "u", "a"), ("n", "u", "a"), ("m", "u", "b")], "name string, role string, text string")
    other = spark.createDataFrame([("n", "u", "a"), ("n", "v", "a"), ("m", "u", "b")], "name string, role string, text string")
    assert op13_trie._names_hold(turns, same, scratch) and not op13_trie._names_hold(turns, other, scratch)


@pytest.mark.parametrize("length", [1, 257])
def test_parts_compose(spark, length):
    """A prefix sum does not depend on how the conversation is cut."""
    rows = [(1, t, "u", str(t)) for t in range(length)] + [(2, 100_000 + t * 300, "u", str(t)) for t in range(length)]
    turns, _ = op13_trie.turn_prefixes(spark.createDataFrame([(*r, "x", 7) for r in rows], TURNS), "conv_id", "turn", "role", "text", 0, op13_trie.Scratch(spark, "test"))
    got = defaultdict(set)
    for r in turns.select("pos", "p0", "p1", "p2", "p3", "t0").collect():
        got[r.pos].add(tuple(r)[1:])
    assert len(got) == length and all(len(x) == 1 for x in got.values())
