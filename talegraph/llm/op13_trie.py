"""Conversation prefix trie: nodes, members and sums over subtrees, without materializing rebuilt conversations.

A rebuilt conversation is a head of its base conversation and a suffix of its own turns.

Method: composable monoid fingerprints.  The fingerprint of a sequence of turns is its length and,
for each of four primes, the sum of turn hashes times powers of a base; two of them compose to
that of the sequences put together, by one shift: (m, x)(n, y) = (m + n, x + base^m y).  Running
sums give the fingerprint of every original prefix.  A rebuilt prefix is a head product and a
quotient of two own prefixes, shifted; only numbers are combined, and a row names the stored turn
that it ends with.  Members of a prefix are the rows with one fingerprint.  Each group is
then verified: its stored turns have one name and its parents one fingerprint, and each name
stands for one role and text, compared as they are.  If anything differs, all is done anew with
other hashes, so the result is exact.

Sums over subtrees need no walk: a node belongs to its smallest member, so what a conversation's
own nodes hold is summed once, and a node's subtree is the sum over its members, less what its
owner's nodes above it hold.  Long conversations are summed in parts of 256 turn numbers, which
compose likewise.  Lists of ends are joined in parts of 4,096 ids; the parts of a node that has
several are hashed in a stream.

Results for odd input: rows with a null conversation take no part; null roles and texts are empty;
turns are ordered with null first, equal turns by the MD5 of role and text; repeated rows are turns
of their own; an empty table gives no node; a conversation none of whose turns is left is a member
of the root alone and ends there; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, batch_rows, join_checked

#: Four primes below 2^31, so that products fit a long.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
EVERY, HEADS = 20, 4
#: A part of a long conversation: 2^PART_BITS turn numbers; a part of a list of ends: 2^LIST_BITS ids.
PART_BITS, LIST_BITS = 8, 12
_KEY = ["depth", "fa", "fb"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _bases(attempt: int) -> list[int]:
    """A base for each prime; another attempt has others."""
    return [int.from_bytes(hashlib.sha256(f"{attempt}:{p}".encode()).digest()[:8], "big") % (p - 2) + 2 for p in PRIMES]


def _power(base: int, prime: int, exponent: Column, bits: int = 40) -> Column:
    """base ** exponent modulo the prime, from the powers of two in the exponent."""
    out, step = F.lit(1).cast("long"), base % prime
    for i in range(bits):
        out = (out * F.when(F.getbit(exponent, F.lit(i)) == 1, F.lit(step).cast("long")).otherwise(F.lit(1).cast("long"))) % prime
        step = step * step % prime
    return out


def _packed(parts: list[Column]) -> tuple[Column, Column]:
    """Four residues in two longs."""
    return F.shiftleft(parts[0], 31) + parts[1], F.shiftleft(parts[2], 31) + parts[3]


def turn_prefixes(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, attempt: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, name, words, t0..t3 terms, p0..p3 prefix sums), one row for each turn; and (name, role, text) of each to verify by."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    raw = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    seed = f"{attempt}:" if attempt else ""
    raw = raw.withColumn("name", F.md5(F.concat(F.lit(seed), F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    slim = raw.select("conv", "turn", F.coalesce(F.shiftright("turn", PART_BITS), F.lit(-(1 << 62))).alias("part"), "name", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    bases = _bases(attempt)
    order = Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "name")
    slim = slim.withColumn("i", F.row_number().over(order).cast("long"))
    for k, (b, p) in enumerate(zip(bases, PRIMES, strict=True)):
        hashed = F.conv(F.substring("name", 8 * k + 1, 8), 16, 10).cast("long") % p
        slim = slim.withColumn(f"t{k}", hashed * _power(b, p, F.col("i")) % p)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slim = slim.select("conv", "part", "i", "name", "words", *(f"t{k}" for k in range(4)), *((F.sum(f"t{k}").over(run) % p).alias(f"p{k}") for k, p in enumerate(PRIMES)))
    slim = scratch.save(slim)
    # parts of a conversation compose: the product of those before, shifted in front
    last = slim.groupBy("conv", "part").agg(F.max("i").alias("n"), F.max_by(F.struct(*(f"p{k}" for k in range(4))), "i").alias("p"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    for k, (b, p) in enumerate(zip(bases, PRIMES, strict=True)):
        last = last.withColumn(f"s{k}", F.coalesce(F.sum(F.col(f"p.p{k}") * _power(b, p, F.col("ahead")) % p).over(before), F.lit(0)) % p)
    ahead = scratch.save(last.where("ahead > 0").select("conv", "part", "ahead", *(f"s{k}" for k in range(4)), *(_power(b, p, F.col("ahead")).alias(f"m{k}") for k, (b, p) in enumerate(zip(bases, PRIMES, strict=True)))))
    turns = join_checked(slim, ahead, ["conv", "part"], "left", weight=F.lit(100))
    shifted = [(F.col(f"t{k}") * F.coalesce(f"m{k}", F.lit(1)) % p).alias(f"t{k}") for k, p in enumerate(PRIMES)]
    summed = [((F.coalesce(f"s{k}", F.lit(0)) + F.col(f"p{k}") * F.coalesce(f"m{k}", F.lit(1))) % p).alias(f"p{k}") for k, p in enumerate(PRIMES)]
    return scratch.save(turns.select("conv", (F.col("i") + F.coalesce("ahead", F.lit(0))).alias("pos"), "name", "words", *shifted, *summed)), raw.select("name", "role", "text")


def _names_hold(turns: DataFrame, raw: DataFrame, scratch: Scratch) -> bool:
    """Whether every name stands for one role and text: those of the stored turns that share one are compared."""
    shared = scratch.save(turns.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"))
    same = join_checked(raw, shared, "name").groupBy("name").agg(F.min(F.struct("role", "text")).alias("a"), F.max(F.struct("role", "text")).alias("b"))
    return same.where("a <> b").isEmpty()


def _members(turns: DataFrame, attempt: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv, length) of rebuilt conversations; (conv, depth, fa, fb, ga, gb, name, words, ends, turn_conv, turn_pos), one row for each prefix that has a turn."""
    sums = [f"p{k}" for k in range(4)]
    # the first turns of each conversation: what heads and quotients are made of
    firsts = [F.max(F.when(F.col("pos") == j, F.struct(*sums, "name", "words"))).alias(f"f{j}") for j in range(1, HEADS)]
    convs = scratch.save(turns.groupBy("conv").agg(F.max("pos").alias("n"), *firsts))
    heads = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), *(F.col(f"f{j}").alias(f"b{j}") for j in range(1, HEADS)))
    own = convs.withColumn("base", F.col("conv") - F.col("conv") % EVERY).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS)
    plan = own.join(heads.where(F.col("base") % EVERY == 0), "base", "left")
    plan = plan.withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = plan.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    def at(what: str, place: str, k: int) -> Column:
        out = F.lit(0).cast("long")
        for j in range(1, HEADS):
            out = F.when(F.col(place) == j, F.col(f"{what}{j}.p{k}")).otherwise(out)
        return out

    # a row's prefix: (head product) + base^(head - h) (own prefix - own prefix of h turns)
    shift = {k: [pow(pow(b, -1, p), j, p) for j in range(HEADS)] for k, (b, p) in enumerate(zip(_bases(attempt), PRIMES, strict=True))}
    moved = [F.element_at(F.array(*(F.lit(x).cast("long") for x in shift[k])), (F.col("h") - F.col("head") + 1).cast("int")).alias(f"v{k}") for k in range(4)]
    plan = scratch.save(plan.select("conv", "base", "n", "h", "head", "length", *(f"b{j}" for j in range(1, HEADS)), *(at("b", "head", k).alias(f"h{k}") for k in range(4)), *(at("f", "h", k).alias(f"o{k}") for k in range(4)), *moved))

    entries = []
    for j in range(1, HEADS):
        ga, gb = _packed([F.col(f"b{j - 1}.p{k}") for k in range(4)]) if j > 1 else (F.lit(0).cast("long"), F.lit(0).cast("long"))
        fa, fb = _packed([F.col(f"b{j}.p{k}") for k in range(4)])
        entries.append(F.when(F.col("head") >= j, F.struct(F.lit(j).cast("long").alias("depth"), fa.alias("fa"), fb.alias("fb"), ga.alias("ga"), gb.alias("gb"), F.col(f"b{j}.name").alias("name"), F.col(f"b{j}.words").alias("words"), F.lit(j).cast("long").alias("turn_pos"))))
    head = plan.select("conv", "length", "base", F.explode(F.array_compact(F.array(*entries))).alias("x"))
    head = head.select("conv", "x.depth", "x.fa", "x.fb", "x.ga", "x.gb", "x.name", "x.words", (F.col("x.depth") == F.col("length")).alias("ends"), F.col("base").alias("turn_conv"), "x.turn_pos")

    tail = turns.join(plan.select("conv", "h", "head", "length", *(f"{c}{k}" for c in "hov" for k in range(4))), "conv").where("pos > h")
    full = [(F.col(f"h{k}") + F.col(f"v{k}") * F.pmod(F.col(f"p{k}") - F.col(f"o{k}"), F.lit(p))) % p for k, p in enumerate(PRIMES)]
    less = [(F.col(f"h{k}") + F.col(f"v{k}") * F.pmod(F.col(f"p{k}") - F.col(f"t{k}") - F.col(f"o{k}"), F.lit(p))) % p for k, p in enumerate(PRIMES)]
    depth = F.col("head") + F.col("pos") - F.col("h")
    (fa, fb), (ga, gb) = _packed(full), _packed(less)
    tail = tail.select("conv", depth.alias("depth"), fa.alias("fa"), fb.alias("fb"), ga.alias("ga"), gb.alias("gb"), "name", "words", (depth == F.col("length")).alias("ends"), F.col("conv").alias("turn_conv"), F.col("pos").alias("turn_pos"))
    return plan.select("conv", "length"), scratch.save(head.unionByName(tail))


def _before(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes with `before`: the sum of `own` over the nodes of the same conversation above, taken in parts."""
    part = F.shiftright("depth", PART_BITS)
    up = Window.partitionBy("conv_id", "_part").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("_part", part)
    parts = out.groupBy("conv_id", "_part").agg(F.sum("own").alias("_n"))
    above = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.save(parts.select("conv_id", "_part", F.sum("_n").over(above).alias("_ahead")).where("_ahead > 0"))
    out = join_checked(out.withColumn("_sum", F.sum("own").over(up)), parts, ["conv_id", "_part"], "left")
    return out.withColumn("before", F.coalesce("_sum", F.lit(0)) + F.coalesce("_ahead", F.lit(0))).drop("_part", "_sum", "_ahead")


def _streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of lists, in order -> the hash of each whole list."""
    now, sha = None, None
    for f in frames:
        for depth, fa, fb, ids in zip(f["depth"], f["fa"], f["fb"], f["ids"], strict=True):
            if (depth, fa, fb) != now:
                if now is not None:
                    yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*_KEY, "sha"])
                now, sha = (depth, fa, fb), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if now is not None:
        yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*_KEY, "sha"])


def _ends(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(depth, fa, fb, sha) of the conversations that end at each node."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    parts = scratch.save(ends.groupBy(*_KEY, F.shiftright("conv", LIST_BITS).alias("part")).agg(ids.alias("ids")))
    whole = scratch.save(parts.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("ids").alias("ids")))
    several = join_checked(parts, scratch.save(whole.where("n > 1").select(*_KEY)), _KEY)
    with batch_rows(parts.sparkSession, 256):
        streamed = scratch.save(several.repartition(*_KEY).sortWithinPartitions(*_KEY, "part").mapInPandas(_streamed, "depth long, fa long, fb long, sha string"))
    return whole.where("n = 1").select(*_KEY, F.sha2("ids", 256).alias("sha")).unionByName(streamed)


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", attempts: int = 8) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_conv, turn_pos), one row for each node.

    turn_conv, turn_pos: the stored turn that the node ends with, by its place from 1."""
    scratch = Scratch(df.sparkSession, "trie")
    for attempt in range(attempts):
        turns, raw = turn_prefixes(df, conv_col, turn_col, role_col, text_col, attempt, scratch)
        convs, members = _members(turns, attempt, scratch)
        grouped = members.groupBy(*_KEY).agg(
            F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("words").alias("words"), F.min(F.struct("turn_conv", "turn_pos")).alias("turn"),
            F.min("ga").alias("ga"), F.min("gb").alias("gb"), ((F.min("name") != F.max("name")) | (F.min("ga") != F.max("ga")) | (F.min("gb") != F.max("gb"))).alias("mixed"),
        )
        nodes = scratch.save(grouped)
        if nodes.where("mixed").isEmpty() and _names_hold(turns, raw, scratch):
            break
    else:
        raise RuntimeError("no fingerprints were found that tell all prefixes apart")
    nodes = nodes.drop("mixed")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("root_id"))
    # children by parent, and each parent's conversation; the root's are known without a join
    below = nodes.where("depth > 1").select((F.col("depth") - 1).alias("depth"), F.col("ga").alias("fa"), F.col("gb").alias("fb"))
    kids = below.groupBy(*_KEY).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = scratch.save(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("long")))
    # a node's subtree: what its members' own nodes hold, without those of its owner that are above it
    totals = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("own").alias("total"), F.sum("leaf").alias("leaves")).where("total > 0 or leaves > 0")
    sums = members.select("conv", *_KEY).join(totals, "conv").groupBy(*_KEY).agg(F.sum("total").alias("total"), F.sum("leaves").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("_depth"), F.col("fa").alias("_fa"), F.col("fb").alias("_fb"), F.col("conv_id").alias("parent_conv_id"))
    out = _before(nodes, scratch).join(sums, _KEY, "left")
    out = out.join(parents, (out.depth == parents._depth) & (out.ga == parents._fa) & (out.gb == parents._fb), "left")
    at_root = convs.where("length = 0").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fa"), F.lit(0).cast("long").alias("fb"))
    ends = scratch.save(_ends(members.where("ends").select("conv", *_KEY).unionByName(at_root), scratch))
    zero = F.lit(0).cast("long")
    top = nodes.agg(F.coalesce(F.sum("own"), zero).alias("total"), F.coalesce(F.sum("leaf"), zero).alias("leaves"), F.coalesce(F.sum((F.col("depth") == 1).cast("long")), zero).alias("n_children"))
    root = scratch.save(root.where("n_convs > 0").crossJoin(top), rows=1)  # one row each
    first = root.select("root_id").first()
    first = F.lit(first[0] if first else None).cast("long")
    none = F.lit(None).cast("long")
    top = root.select(
        F.col("root_id").alias("conv_id"), zero.alias("depth"), zero.alias("fa"), zero.alias("fb"), none.alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), F.col("total").alias("saved_tokens"), none.alias("turn_conv"), none.alias("turn_pos"),
    )
    out = out.select(
        "conv_id", *_KEY, F.when(F.col("depth") == 1, first).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", zero).alias("n_leaves"), (F.coalesce("total", zero) - F.col("before")).alias("saved_tokens"), F.col("turn.turn_conv").alias("turn_conv"), F.col("turn.turn_pos").alias("turn_pos"),
    )
    out = out.unionByName(top).join(ends, _KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"), "turn_conv", "turn_pos")


def op13_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("turn_conv", "turn_pos")


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, count(*) AS n, c - c % 20 AS base FROM t GROUP BY c
), bits AS (
  SELECT CAST(b AS BIGINT) AS b FROM range(256) AS r(b)
), crc AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))) AS v FROM bits
), codes AS (
  SELECT list(v ORDER BY b) AS codes FROM crc
), heads AS (
  SELECT c, n, base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda v, x: xor(v >> 8, codes[(xor(v, x) & 255) + 1])), 4294967295) % 4 AS h
  FROM convs, codes
), rebuilt AS (
  SELECT h.c, t.pos AS d, t.role, t.text FROM heads h JOIN t ON t.c = h.base AND t.pos <= h.h
  UNION ALL
  SELECT h.c, least(h.h, coalesce(b.n, 0)) + t.pos - h.h AS d, t.role, t.text FROM heads h LEFT JOIN convs b ON b.c = h.base JOIN t ON t.c = h.c AND t.pos > h.h
), named AS (
  SELECT c, 0 AS d, '' AS k, 0 AS words FROM heads
  UNION ALL
  SELECT c, d, md5(string_agg(md5(strlen(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY d)) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt
), linked AS (
  SELECT c, d, k, words, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM named
), node AS (
  SELECT d, k, min(up) AS up, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * max(words) AS own, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS sha FROM linked GROUP BY d, k
), kids AS (
  SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY d, up
), subtree AS (
  SELECT x.d, x.k, sum(w.own) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM node w JOIN linked x ON x.c = w.conv_id AND x.d <= w.d LEFT JOIN kids ON kids.d = w.d AND kids.k = w.k GROUP BY x.d, x.k
)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.sha AS ends_sha256
FROM node JOIN subtree s ON s.d = node.d AND s.k = node.k LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k LEFT JOIN node up ON up.d = node.d - 1 AND up.k = node.up
"""
