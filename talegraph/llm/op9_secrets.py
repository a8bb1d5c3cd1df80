"""Secret scans with a linear-chain conditional random field.

Method: texts are cut into tokens (runs of other than white space).  A chain over the tags
outside, begin and inside scores each token by its shape, its word, the shapes of the tokens
beside it, the word before it and how the file as a whole looks.  It is trained by gradient
ascent on its conditional likelihood, on windows of a bounded sample of documents in which
the base patterns mark the secrets.  Long and numbered tokens count by their shape alone, and
every window is seen a second time with all words masked, so a keyword is never what the chain
can rest on: it learns shapes and neighbours, which secrets that no base pattern knows share.
Windows without a base span that hold a token of a secret's shape are no examples of either.
Every whole text is then decoded by Viterbi.  Tokens so far outside that no neighbour could
turn them cut the chain, so the paths between them are exact and short.  Spans that the chain
finds beside the base ones are added as kind ``crf``.

The sample is at most ``SAMPLE_DOCS`` documents, by hash.

Results for odd input: a null text is empty and has no spans; a null id is kept; repeated
rows have equal results; without any base span to learn from only base spans are returned;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import Words, pieces
from .scratch import drawn

SAMPLE_DOCS = 20_000
WINDOWS = 6_000
STEPS, RATE, DECAY = 80, 0.5, 1e-4
KINDS = ("assign", "access", "hex", "crf")
REACH = 12  # tokens to each side of a secret in a training window

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _mask(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_HEX, _DIGIT = _mask("0123456789abcdef"), _mask("0123456789")
_UPPER, _LOWER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("abcdefghijklmnopqrstuvwxyz")
_JOIN, _SIGN = _mask("+/_.-"), _mask("=:\"'")
_CORE = _UPPER | _LOWER | _DIGIT | _mask("+/_=-")

Span = tuple[int, int, int]  # start, end (bytes of the text), kind


def _at(data: bytes, word: bytes, lo: int, hi: int) -> Iterator[int]:
    at = data.find(word, lo, hi)
    while at >= 0:
        yield at
        at = data.find(word, at + 1, hi)


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[list[Span]]:
    """For each text of a piece the base spans, as byte offsets in it."""
    out: list[list[Span]] = [[] for _ in offsets[1:]]
    raw = data.tobytes()
    low = raw.lower()
    texts = {int(np.searchsorted(offsets, p, "right")) - 1 for k in _KEYWORDS for p in _at(low, k, 0, len(low))}
    for t in sorted(texts):
        part = raw[offsets[t] : offsets[t + 1]].decode("latin-1")  # bytes as characters: the patterns are ASCII
        out[t] += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(part) if len(m[2]) >= LEAST_ASSIGN]
    for t in sorted({int(np.searchsorted(offsets, p, "right")) - 1 for p in _at(raw, b"AKIA", 0, len(raw))}):
        part = raw[offsets[t] : offsets[t + 1]].decode("latin-1")
        out[t] += [(m.start(), m.end(), 1) for m in ACCESS.finditer(part) if m.end() - m.start() >= LEAST_ACCESS]
    hexes = Words(data, offsets, False, _HEX)
    for i in np.flatnonzero(hexes.ends - hexes.starts >= LEAST_HEX):
        s, e = int(hexes.starts[i]), int(hexes.ends[i])
        t = int(np.searchsorted(offsets, s, "right")) - 1
        out[t].append((s - int(offsets[t]), e - int(offsets[t]), 2))
    for spans in out:
        spans.sort(key=lambda x: (x[0], x[2]))
    return out


# features: one row of codes for each token, each code an index of its own table
SHAPE, WORD, FILE = 1 << 12, 1 << 12, 1 << 6
TABLES = (SHAPE, SHAPE, SHAPE, WORD, WORD, FILE)
OFFSETS = np.concatenate([[0], np.cumsum(TABLES)])


def _log_bin(n: np.ndarray, bins: list[int]) -> np.ndarray:
    return np.searchsorted(bins, n, "right")


def features(w: Words) -> np.ndarray:
    """Codes (tokens, 6): own shape, shape before, shape after, own word, word before, file."""
    n = len(w.hashes)
    if not n:
        return np.zeros((0, 6), np.int32)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[w.data])])
        return total[w.ends] - total[w.starts]

    length = w.ends - w.starts
    digits, upper, lower = count(_DIGIT), count(_UPPER), count(_LOWER)
    turns = np.concatenate([[0], np.cumsum(np.concatenate([[False], _DIGIT[w.data][1:] != _DIGIT[w.data][:-1]]))])
    switches = turns[w.ends] - turns[np.minimum(w.starts + 1, w.ends)]
    shape = _log_bin(length, [4, 8, 12, 16, 20, 32, 64])
    shape = shape * 4 + np.where(digits == 0, 0, np.where(digits * 4 < length, 1, np.where(digits < length, 2, 3)))
    shape = shape * 4 + np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(lower == 0, 3, 2)))
    shape = shape * 4 + _log_bin(switches, [1, 3, 6])
    shape = shape * 2 + (count(_SIGN) > 0)
    shape = shape * 2 + (count(_JOIN) > 1)
    shape = shape * 2 + (count(_HEX) + count(_SIGN) == length)
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    before[1:], after[:-1] = shape[:-1], shape[1:]
    word = (w.hashes & np.uint64(WORD - 2)).astype(np.int64) + 1
    word[(length > 16) | (digits > 0)] = 0  # long or numbered tokens count by shape alone
    prior = np.empty(n, np.int64)
    prior[1:] = word[:-1]
    first = w.before[:-1][w.before[:-1] < n]
    last = w.before[1:][w.before[1:] > 0] - 1
    before[first], prior[first], after[last] = SHAPE - 1, 0, SHAPE - 1
    # the file: how long it is, and how many of its tokens hold digits or signs
    counts = w.counts()
    held = np.concatenate([[0], np.cumsum(digits > 0)])
    rate = (held[w.before[1:]] - held[w.before[:-1]]) / np.maximum(counts, 1)
    file = _log_bin(counts, [10, 30, 100, 300, 1000, 3000, 10000]) * 8 + np.searchsorted([0.001, 0.005, 0.01, 0.03, 0.1, 0.3, 0.6], rate)
    return np.stack([shape, before, after, word, prior, np.repeat(file, counts)], axis=1).astype(np.int32)


def tags(w: Words, text: int, spans: list[Span]) -> np.ndarray:
    """0 outside, 1 begin, 2 inside for the tokens of one text."""
    a, b = w.before[text], w.before[text + 1]
    out = np.zeros(b - a, np.int8)
    at = w.offsets[text]
    for s, e, _ in spans:
        i = int(np.searchsorted(w.ends[a:b], at + s, "right"))
        j = int(np.searchsorted(w.starts[a:b], at + e))
        if j > i:
            inside = out[i] == 2  # a kind within another, as hex within assign
            out[i:j] = np.where(out[i:j] == 0, 2, out[i:j])
            if not inside:
                out[i] = 1
    return out


def _training(limit: int):
    """(text) -> windows of codes and tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, marks, keys = [], [], []
            for _, _, data, offsets in pieces(batch.column(0)):
                w = Words(data, offsets, True)
                x = features(w)
                for t, spans in enumerate(base_spans(data, offsets)):
                    a, b = int(w.before[t]), int(w.before[t + 1])
                    if a == b:
                        continue
                    y = tags(w, t, spans)
                    seed = int(w.hashes[a]) ^ (b - a)
                    starts = np.flatnonzero(y == 1)
                    # a window of every text without secrets too; those with one come first more often
                    spots, lead = (starts.tolist(), 3) if len(starts) else ([seed % (b - a)], 0)
                    for k, s in enumerate(spots):
                        lo, hi = max(0, s - REACH), min(b - a, s + REACH + 1)
                        codes.append(x[a + lo : a + hi].reshape(-1).tolist())
                        marks.append(y[lo:hi].tolist())
                        keys.append(((seed + k * 7919) & 0x7FFFFFFF) >> lead)
            if codes:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(codes, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int8()))], ["key", "codes", "tags"])

    return run


class Crf:
    """Weights of codes for the three tags, and of moves between tags."""

    def __init__(self):
        self.w = np.zeros((OFFSETS[-1], 3))
        self.move = np.zeros((3, 3))

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((*x.shape[:-1], 3))
        for j in range(x.shape[-1]):
            out += self.w[x[..., j] + OFFSETS[j]]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> None:
        """x (n, T, 6), y (n, T), tokens past a length don't count.  Adagrad on the log-likelihood."""
        n, t = y.shape
        on = np.arange(t) < length[:, None]
        at = x + OFFSETS[:-1]
        gold = np.eye(3)[y] * on[:, :, None]
        gold_move = np.zeros((3, 3))
        np.add.at(gold_move, (y[:, :-1][on[:, 1:]], y[:, 1:][on[:, 1:]]), 1)
        sum_w, sum_m = np.full(self.w.shape, 1e-6), np.full((3, 3), 1e-6)
        for _ in range(STEPS):
            e = self.scores(x)
            a, b = np.zeros((n, t, 3)), np.zeros((n, t, 3))
            a[:, 0] = e[:, 0]
            for i in range(1, t):
                a[:, i] = np.where(on[:, i, None], _lse(a[:, i - 1, :, None] + self.move, 1) + e[:, i], a[:, i - 1])
            for i in range(t - 2, -1, -1):
                b[:, i] = np.where(on[:, i + 1, None], _lse(self.move + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), b[:, i + 1])
            z = _lse(a[:, -1], 1)
            p = np.exp(a + b - z[:, None, None]) * on[:, :, None]
            pair = np.zeros((3, 3))
            for i in range(1, t):
                both = np.exp(a[:, i - 1, :, None] + self.move + (e[:, i] + b[:, i])[:, None, :] - z[:, None, None])
                pair += (both * on[:, i, None, None]).sum(0)
            diff = (gold - p).reshape(-1, 3)
            g = np.zeros(self.w.shape)
            for j in range(x.shape[-1]):
                for k in range(3):
                    g[:, k] += np.bincount(at[:, :, j].reshape(-1), diff[:, k], len(g))
            g = g / n - DECAY * self.w
            gm = (gold_move - pair) / n - DECAY * self.move
            sum_w += g * g
            sum_m += gm * gm
            self.w += RATE * g / np.sqrt(sum_w)
            self.move += RATE * gm / np.sqrt(sum_m)
        self.w = self.w.astype(np.float32).astype(np.float64)

    def decode(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The best tags of the tokens of several texts, by Viterbi."""
        out = np.zeros(len(x), np.int8)
        if not len(x):
            return out
        e = self.scores(x)
        # a token whose lead for outside is beyond what two moves can make up is outside on every best path
        bound = 2 * (self.move.max() - self.move.min())
        near = e[:, 1:].max(1) + bound >= e[:, 0]
        edge = np.zeros(len(x) + 1, bool)
        edge[before] = True
        start = near & (np.concatenate([[True], ~near[:-1]]) | edge[:-1])
        stop = near & (np.concatenate([~near[1:], [True]]) | edge[1:])
        for a, b in zip(np.flatnonzero(start).tolist(), (np.flatnonzero(stop) + 1).tolist(), strict=True):
            v = e[a] if edge[a] else e[a] + self.move[0]
            back = np.zeros((b - a, 3), np.int8)
            for i in range(a + 1, b):
                m = v[:, None] + self.move
                back[i - a] = m.argmax(0)
                v = m.max(0) + e[i]
            tag = int((v if edge[b] else v + self.move[:, 0]).argmax())
            for i in range(b - 1, a - 1, -1):
                out[i] = tag
                tag = back[i - a][tag]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


def _find(shared, carried: int):
    """Texts in column 0, others carried -> spans as structs, in code points."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(0)):
                found = base_spans(data, offsets)
                if crf is not None:
                    w = Words(data, offsets, True)
                    tag = crf.decode(features(w), w.before)
                    text = w.owner()
                    begins = np.flatnonzero((tag == 1) | ((tag == 2) & (np.concatenate([[0], tag[:-1]]) == 0)))
                    for i in begins.tolist():
                        j = i + 1
                        while j < len(tag) and tag[j] == 2 and text[j] == text[i]:
                            j += 1
                        s, e = int(w.starts[i]), int(w.ends[j - 1])
                        while s < e and not _CORE[data[s]]:
                            s += 1
                        while e > s and not _CORE[data[e - 1]]:
                            e -= 1
                        t, at = int(text[i]), int(offsets[text[i]])
                        if e > s and not any(a < e - at and s - at < b for a, b, _ in found[t]):
                            found[t].append((s - at, e - at, 3))
                out = []
                for t, spans in enumerate(found):
                    if not spans:
                        out.append([])
                        continue
                    spans.sort(key=lambda x: (x[0], x[2]))
                    own = data[offsets[t] : offsets[t + 1]]
                    points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])  # code points before each byte
                    out.append([{"kind": KINDS[k], "start": int(points[s]), "end": int(points[e])} for s, e, k in spans])
                rest = [batch.column(i + 1).slice(lo, hi - lo) for i in range(carried)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(out, kind)], [*batch.schema.names[1:], "spans"])

    return run


def train_crf(df: DataFrame, text_col: str, id_col: str, sample_docs: int = SAMPLE_DOCS) -> Crf | None:
    """A chain learned from a bounded sample; None if it holds no secret."""
    n = df.count()
    rows = df.where(drawn(F.col(id_col), sample_docs, n, 9)).select(F.col(text_col).cast("string").alias("text")).mapInArrow(_training(WINDOWS), "key long, codes array<int>, tags array<byte>")
    rows = rows.where("size(codes) > 0").orderBy("key", "codes").limit(WINDOWS).collect()  # WINDOWS of bounded length
    if not any(1 in r.tags for r in rows):
        return None
    # a window without base spans, in which a token has the shape of a known secret, may hold one that no pattern knows
    shaped = {c[0] for r in rows for c, y in zip(np.array(r.codes).reshape(-1, 6).tolist(), r.tags, strict=True) if y and not c[3]}
    rows = [r for r in rows if any(r.tags) or not any(c[0] in shaped for c in np.array(r.codes).reshape(-1, 6).tolist())]
    t = max(len(r.tags) for r in rows)
    x, y = np.zeros((len(rows), t, 6), np.int64), np.zeros((len(rows), t), np.int64)
    for i, r in enumerate(rows):
        k = len(r.tags)
        x[i, :k] = np.array(r.codes).reshape(k, 6)
        y[i, :k] = r.tags
    crf = Crf()
    masked = x.copy()
    masked[:, :, 3:5] = 0  # no word, nor the word before
    length = np.array([len(r.tags) for r in rows])
    crf.fit(np.concatenate([x, masked]), np.concatenate([y, y]), np.concatenate([length, length]))
    return crf


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, crf: Crf | None = None) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) in code points, one row for each of df."""
    crf = crf or train_crf(df, text_col, id_col, sample_docs)
    docs = df.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    shared = df.sparkSession.sparkContext.broadcast(crf)
    return docs.mapInArrow(_find(shared, 1), f"id {docs.schema['id'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long>>")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = secret_spans(docs)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def times(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        F.col("id").alias("doc_id"),
        *(times(k) for k in KINDS[:-1]),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        times("crf"),
    )
