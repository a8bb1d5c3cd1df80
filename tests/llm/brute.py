"""Plain versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def suffixes(docs, length=100):
    seen, out = {}, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen[s] = i
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = (len(b), sum(gone), len(spans), digest(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def substrings(docs, length=50):
    seen, out = {}, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            s = tuple(w[p : p + length])
            if seen.setdefault(s, i) < i:
                gone[p : p + length] = [True] * length
        out[i] = (len(w), sum(gone), digest(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text, size=5):
    w = WORD.findall(lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def jaccard(docs, size=5):
    sets = {i: shingles(t, size) for i, t in docs}
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    counts = {}
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                k = (ids[b], ids[a])
                counts[k] = counts.get(k, 0) + 1
    for (a, b), both in counts.items():
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, bench, window=10):
    items = {}
    for i, t in bench:
        w = ALNUM.findall(lower(t))
        n = min(window, len(w))
        if n:
            for p in range(len(w) - n + 1):
                items.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    sizes = sorted({len(k) for k in items})
    out = {}
    for i, t in docs:
        w = ALNUM.findall(lower(t))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                k = items.get(tuple(w[p : p + n]))
                if k:
                    found |= k
                    hit[p : p + n] = [True] * n
        out[i] = (len(w), sum(hit), len(found), digest(",".join(sorted(found))), any(hit))
    return out


def left_lines(docs, window=3):
    """The lines that stay of each document."""
    seen, out = {}, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        ls = t.split("\n") if t else []
        gone = [False] * len(ls)
        for p in range(len(ls) - window + 1):
            s = tuple(ls[p : p + window])
            if not any(WORD.search(x) for x in s):
                continue
            if s in seen:
                gone[p : p + window] = [True] * window
            else:
                seen[s] = (i, p)
        out[i] = [x for x, g in zip(ls, gone) if not g]
    return out


def lines(docs, window=3):
    left = left_lines(docs, window)
    sizes = {i: len(t.split("\n")) if t else 0 for i, t in docs}
    return {i: (sizes[i], sizes[i] - len(ls), digest("\n".join(ls))) for i, ls in left.items()}
