"""Winnowed blocks: runs of neighbouring windows that share one anchor.

A window is ``length`` consecutive units (bytes or words) of one text.  Its anchor is the
``gram`` units inside it with the least hash, the leftmost of equals, so equal windows have
equal anchors at equal places, wherever they stand (winnowing).  Neighbouring windows with
the same anchor form a block.  Blocks are what is shuffled: one row for about
``(length - gram) / 2`` windows.
"""

from __future__ import annotations

import numpy as np

from .bytescan import U64, RunHash, mix, sliding_min

_POS = 21  # bits that hold a place while minima are taken; longer texts are taken in parts


class Blocks:
    """Blocks of one piece: ``lo``/``hi`` first and last window starts, ``anchor`` places,
    ``gram`` (hash of the anchor) and ``content`` (hash of all units that the block covers,
    with the anchor's place in it)."""

    def __init__(self, runs: RunHash, before: np.ndarray, length: int, gram: int):
        """before: for each text the number of units before it, and the number of all."""
        width = length - gram + 1
        counts = np.diff(before)
        total = int(before[-1])
        n = max(0, total - length + 1)
        if not n or counts.max(initial=0) < length:
            z = np.zeros(0, np.int64)
            self.lo = self.hi = self.anchor = self.text = z
            self.gram = self.content = z.astype(U64)
            return
        at = np.arange(total - gram + 1)
        grams = runs.of(at, at + gram)
        anchor = np.empty(n, np.int64)
        part = (1 << _POS) - width
        low = U64((1 << _POS) - 1)
        for a in range(0, n, part):
            b = min(n, a + part)
            keys = (grams[a : b + width - 1] & ~low) | np.arange(b + width - 1 - a, dtype=U64)
            anchor[a:b] = (sliding_min(keys, width) & low).astype(np.int64) + a
        text = np.repeat(np.arange(len(counts)), counts)[:n]
        whole = np.arange(n) + length <= before[1:][text]
        first = whole.copy()
        first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        last = whole.copy()
        last[:-1] &= ~whole[1:] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        self.lo, self.hi = np.flatnonzero(first), np.flatnonzero(last)
        self.anchor, self.text = anchor[self.lo], text[self.lo]
        self.gram = grams[self.anchor]
        place = (self.anchor - self.lo).astype(U64)
        self.content = mix(runs.of(self.lo, self.hi + length) + place * U64(0xA0761D6478BD642F) + U64(1))
