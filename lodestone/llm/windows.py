"""Anchored windows: the shared core of the two operators that remove repeated passages.

A document is a sequence of symbols (bytes, or hashed words). The *anchor* of a window of ``length`` symbols
is the smallest hash of the ``gram``-symbol strings in it, so equal windows have equal anchors. Windows that
follow each other mostly share their anchor; such a stretch is a *run*, and the symbols that its windows
cover are its *context*. There are far fewer runs than windows, and a window can only repeat if its anchor
does.

All functions are vectorised over one document or over a block of them, joined end to end.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93))
INVERSES = tuple(U(pow(int(b), -1, 1 << 64)) for b in BASES)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BYTE_HASHES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads a 64-bit value over all its bits."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class Powers:
    """Powers of a base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, lane: int = 0):
        self.bases = (BASES[lane], INVERSES[lane])
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            out = []
            for base in self.bases:
                steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
                steps[0] = 1
                out.append(np.multiply.accumulate(steps))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


POWERS = (Powers(0), Powers(1))


class Prefix:
    """Polynomial prefix hashes of a sequence: the hash of any stretch in constant time."""

    def __init__(self, symbols: np.ndarray, lane: int = 0):
        up, self.down = POWERS[lane].of(len(symbols) + 1)
        self.sums = np.empty(len(symbols) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def stretch(self, start, stop) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def grams(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def sliding(least: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The minimum or maximum of each ``width`` consecutive values, in log2(width) passes."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = least(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(prefix: Prefix, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of the documents that begin at ``starts`` (the last entry is the end of all symbols).

    Returns arrays (document, anchor, first window, last window, ties); positions count from the beginning of
    the block. Ties are anchors that stand twice within a window's reach, so that windows of one run may be
    equal. A document of fewer than ``length`` symbols has no run. Text with a period of under ``length``
    could make a run of any size; runs are cut at ``length`` windows, which changes no window's anchor.
    """
    if int(starts[-1]) < length:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    grams, width = prefix.grams(gram), length - gram + 1
    low = sliding(np.minimum, grams, width)  # by first position of the window
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(grams == sliding(np.maximum, np.concatenate((edge, low, edge)), width))
    again = np.flatnonzero((grams[chosen[1:]] == grams[chosen[:-1]]) & (chosen[1:] - chosen[:-1] < length))
    ties = grams[chosen[again]]
    begins, ends = starts[:-1], starts[1:] - length  # of the windows of a document
    whole = ends >= begins
    cuts = np.unique(np.concatenate((begins[whole], ends[whole] + 1, np.flatnonzero(low[1:] != low[:-1]) + 1)))
    firsts = cuts[cuts < len(low)]
    lasts = np.append(firsts[1:], len(low)) - 1
    document = np.searchsorted(starts, firsts, side="right") - 1
    fit = firsts <= ends[np.minimum(document, len(ends) - 1)]
    firsts, lasts, document = firsts[fit], lasts[fit], document[fit]
    long = np.flatnonzero(lasts - firsts >= length)
    if len(long):
        pieces = np.ones(len(firsts), np.int64)
        pieces[long] = (lasts[long] - firsts[long]) // length + 1
        row = np.repeat(np.arange(len(firsts)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends_at = lasts[row]
        firsts, document = firsts[row] + nth * length, document[row]
        lasts = np.minimum(firsts + length - 1, ends_at)
    return document, low[firsts], firsts, lasts, ties


class Bytes:
    """Documents as their UTF-8 bytes."""

    def __init__(self, length: int = 100, gram: int = 32):
        self.length, self.gram, self.bytes_per_anchor = length, gram, (length - gram + 2) / 2

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of the documents and the end, a hash of each symbol, the raw bytes)."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        return np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64), BYTE_HASHES[raw], raw


class Words:
    """Documents as their words, split at ASCII white space, each word as a hash of its bytes."""

    def __init__(self, length: int = 20, gram: int = 5):
        self.length, self.gram, self.bytes_per_anchor = length, gram, 6 * (length - gram + 2) / 2

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, None]:
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = SPACE[raw]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            edges = np.concatenate(([0], edges))
        begins, ends = edges[0::2], edges[1::2]
        hashes = mix(Prefix(BYTE_HASHES[raw]).stretch(begins, ends) + (ends - begins).astype(np.uint64) * BASES[1]) if len(begins) else np.zeros(0, np.uint64)
        borders = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
        return np.searchsorted(begins, borders).astype(np.int64), hashes, None

