"""Content-defined anchors of byte windows: where equal windows of any two texts must agree.

A window's anchor is its leftmost least-hashed gram. Equal windows have equal anchors at equal offsets,
so windows need to be compared only where their anchors' grams are equal. Consecutive windows mostly
share an anchor and form a run, about one for each (window - gram) / 2 bytes.
"""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES = [np.random.default_rng(s).integers(0, 2**63, 256, dtype=np.uint64) for s in (11, 12)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base i and of its inverse modulo 2**64, n of each at least."""
    have = _POWERS.get(i)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 17)
        have = _POWERS[i] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b % 2**64, np.uint64)]), dtype=np.uint64) for b in (_BASES[i], pow(_BASES[i], -1, 2**64)))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substrings of one text, from prefix sums (hash family 0 or 1)."""

    def __init__(self, data: np.ndarray, family: int):
        up, self.down = _powers(family, len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLES[family][data] * up[: len(data)], dtype=np.uint64)])

    def all(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def leftmost_least(g: np.ndarray, w: int) -> np.ndarray:
    """For each i the place of the leftmost least of g[i : i + w]."""
    n = len(g)
    rows = -(-n // w)
    x = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    x[:n] = g
    x = x.reshape(rows, w)
    at = np.arange(rows * w, dtype=np.int64).reshape(rows, w)
    pre = np.minimum.accumulate(x, axis=1)
    new = np.ones(x.shape, bool)
    new[:, 1:] = x[:, 1:] < pre[:, :-1]
    pre_at = np.maximum.accumulate(np.where(new, at, -1), axis=1)
    back = x[:, ::-1]
    suf = np.minimum.accumulate(back, axis=1)
    new[:, 1:] = back[:, 1:] <= suf[:, :-1]
    suf_at = np.minimum.accumulate(np.where(new, at[:, ::-1], rows * w), axis=1)[:, ::-1].reshape(-1)
    suf, pre, pre_at = suf[:, ::-1].reshape(-1), pre.reshape(-1), pre_at.reshape(-1)
    m = n - w + 1
    return np.where(suf[:m] <= pre[w - 1 : n], suf_at[:m], pre_at[w - 1 : n])


def runs(data: bytes, window: int, gram: int, piece: int = 1 << 22) -> tuple[np.ndarray, ...]:
    """(key, context, start, n, offset): windows start .. start + n - 1 have their anchor, whose gram hashes to key, at start + offset; context hashes all bytes they cover.

    Very long texts are worked through in pieces of so many windows; a run ends where a piece ends only if its anchor does too.
    """
    x = np.frombuffer(data, np.uint8)
    if len(x) < window:
        e = np.empty(0, np.int64)
        return e, e, e, e, e
    out, carry = [], 0
    total = len(x) - window + 1
    a = 0
    while a < total:
        b = min(total, a + piece)
        part = x[a : b + window - 1]
        r0 = Rolling(part, 0)
        g = r0.all(gram)
        place = leftmost_least(g, window - gram + 1)
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        start = np.concatenate([[0], cut])
        end = np.append(cut, len(place))
        nxt = b
        if b < total and len(start) > 1:  # the last run may go on in the next piece: it is done there
            nxt = a + start[-1]
            start, end = start[:-1], end[:-1]
        r1 = Rolling(part, 1)
        out.append((g[place[start]].view(np.int64), r1.some(start, end - 1 + window).view(np.int64), start + a, end - start, place[start] - start))
        a = nxt
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))
