"""Blockwise suffix sorting with difference-cover samples, in bounded memory (numpy, no Spark).

A difference cover D of period v has, for any two places i and j, a shift below v after which both
fall on sample places (places modulo v in D). The ranks of the sample suffixes are computed first, by
doubling in steps of v. Suffixes are then sorted one bucket at a time: by their bytes up to the next
shared sample place, where the sample ranks settle even very long ties.
"""

from __future__ import annotations

from functools import cmp_to_key, lru_cache

import numpy as np


@lru_cache(maxsize=8)
def difference_cover(v: int) -> tuple[np.ndarray, np.ndarray]:
    """A cover of period v (a power of two) and the table of shifts for every two residues.

    With r near the root of v: 0 .. r - 1 and every r-th residue less one; any difference q * r + t is
    that of (q + 1) * r - 1 and r - 1 - t.
    """
    r = 1 << (max(1, v.bit_length() - 1 + 1) // 2)
    r = min(8, max(1, r), v)
    d = np.array(sorted({*range(r), *range(r - 1, v, r)}))
    inside = np.zeros(v, bool)
    inside[d] = True
    i = np.arange(v)
    ok = np.stack([inside[(i[:, None] + s) % v] & inside[(i[None, :] + s) % v] for s in range(v)])
    return d, ok.argmax(0)


def words_at(text: np.ndarray, at: np.ndarray, size: np.ndarray | int = 8) -> np.ndarray:
    """Up to 8 bytes at each place, as an unsigned number in the bytes' order; bytes beyond size count as zero. text needs 8 spare bytes."""
    w = np.lib.stride_tricks.sliding_window_view(text, 8)[at].copy().view(">u8").reshape(-1).astype(np.uint64)
    keep = (8 - np.minimum(size, 8)).astype(np.uint64) * np.uint64(8) if isinstance(size, np.ndarray) else np.uint64(8 * (8 - min(size, 8)))
    mask = np.where(keep >= 64, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) << np.minimum(keep, np.uint64(63)))
    return w & mask


def ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by these columns, the first one leading; equal rows share a rank."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class CoverRanks:
    """Ranks of the sample suffixes of text by their first depth bytes (a multiple of v)."""

    def __init__(self, text: np.ndarray, v: int, depth: int):
        self.v, self.n = v, len(text)
        self.text = np.concatenate([text, np.zeros(depth + v + 16, np.uint8)])
        d, self.shift = difference_cover(v)
        blocks = -(-(self.n + v) // v)
        at = (np.arange(blocks)[:, None] * v + d).reshape(-1)
        at = at[at < self.n + v]
        index = np.full(len(self.text) + depth + v, len(at), np.int64)
        index[at] = np.arange(len(at))
        rank = ranked([words_at(self.text, at + i) for i in range(0, v, 8)]) + 1
        by_size, size, steps = {v: rank}, v, depth // v
        while size * 2 <= depth:  # ranks by twice the bytes, from two ranks a step apart; places past the end come first
            nxt = np.append(by_size[size], 0)[index[at + size]]
            by_size[size * 2] = ranked([by_size[size] * (len(at) + 2) + nxt]) + 1
            size *= 2
        total, have = None, 0
        for k in range(steps.bit_length() - 1, -1, -1):
            if steps >> k & 1:
                part = by_size[v << k]
                total = part if total is None else ranked([total * (len(at) + 2) + np.append(part, 0)[index[at + have]]]) + 1
                have += v << k
        self.ranks = np.zeros(len(index), np.int64)
        self.ranks[at] = total

    def compare(self, i: int, j: int) -> int:
        """Order of two suffixes by at least depth bytes."""
        s = int(self.shift[i % self.v, j % self.v])
        a, b = self.text[i : i + s].tobytes(), self.text[j : j + s].tobytes()
        if a != b:
            return -1 if a < b else 1
        return int(np.sign(self.ranks[i + s] - self.ranks[j + s]))


def suffix_array(data: bytes, v: int = 64, depth: int | None = None, bucket_bytes: int = 2) -> np.ndarray:
    """Places of all suffixes in order (by depth bytes at least; by default all), one bucket of equal first bytes at a time."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    depth = -(-(n if depth is None else depth) // v) * v
    # bytes are moved up by one in 16 bits, so that the end of the text comes before any byte
    text = np.frombuffer(data, np.uint8)
    wide = np.zeros(2 * n, np.uint8)
    wide[1::2], wide[::2] = (text.astype(np.uint16) + 1) & 0xFF, (text.astype(np.uint16) + 1) >> 8
    cover = CoverRanks(wide, v, 2 * depth)
    first = words_at(cover.text, 2 * np.arange(n), 2 * bucket_bytes)
    out = []
    for w in np.unique(first):
        bucket = np.flatnonzero(first == w)
        head = words_at(cover.text, 2 * bucket)
        order = np.argsort(head, kind="stable")
        bucket, head = bucket[order], head[order]
        cut = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        for group in np.split(bucket, cut[1:]):
            out.append(np.array(sorted(group.tolist(), key=cmp_to_key(lambda i, j: cover.compare(2 * i, 2 * j)))) if len(group) > 1 else group)
    return np.concatenate(out)


def repeated_windows(contexts: list[bytes], groups: np.ndarray, counts: np.ndarray, offsets: np.ndarray, window: int, v: int = 64) -> np.ndarray:
    """Which windows (starts 0 .. counts - 1 of each context, in order) equal a window of another context of their group at the same distance from the anchor.

    contexts[i] has its anchor at offsets[i]. Contexts are laid out with their anchors on multiples of
    v, so suffixes of one bucket (group and distance) have one residue: bytes up to the next sample
    place, the sample's rank and the few bytes left after it decide.
    """
    while v > 8 and window - 8 < v:
        v //= 2
    if window < 16:
        raise ValueError("windows of 16 bytes or more")
    depth = (window - 7) // v * v
    size = np.array([len(c) for c in contexts])
    lead = (-offsets) % v
    base = np.concatenate([[0], np.cumsum(-(-(lead + size) // v) * v + v)])[:-1] + lead
    base += -(base + offsets) % v
    text = np.zeros(int(base[-1] + size[-1]) + v, np.uint8)
    for b, c in zip(base, contexts, strict=True):
        text[b : b + len(c)] = np.frombuffer(c, np.uint8)
    cover = CoverRanks(text, v, depth)
    own = np.repeat(np.arange(len(contexts)), counts)
    j = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[own] + j
    residue_shift = cover.shift[np.arange(v), np.arange(v)]
    to = residue_shift[at % v]
    rest_at, rest = at + to + depth, window - to - depth
    bucket = ranked([groups[own]]) * (window + 1) + (offsets[own] - j) if len(own) else own
    keys = [bucket, words_at(cover.text, at, to), cover.ranks[at + to]]
    keys += [words_at(cover.text, rest_at + i, np.clip(rest - i, 0, 8)) for i in range(0, window - depth, 8)]
    r = ranked(keys)
    return np.bincount(r, minlength=1)[r] > 1
