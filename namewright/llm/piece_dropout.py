"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Merges of a BPE model are taken from an agenda, best score first, leftmost on ties. Each candidate
merge is skipped where a keyed hash of (seed, document id, the chunk's number in its text, chunk, place, length)
falls below the dropout rate, so every occurrence of a chunk is drawn on its own; every run of the same seed gives
the same pieces. Rate 0 gives the model's own segmentation.

Texts are cut into chunks before each space run, as no piece has a space after another character.
Decoding gives back the text exactly: spaces are the pieces' space marks, a mark that the text itself
holds and characters without a piece go through byte pieces.

Defined results: a null text is empty and has no pieces; repeated rows get equal pieces where their ids are equal; null
ids are id 0 to the hash; an empty table gives an empty result; further columns are not read. Texts are read whole.
"""

from __future__ import annotations

import heapq
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Longest chunk whose agenda is a plain list, or a row of an array; longer ones use a heap.
SHORT = 24
#: Characters of text that are encoded together (a longer text by itself).
BLOCK_CHARS = 6 << 20
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """Pieces of one model: ids and scores by text, bytes by id."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.texts = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.id = {self.texts[i]: i for i in plain}
        self.rank = {self.texts[i]: -m.get_score(i) for i in plain}  # the best score is the least rank
        self.byte_id = {int(self.texts[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the model needs all byte pieces")
        if any(re.search(f"[^{MARK}]{MARK}", t) for t in self.id):
            raise ValueError("a piece has a space mark after another character")
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = self.texts[i].replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        #: Symbols of all characters: their pieces, or numbers beyond all pieces.
        self.char_id = np.arange(0x110000, dtype=np.int32) + n
        for t, i in self.id.items():
            if len(t) == 1:
                self.char_id[ord(t)] = i
        if sys.byteorder != "little":
            raise ValueError("ids are written in the machine's order, which must be little-endian")
        self.width, self.code = ("<u2", "H") if n <= 1 << 16 else ("<u4", "I")


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


#: Mixing of a candidate's place and length into the chunk's key (64 bits).
_PLACE, _LENGTH, _FINAL, _ALL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFFFFFFFFFFFFFFFF
NEVER = float("inf")
#: What place << 5 | length adds to a key.
_SALT = np.array([((c >> 5) * _PLACE & _ALL) ^ ((c & 31) * _LENGTH & _ALL) for c in range(SHORT << 5)], np.uint64)


def skips(key: int, place: int, length: int, limit: int) -> bool:
    """Whether the candidate of so many characters at place is skipped: a keyed hash below limit (rate * 2**64). Place and length name the pair within its chunk."""
    x = (key ^ (place * _PLACE) ^ (length * _LENGTH)) & _ALL
    return ((x ^ (x >> 32)) * _FINAL & _ALL) < limit


def merge(chunk: str, p: Pieces, limit: int = 0, key: int = 0) -> tuple[list[str], int]:
    """Symbols after all merges, and how many candidates were skipped."""
    rank, sym = p.rank.get, list(chunk)
    skipped = 0
    if len(sym) <= SHORT:
        place = list(range(len(sym)))
        pairs = [rank(a + b, NEVER) for a, b in zip(sym, sym[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is NEVER:
                break
            at = pairs.index(best)  # the leftmost of the best
            pair = sym[at] + sym[at + 1]
            if limit and skips(key, place[at], len(pair), limit):
                pairs[at] = NEVER
                skipped += 1
                continue
            sym[at] = pair
            del sym[at + 1], place[at + 1], pairs[at]
            if at:
                pairs[at - 1] = rank(sym[at - 1] + pair, NEVER)
            if at < len(pairs):
                pairs[at] = rank(pair + sym[at + 1], NEVER)
        return sym, skipped
    n = len(sym)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and (r := rank(sym[i] + sym[j])) is not None:
            heapq.heappush(agenda, (r, i, j, sym[i] + sym[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while agenda:
        _, i, j, pair = heapq.heappop(agenda)
        if sym[i] is None or nxt[i] != j or sym[i] + sym[j] != pair:
            continue
        if limit and skips(key, i, len(pair), limit):
            skipped += 1
            continue
        sym[i], sym[j] = pair, None
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        offer(prv[i], i)
        offer(i, nxt[i])
    return [s for s in sym if s is not None], skipped


def chunk_ids(chunk: str, p: Pieces, limit: int, key: int) -> tuple[bytes, int]:
    sym, skipped = merge(chunk, p, limit, key)
    ids = [p.id.get(s, -1) for s in sym]
    if -1 in ids:
        ids = [x for s, i in zip(sym, ids, strict=True) for x in ([i] if i >= 0 else [p.byte_id[b] for b in s.encode()])]
    return array(p.code, ids).tobytes(), skipped


class PairTable:
    """Merged piece and rank of two pieces, for arrays of pairs: open addressing over all splits of all pieces."""

    def __init__(self, p: Pieces):
        self.n = len(p.texts)
        pairs = [(p.id[t[:i]], p.id[t[i:]], m) for t, m in p.id.items() for i in range(1, len(t)) if t[:i] in p.id and t[i:] in p.id]
        a, b, m = (np.array(c, np.int64) for c in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 3
        self.bits = max(10, int(len(a) * 4).bit_length())
        size = 1 << self.bits
        self.key, self.merged = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        rank = np.full(self.n, np.inf)
        for t, i in p.id.items():
            rank[i] = p.rank[t]
        self.rank = np.append(rank, np.inf)
        key, at = a << 32 | b, self._home(a, b)
        todo = np.arange(len(a))
        while len(todo):  # one entry for each free place and round
            free = self.key[at[todo]] == -1
            place, first = np.unique(at[todo][free], return_index=True)
            done = todo[free][first]
            self.key[place], self.merged[place] = key[done], m[done]
            todo = np.setdiff1d(todo, done, assume_unique=True)
            at[todo] = np.where(self.key[at[todo]] != -1, (at[todo] + 1) & (size - 1), at[todo])

    def _home(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (a.astype(np.uint64) * np.uint64(_PLACE) ^ b.astype(np.uint64) * np.uint64(_LENGTH)) * np.uint64(_FINAL)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged pieces, or n where two symbols make none. Symbols of n or more are no pieces."""
        out = np.full(len(a), self.n, np.int32)
        todo = np.flatnonzero((a < self.n) & (b < self.n))
        key, at = a[todo].astype(np.int64) << 32 | b[todo], self._home(a[todo], b[todo])
        while len(todo):
            there = self.key[at]
            hit = there == key
            out[todo[hit]] = self.merged[at[hit]]
            on = ~hit & (there != -1)
            todo, key, at = todo[on], key[on], (at[on] + 1) & (len(self.key) - 1)
        return out


def merge_many(chunks: list[str], keys: np.ndarray, p: Pieces, table: PairTable, limit: int, most: int | None = None, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """merge() of many chunks of at most SHORT characters at once: every step takes one candidate of each chunk.

    Returns all ids one after the other, each chunk's number of ids, and of skipped candidates. With most, no more than that many
    are skipped for a chunk, and met (chunks by longest chunk, filled with -1) takes the candidates after them in order, as place << 5 | length.
    """
    n = np.array([len(c) for c in chunks])
    width, rows = int(n.max()), np.arange(len(chunks))
    flat = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
    sym = np.full((len(chunks), width + 1), -1, np.int32)
    cols = np.arange(width + 1)
    sym[cols < n[:, None]] = p.char_id[flat]
    size = (sym >= 0).astype(np.int16)
    place = np.broadcast_to(cols.astype(np.int16), sym.shape).copy()
    none, key = table.n, np.asarray(keys, np.uint64)
    pair = np.full((len(chunks), width), none, np.int32)
    inside = cols[:width] < n[:, None] - 1
    pair[inside] = table.look(sym[:, :-1][inside], sym[:, 1:][inside])
    rank = table.rank[pair]
    skipped, n_met = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
    active = rows
    while len(active):
        at = rank[active].argmin(1)
        on = rank[active, at] < np.inf
        active, at = active[on], at[on]
        if not len(active):
            break
        length = size[active, at] + size[active, at + 1]
        if limit:
            x = key[active] ^ (place[active, at].astype(np.uint64) * np.uint64(_PLACE)) ^ (length.astype(np.uint64) * np.uint64(_LENGTH))
            gone = ((x ^ (x >> np.uint64(32))) * np.uint64(_FINAL)) < np.uint64(limit)
            if most is not None:
                gone &= skipped[active] < most
            rank[active[gone], at[gone]] = np.inf
            skipped[active[gone]] += 1
            w, i, length = active[~gone], at[~gone], length[~gone]
        else:
            w, i = active, at
        if not len(w):
            continue
        if met is not None:
            late = skipped[w] == most
            ww, ii = w[late], i[late]
            met[ww, n_met[ww]] = place[ww, ii] << 5 | length[late]
            n_met[ww] += 1
        sym[w, i], size[w, i] = pair[w, i], length
        # what lies behind the merged pair moves one place to the left
        src = np.minimum(cols + (cols > i[:, None]), width)
        src += w[:, None] * (width + 1)
        for arr in (sym, size, place):
            arr[w] = arr.reshape(-1)[src]
        sym[w, n[w] - 1], size[w, n[w] - 1] = -1, 0
        n[w] -= 1
        src = np.minimum(cols[:width] + (cols[:width] > i[:, None]), width - 1)
        src += w[:, None] * width
        pair[w], rank[w] = pair.reshape(-1)[src], rank.reshape(-1)[src]
        pair[w, width - 1], rank[w, width - 1] = none, np.inf
        for ww, ii in ((w[i > 0], i[i > 0] - 1), (w[i < n[w] - 1], i[i < n[w] - 1])):
            pair[ww, ii] = table.look(sym[ww, ii], sym[ww, ii + 1])
            rank[ww, ii] = table.rank[pair[ww, ii]]
        end = w[i >= n[w] - 1], i[i >= n[w] - 1]
        ok = end[1] < width
        pair[end[0][ok], end[1][ok]], rank[end[0][ok], end[1][ok]] = none, np.inf
    flat = sym[cols < n[:, None]]
    odd = np.flatnonzero(flat >= table.n)
    if len(odd):  # characters without a piece become bytes
        owner, parts, at = np.repeat(rows, n), [], 0
        for i in odd.tolist():
            raw = [p.byte_id[b] for b in chr(int(flat[i]) - table.n).encode()]
            parts += [flat[at:i], np.array(raw, np.int32)]
            n[owner[i]] += len(raw) - 1
            at = i + 1
        flat = np.concatenate([*parts, flat[at:]])
    return flat, n, skipped


#: Stands for a space mark that the text itself holds; no chunk has a mark after another character.
LITERAL = "x" + MARK


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of flat, one after the other."""
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class Encoder:
    """Encodes texts. variants has no effect any more: every occurrence of a chunk has a draw of its own."""

    def __init__(self, path: str, rate: float, seed: int, variants: int = 0):
        self.p, self.seed = load(path), seed
        self.limit, self.table = int(rate * 2**64), PairTable(self.p)
        self.literal = np.array([self.p.byte_id[b] for b in MARK.encode()], np.int32)

    def keys(self, chunks: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The keys of occurrences, of the hashes of their chunks and documents (with the seed) and their places among the chunks of the text."""
        x = docs + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(_LENGTH)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(_FINAL)
        x = (x ^ (x >> np.uint64(32)) ^ chunks) * np.uint64(_PLACE)
        return (x ^ (x >> np.uint64(29))) * np.uint64(_FINAL)

    def segment(self, chunks: list[str], keys: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
        """Ids one after the other, each chunk's number of ids and of skipped candidates, all candidates met after the skips and each chunk's number of them.

        No more than the first most skips of a key are made; chunks of over SHORT characters make them all, and list no candidates.
        """
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(size, kind="stable")
        flats, counts, skips_, paths, lengths, a = [], [], [], [], [], 0
        while a < len(order):
            n = size[order[a]]
            if chunks[order[a]] == LITERAL or n > SHORT:
                one = order[a]
                ids, k = (self.literal.tobytes(), 0) if chunks[one] == LITERAL else chunk_ids(chunks[one], self.p, self.limit, int(keys[one]))
                flat = np.frombuffer(ids, np.int32 if chunks[one] == LITERAL else self.p.width).astype(np.int32)
                count, k, z, met = np.array([len(flat)]), np.array([k]), a + 1, np.empty((1, 0), np.int16)
            else:
                z = min(int(np.searchsorted(size[order], min(max(6, n * 3 // 2), SHORT), "right")), a + 20_000)
                mine = order[a:z]
                stop = next((i for i, c in enumerate(mine) if chunks[c] == LITERAL), None) if n <= len(LITERAL) else None
                if stop is not None:
                    mine, z = mine[:stop], a + stop
                met = np.full((len(mine), int(size[mine[-1]])), -1, np.int16)
                flat, count, k = merge_many([chunks[i] for i in mine], keys[mine], self.p, self.table, self.limit, most, met)
            flats.append(flat)
            counts.append(count)
            skips_.append(k)
            paths.append(met[met >= 0])
            lengths.append((met >= 0).sum(1))
            a = z
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        count, length = np.concatenate(counts), np.concatenate(lengths)
        return (
            _gather(np.concatenate(flats), (np.cumsum(count) - count)[back], count[back]), count[back], np.concatenate(skips_)[back],
            _gather(np.concatenate(paths), (np.cumsum(length) - length)[back], length[back]), length[back],
        )

    def first_skips(self, keys: np.ndarray, node: np.ndarray, path: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences that skip a candidate on their node's path, and the number of the first such candidate on it."""
        start, who, which = np.cumsum(length) - length, [], []
        for a in range(0, len(node), 1 << 17):
            mine = node[a : a + (1 << 17)]
            n = length[mine]
            x = np.repeat(keys[a : a + (1 << 17)], n) ^ _SALT[_gather(path, start[mine], n)]
            gone = np.flatnonzero(((x ^ (x >> np.uint64(32))) * np.uint64(_FINAL)) < np.uint64(self.limit))
            ends = np.cumsum(n)
            owner = np.searchsorted(ends, gone, "right")
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            who.append(a + owner[first])
            which.append(gone[first] - (ends - n)[owner[first]])
        return np.concatenate(who), np.concatenate(which)

    def draw(self, different: np.ndarray, code: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each occurrence's node, and the nodes' ids, numbers of ids and of skipped candidates.

        A node is one chunk with one row of skips; its path holds the candidates that come after them. Occurrences begin at their chunk's node
        without skips and go on by the first candidate of the path that their own key skips, until it skips none; so those that skip the same
        share the work, and every one gets what its key gives it alone.
        """
        own = np.fromiter((self.limit and len(c) > SHORT for c in different), bool, len(different))
        chunk = np.flatnonzero(~own)
        at = (np.cumsum(~own) - 1)[code]
        parts, base, first, depth = [], 0, 0, 0
        if len(chunk):
            parts.append(self.segment(different[chunk].tolist(), np.zeros(len(chunk), np.uint64), 0))
            base = len(chunk)
        alone = np.flatnonzero(own[code])
        todo = np.flatnonzero(~own[code]) if self.limit else alone
        while len(todo):
            _, _, _, path, length = parts[-1]
            hit, which = self.first_skips(keys[todo], at[todo] - first, path, length)
            if not len(hit):
                break
            todo, depth = todo[hit], depth + 1
            new, rep = np.unique((at[todo] - first) << 5 | which, return_index=True)
            chunk = chunk[new >> 5]
            at[todo] = base + np.searchsorted(new, (at[todo] - first) << 5 | which)
            parts.append(self.segment(different[chunk].tolist(), keys[todo[rep]], depth))
            first, base = base, base + len(new)
        for a in range(0, len(alone), 20_000):
            mine = alone[a : a + 20_000]
            parts.append(self.segment(different[code[mine]].tolist(), keys[mine], 0))
            at[mine] = base + np.arange(len(mine))
            base += len(mine)
        return at, *(np.concatenate(x) for x in list(zip(*parts, strict=True))[:3])

    def many(self, texts: list[str], doc_ids: list[int]) -> list[tuple[bytes, int]]:
        """Little-endian ids and the number of skipped merges, for each text."""
        chunks: list[str] = []
        ends, docs = [], []
        for text, doc_id in zip(texts, doc_ids, strict=True):
            for k, part in enumerate(text.split(MARK)) if text else ():
                if k:
                    chunks.append(LITERAL)
                chunks += _CHUNK.findall(("" if k else MARK) + part.replace(" ", MARK))
            ends.append(len(chunks))
            docs.append(xxhash.xxh3_64_intdigest(f"{self.seed}/{doc_id}"))
        if not chunks:
            return [(b"", 0)] * len(texts)
        ends = np.array(ends)
        sizes = np.diff(ends, prepend=0)
        code, different = pd.factorize(np.array(chunks, object))
        del chunks
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, different), np.uint64, len(different))
        places = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        at, flat, n_ids, skipped = self.draw(different, code, self.keys(hashes[code], np.repeat(np.array(docs, np.uint64), sizes), places))
        ids = _gather(flat, (np.cumsum(n_ids) - n_ids)[at], n_ids[at]).astype(self.p.width)
        id_ends, gone = np.cumsum(n_ids[at]), np.cumsum(skipped[at])
        to = np.where(ends > 0, id_ends[ends - 1], 0)
        lost = np.where(ends > 0, gone[ends - 1], 0)
        return [(ids[a:b].tobytes(), int(y - x)) for a, b, x, y in zip([0, *to[:-1]], to, [0, *lost[:-1]], lost, strict=True)]

    def __call__(self, text: str, doc_id: int) -> tuple[bytes, int]:
        return self.many([text], [doc_id])[0]


@lru_cache(maxsize=1)
def encoder(path: str, rate: float, seed: int) -> Encoder:
    """One for each worker process."""
    return Encoder(path, rate, seed)


def decode_ids(ids: np.ndarray, p: Pieces) -> str:
    raw = p.raw
    return b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, ids (binary, 16 or 32 bits little-endian), n_pieces, n_skipped, text_sha256 (of what was encoded)."""
    import hashlib

    def run(batches):
        enc = encoder(model, rate, seed)
        wide = np.dtype(enc.p.width).itemsize
        for b in batches:
            texts = [x or "" for x in b[1].to_pylist()]
            ends, held = [], 0
            for i, x in enumerate(texts):
                held += len(x)
                if held > BLOCK_CHARS or i == len(texts) - 1:
                    ends.append(i + 1)
                    held = 0
            for a, z in zip([0, *ends], ends, strict=False):
                s, part = b.slice(a, z - a), texts[a:z]
                got = enc.many(part, [i or 0 for i in s[0].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [s[0], pa.array([g[0] for g in got], pa.binary()), pa.array([len(g[0]) // wide for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in part])],
                    ["doc_id", "ids", "n_pieces", "n_skipped", "text_sha256"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids binary, n_pieces long, n_skipped long, text_sha256 string")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with the column text, decoded from ids."""
    names = encoded.columns

    def run(batches):
        p = load(model)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                s = b.slice(a, 256)
                text = [decode_ids(np.frombuffer(x, p.width), p) if x else "" for x in s["ids"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*[s[c] for c in names], pa.array(text, pa.string())], [*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, schema + ", text string")
