"""Language model scoring with a hidden Markov model.

Words become symbols of a bounded alphabet: the most frequent words are symbols of their own, other
words share one symbol for each hash of their last bytes. Latent states emit symbols; a word within a
shared symbol has its add-one share of that symbol. Every Baum-Welch round runs over all training
texts, whole: forward and backward messages pass from one stretch of a text to the next, so no
transition is left out. Counts are summed over the partitions; only the model (states x symbols
numbers, a bound set by parameters) meets on the driver. Scores are exact likelihoods by the scaled
forward recursion, many texts at a time.

Defined results: a null text is empty (its end token alone is scored); a null id belongs to the
training part; repeated rows count and are scored each on its own; with no training rows all tokens
are unknown; an empty table gives an empty result; further columns are not read. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import stored

#: The end of a text, as a word: no word is empty.
END = ""
SUFFIX = 3
#: Tokens of a stretch; tokens of the texts that are worked on together; bytes of text that are split into words together.
STRETCH, BLOCK_TOKENS, BLOCK_BYTES = 128, 1 << 19, 8 << 20


@dataclass
class Model:
    start: np.ndarray  # states, at the start of a text
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words as UTF-8, then the end."""
    return [*(text or "").encode().lower().split(), b""]


def word_blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.DictionaryArray]]:
    """The words of tokens(), without the ends, for stretches of rows of bounded size: (first row, row of each word, words)."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    size = np.cumsum(pc.binary_length(texts).to_numpy(False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BLOCK_BYTES, "right")))
        lists = pc.ascii_split_whitespace(texts[a:b])
        n, flat = pc.list_value_length(lists).to_numpy(False), lists.flatten()
        row, there = np.repeat(np.arange(b - a), n), pc.greater(pc.binary_length(flat), 0)
        yield a, row[there.to_numpy(False)], flat.filter(there).dictionary_encode()
        a = b


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the texts in column text; counted in each block before the shuffle."""

    def run(batches):
        for b in batches:
            for _, _, w in word_blocks(b[0]):
                yield pa.RecordBatch.from_arrays([w.dictionary, pa.array(np.bincount(w.indices.to_numpy(False), minlength=len(w.dictionary)))], ["word", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([b.num_rows])], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def shape(word: bytes, shapes: int) -> int:
    return zlib.crc32(word[-SUFFIX:]) % shapes


def shape_column(word: Column, shapes: int) -> Column:
    """shape() as a column."""
    return F.pmod(F.crc32(F.substring(word.cast("binary"), -SUFFIX, SUFFIX)), F.lit(shapes))


def encode(docs: DataFrame, lookup, frequent: int, shapes: int) -> DataFrame:
    """Each text as symbols, with what the lookup knows of its words and the list of the others.

    lookup: broadcast dict, word -> (symbol or -1, count). Symbols below frequent are words of their own.
    """

    def run(batches):
        known, part, n_row = lookup.value, TaskContext.get().partitionId(), 0
        memo: dict[bytes, int] = {}

        def symbol(w: bytes) -> int:
            s = known.get(w, (-1, 0))[0]
            if s < 0:
                s = memo.get(w[-SUFFIX:])
                if s is None:
                    s = memo[w[-SUFFIX:]] = frequent + shape(w, shapes)
            return s

        end, end_count = symbol(b""), known.get(b"", (-1, 0))[1]
        for b in batches:
            for a, row, words in word_blocks(b["text"]):
                k = (int(row[-1]) if len(row) else 0) + 1
                listed, at = words.dictionary.cast(pa.binary()).to_pylist(), words.indices.to_numpy(False)
                count = np.array([known.get(w, (-1, 0))[1] for w in listed], np.int64)
                code = np.array([symbol(w) for w in listed], np.uint16)
                log = np.log10(count + 1.0)
                n = np.bincount(row, minlength=k)
                seen = np.bincount(row, count[at] > 0 if len(at) else None, minlength=k) if len(at) else np.zeros(k)
                log_seen = np.bincount(row, log[at], minlength=k) if len(at) else np.zeros(k)
                syms, edges = code[at] if len(at) else np.empty(0, np.uint16), np.concatenate([[0], np.cumsum(n)])
                out = np.empty(len(syms) + k, np.uint16)
                out[np.arange(len(syms)) + row] = syms
                out[edges[1:] + np.arange(k)] = end
                # words that the lookup does not have, once a text with their number
                new = np.flatnonzero(count[at] == 0) if len(at) else np.empty(0, np.int64)
                pair, times = np.unique(row[new].astype(np.int64) * max(1, len(listed)) + at[new], return_counts=True)
                rest_at = np.concatenate([[0], np.cumsum(np.bincount(pair // max(1, len(listed)), minlength=k))]).astype(np.int32)
                own = b.slice(a, k)
                bounds = (2 * (edges + np.arange(k + 1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array((part << 33) + n_row + np.arange(k)), own["doc_id"], own["held_out"], pa.array((n + 1).astype(np.int64)), pa.array(seen.astype(np.int64) + int(end_count > 0)), pa.array(log_seen + np.log10(end_count + 1.0)),
                    pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes())]),
                    pa.ListArray.from_arrays(pa.array(rest_at), words.dictionary.take(pa.array(pair % max(1, len(listed))))), pa.ListArray.from_arrays(pa.array(rest_at), pa.array(times.astype(np.int32))),
                ], ["key", "doc_id", "held_out", "n_tokens", "n_seen", "log_seen", "symbols", "rest", "rest_n"])
                n_row += k

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, n_seen long, log_seen double, symbols binary, rest array<string>, rest_n array<int>")


def blocks(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Sequences that are worked on together, longest first: (their places, their symbols by stretch).

    Stretch r has one row for each token and one column for each sequence that goes on so far, and -1 behind a sequence's end.
    """
    size = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    at = 0
    while at < len(order):
        n = max(1, int(np.searchsorted(np.cumsum(size[order[at:]]), BLOCK_TOKENS, "right")))
        mine = order[at : at + n]
        flat = np.concatenate([sequences[i] for i in mine]).astype(np.int64)
        begin = np.cumsum(size[mine]) - size[mine]
        out = []
        for r in range(-(-int(size[mine[0]]) // STRETCH)):
            on = int(np.searchsorted(-size[mine], -r * STRETCH, "left"))  # these have more than r * STRETCH tokens
            t = r * STRETCH + np.arange(min(STRETCH, int(size[mine[0]]) - r * STRETCH))[:, None]
            inside = t < size[mine[:on]]
            out.append(np.where(inside, flat[np.minimum(begin[:on] + t, len(flat) - 1)], -1))
        yield mine, out
        at += n


def _emitted(m: Model, x: np.ndarray) -> np.ndarray:
    """Emission probabilities (token, state, sequence), 1 behind a sequence's end."""
    e = np.empty((x.shape[0], m.move.shape[0], x.shape[1]))
    wide = np.vstack([m.emit, np.ones(m.emit.shape[1])])
    for i in range(e.shape[1]):
        e[:, i, :] = np.ascontiguousarray(wide[:, i])[x]
    return e


def _forward(m: Model, e: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward values of a stretch and their scales; now: what its first tokens are emitted from."""
    alpha, scale, back, moved = np.empty_like(e), np.empty((e.shape[0], e.shape[2])), np.ascontiguousarray(m.move.T), np.empty(e.shape[1:])
    for t, (a, s) in enumerate(zip(alpha, scale, strict=True)):
        np.multiply(np.matmul(back, now, out=moved) if t else now, e[t], out=a)
        np.add.reduce(a, axis=0, out=s)
        a /= s
        now = a
    return alpha, scale


def expect(m: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (start, moves, emissions) of whole sequences by forward and backward recursion.

    Of a sequence longer than a block, forward values are kept at the borders of stretches only and computed
    again on the way back, so memory does not grow with a text's length beyond its symbols.
    """
    k, n_sym = m.move.shape[0], m.emit.shape[0]
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((n_sym, k))
    for _, parts in blocks(sequences):
        into, last, held = [np.repeat(m.start[:, None], parts[0].shape[1], 1)], [], []
        small = sum(x.size for x in parts) <= 2 * BLOCK_TOKENS
        for r, x in enumerate(parts):
            held.append((e := _emitted(m, x), *_forward(m, e, into[r])))
            last.append(held[r][1][-1].copy())
            if not small:
                held[r] = None
            if r + 1 < len(parts):
                into.append(m.move.T @ last[r][:, : parts[r + 1].shape[1]])
        beta = np.ones((k, parts[-1].shape[1]))
        for r in range(len(parts) - 1, -1, -1):
            x = parts[r]
            e, alpha, scale = held.pop() or (e := _emitted(m, x), *_forward(m, e, into[r]))
            if beta.shape[1] < x.shape[1]:  # sequences that end in this stretch
                beta = np.concatenate([beta, np.ones((k, x.shape[1] - beta.shape[1]))], 1)
            there, ahead = x >= 0, np.empty_like(beta)
            whole = there.all(1).tolist()
            for t in range(len(x) - 1, -1, -1):
                np.multiply(e[t], beta, out=ahead)
                ahead /= scale[t]
                np.multiply(alpha[t], beta, out=e[t])
                before = alpha[t - 1] if t else (last[r - 1][:, : x.shape[1]] if r else None)
                if before is not None:
                    move += (before if whole[t] else before * there[t]) @ ahead.T
                np.matmul(m.move, ahead, out=beta)
            if r == 0:
                start += e[0].sum(1)
            keep = x[there]
            for i in range(k):
                emit[:, i] += np.bincount(keep, e[:, i, :][there], minlength=n_sym)
    return start, m.move * move, emit


def maximise(counts: tuple, unigram: np.ndarray, weight: float = 50.0) -> Model:
    """The model of these expected counts, smoothed towards even starts and moves and the unigram emissions."""
    start, move, emit = counts
    share = lambda v: (v + 1.0) / (v.sum(-1, keepdims=True) + v.shape[-1])
    return Model(share(start), share(move), (emit + weight * unigram[:, None]) / (emit.sum(0) + weight))


def first_model(states: int, unigram: np.ndarray, seed: int) -> Model:
    """A start for training: emissions of seeded noise about the unigram, and states that mostly stay."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.uniform(0.5, 1.5, (len(unigram), states))
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def train_round(coded: DataFrame, m: Model, unigram: np.ndarray) -> Model:
    """One Baum-Welch round over all training rows: counts are summed in each task, then by index across tasks."""
    spark, (n_sym, k) = coded.sparkSession, m.emit.shape
    shared = spark.sparkContext.broadcast(m)

    def run(batches):
        total = None
        for b in batches:
            part = np.vstack(expect(shared.value, [np.frombuffer(x, np.uint16) for x in b[0].to_pylist()]))
            total = part if total is None else total + part
        if total is not None:
            used = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(total[used, i]) for i in range(k)]], ["i", *[f"s{i}" for i in range(k)]])

    rows = coded.filter(~F.col("held_out")).select("symbols").mapInArrow(run, "i long, " + ", ".join(f"s{i} double" for i in range(k))).groupBy("i").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).collect()
    all_rows = np.zeros((1 + k + n_sym, k))
    for r in sorted(rows, key=lambda r: r[0]):
        all_rows[r[0]] = r[1:]
    shared.unpersist()
    return maximise((all_rows[0], all_rows[1 : 1 + k], all_rows[1 + k :]), unigram)


def log_likelihoods(m: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of each sequence's exact probability under the model."""
    out, back = np.zeros(len(sequences)), np.ascontiguousarray(m.move.T)
    for mine, parts in blocks(sequences):
        now = np.repeat(m.start[:, None], len(mine), 1)
        for r, x in enumerate(parts):
            e = _emitted(m, x)
            now = now[:, : x.shape[1]]
            for t in range(len(x)):
                now = (back @ now if t or r else now) * e[t]
                if t % 8 == 7 or t == len(x) - 1:
                    total = now.sum(0)
                    out[mine[: x.shape[1]]] += np.log10(total)
                    now = now / total
    return out


def score(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = 6, frequent: int = 4096, shapes: int = 1024,
    looked_up: int = 131_072, rounds: int = 6, seed: int = 1,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (the model), both log10.

    frequent, shapes and looked_up bound what is broadcast. Counts of words beyond the looked_up most
    frequent come by a join, in which no key is hot. Every round uses every training text whole.
    """
    if frequent + shapes > 1 << 16:
        raise ValueError("frequent + shapes must fit 16 bits")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    counts = stored(count_words(rows.filter(~F.col("held_out"))), "lm-counts")
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0))).first()
    # the looked-up words are those of the highest counts, cut where a fine logarithmic class of counts would pass the bound
    counts = counts.withColumn("high", F.floor(16 * F.log2("c")))
    cut, have = None, 0
    for high, size in counts.groupBy("high").count().orderBy(F.desc("high")).collect():
        if have + size > looked_up:
            break
        cut, have = high, have + size
    cut = 1 << 20 if cut is None else cut
    top = sorted(counts.filter(F.col("high") >= cut).select("word", "c").collect(), key=lambda r: (-r[1], r[0]))
    lookup = {r[0].encode(): (i if i < frequent else -1, r[1]) for i, r in enumerate(top)}
    lookup.setdefault(END.encode(), (-1, ends))  # encode() has no list entry for the ends
    own = [r[0] for r in top[:frequent]]
    rare = counts.filter(F.col("high") < cut)
    # N and V of each shared symbol: those of all words less those of the frequent ones
    by_shape = np.zeros((shapes, 2))
    for s, sn, sv in counts.groupBy(shape_column(F.col("word"), shapes).alias("s")).agg(F.sum("c"), F.count("*")).collect():
        by_shape[s] += (sn, sv)
    for w in own:
        by_shape[shape(w.encode(), shapes)] -= (lookup[w.encode()][1], 1)
    log_shape = np.log10(by_shape.sum(1) + 1)
    held = spark.sparkContext.broadcast(lookup)
    coded = stored(encode(rows, held, frequent, shapes), "lm-coded")
    mass = np.concatenate([[lookup[w.encode()][1] for w in own], np.zeros(frequent - len(own)), by_shape[:, 0]])
    unigram = (mass + 1) / (mass.sum() + len(mass))
    m = first_model(states, unigram, seed)
    for _ in range(rounds):
        m = train_round(coded, m, unigram)
    model, own_codes = spark.sparkContext.broadcast(m), frequent

    def run(batches):
        for b in batches:
            seqs = [np.frombuffer(x, np.uint16) for x in b["symbols"].to_pylist()]
            ll = log_likelihoods(model.value, seqs)
            # within shared symbols: minus log10 of the symbol's total; the words' own parts come from the counts
            less = np.array([log_shape[s[s >= own_codes] - own_codes].sum() for s in seqs])
            # words that are symbols of their own have no part within: take their log10(c + 1) out again
            free = np.array([log_own[s[s < own_codes]].sum() for s in seqs])
            yield pa.RecordBatch.from_arrays([b["key"], b["doc_id"], b["held_out"], b["n_tokens"], b["n_seen"], b["log_seen"], pa.array(ll - less - free)], ["key", "doc_id", "held_out", "n_tokens", "n_seen", "log_seen", "ll"])

    log_own = np.log10(mass[:frequent] + 1)
    scored = coded.select("key", "doc_id", "held_out", "n_tokens", "n_seen", "log_seen", "symbols").mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, n_seen long, log_seen double, ll double")
    rest = coded.select("key", F.explode(F.arrays_zip("rest", "rest_n")).alias("r")).select("key", F.col("r.rest").alias("word"), F.col("r.rest_n").alias("tf"))
    rest = rest.join(rare, "word").groupBy("key").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("log_more"))
    out = scored.join(rest, "key", "left")
    logs = F.col("log_seen") + F.coalesce("log_more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_seen") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), (logs + F.col("ll")).alias("score"),
    )
