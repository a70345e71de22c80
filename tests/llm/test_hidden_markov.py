"""op3: the base by a plain count, exact likelihoods by plain recursion, and gain on held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewright.llm import hidden_markov as hm
from tests.llm.conftest import by_id


def held():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2


def plain_forward(m, seq):
    a, total = m.start * m.emit[seq[0]], 0.0
    for t, s in enumerate(seq):
        if t:
            a = (a @ m.move) * m.emit[s]
        total += math.log10(a.sum())
        a = a / a.sum()
    return total


def random_model(rng, k=3, n=11):
    share = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s) + 0.05)
    return hm.Model(share(k), share(k, k), share(k, n).T.copy())


def test_exact_likelihood():
    rng = np.random.default_rng(2)
    m = random_model(rng)
    seqs = [rng.integers(0, 11, n) for n in (1, 2, 63, 64, 65, 128, 1000, 5)]
    assert np.allclose(hm.log_likelihoods(m, seqs), [plain_forward(m, s) for s in seqs], rtol=1e-10)
    short = sum(10 ** plain_forward(m, np.array([a, b])) for a in range(11) for b in range(11))
    assert abs(short - 1) < 1e-9


def plain_counts(m, seq):
    """Expected counts of one sequence by textbook recursions over all of it."""
    k, n = len(m.start), len(seq)
    a, b = np.empty((n, k)), np.ones((n, k))
    for t, s in enumerate(seq):
        a[t] = (m.start if t == 0 else a[t - 1] @ m.move) * m.emit[s]
        a[t] /= a[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = m.move @ (m.emit[seq[t + 1]] * b[t + 1])
        b[t] /= b[t].sum()
    g = a * b
    g /= g.sum(1, keepdims=True)
    move, emit = np.zeros((k, k)), np.zeros_like(m.emit)
    for t in range(n - 1):
        x = a[t][:, None] * m.move * (m.emit[seq[t + 1]] * b[t + 1])[None, :]
        move += x / x.sum()
    np.add.at(emit, seq, g)
    return g[0], move, emit


def test_expected_counts(monkeypatch):
    """A round over stretches equals one over whole sequences, whatever is worked on together."""
    rng = np.random.default_rng(3)
    m = random_model(rng, 3, 7)
    seqs = [rng.integers(0, 7, n).astype(np.uint16) for n in (1, 7, 128, 130, 0, 700, 256, 129, 384, 2)]
    want = [sum(c) for c in zip(*[plain_counts(m, s) for s in seqs if len(s)], strict=True)]
    for most in (1 << 20, 300, 1):
        monkeypatch.setattr(hm, "BLOCK_TOKENS", most)
        for got, w in zip(hm.expect(m, seqs), want, strict=True):
            assert np.allclose(got, w, rtol=1e-9, atol=1e-9)
        assert np.allclose(hm.log_likelihoods(m, [s for s in seqs if len(s)]), [plain_forward(m, s) for s in seqs if len(s)], rtol=1e-10)


def test_words_in_blocks(monkeypatch):
    """Arrow's words are those of tokens()."""
    import pyarrow as pa

    texts = ["A b  C", None, "", " \x0b\x0c x\ty\n", "É ÀB \x00 \x1c q\u00a0r \u2003 Z", "  ", "Ünïcode ẞ İI", "x" * 50]
    for most in (16 << 20, 5):
        monkeypatch.setattr(hm, "BLOCK_BYTES", most)
        got = [[] for _ in texts]
        for a, row, w in hm.word_blocks(pa.array(texts)):
            for r, x in zip(row, w.to_pylist(), strict=True):
                got[a + r].append(x.encode())
        assert got == [hm.tokens(t)[:-1] for t in texts]


def test_training_raises_likelihood():
    rng = np.random.default_rng(4)
    true = random_model(rng, 2, 6)
    seqs = []
    for _ in range(60):
        z, out = rng.choice(2, p=true.start), []
        for _ in range(50):
            out.append(rng.choice(6, p=true.emit[:, z]))
            z = rng.choice(2, p=true.move[z])
        seqs.append(np.array(out))
    uni = np.bincount(np.concatenate(seqs), minlength=6) / 3000
    m, last = hm.first_model(2, uni, 1), -1e9
    for _ in range(5):
        now = hm.log_likelihoods(m, seqs).sum()
        assert now > last - 1e-6
        last, m = now, hm.maximise(hm.expect(m, seqs), uni, 0.01)


def base(rows):
    tok = lambda t: [*(t or "").encode().lower().split(), b""]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not out(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t))) for i, t in rows]


@pytest.mark.parametrize("name", ["odd", "clashing", "some"])
def test_base(request, name):
    docs = request.getfixturevalue(name)
    want = sorted(base([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    for looked_up in (5, 131_072):  # most counts by the join, or none
        out = hm.score(docs, held(), looked_up=looked_up, frequent=min(4, looked_up), shapes=16, rounds=1).collect()
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out), key=repr)
        assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want])
        assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_whole_score(spark):
    """The score of a text by hand: forward recursion over symbols, and words' shares of shared symbols."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "a a d", "e f a", "b c d e f g h", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = by_id(hm.score(docs, F.lit(False), states=1, frequent=2, shapes=4, rounds=1))
    words = Counter(w for _, t in rows for w in [*t.encode().split(), b""])
    own = sorted(words, key=lambda w: (-words[w], w.decode()))[:2]
    shape = lambda w: hm.shape(w, 4)
    n_s, v_s = Counter(), Counter()
    for w, c in words.items():
        if w not in own:
            n_s[shape(w)] += c
            v_s[shape(w)] += 1
    n_sym = 6
    mass = np.array([*(words[w] for w in own), *(n_s[s] for s in range(4))], float)
    uni = (mass + 1) / (mass.sum() + n_sym)
    emit = (mass + 50 * uni) / (mass.sum() + 50)
    for i, t in rows:
        p = 0.0
        for w in [*t.encode().split(), b""]:
            p += math.log10(emit[own.index(w)]) if w in own else math.log10(emit[2 + shape(w)]) + math.log10((words[w] + 1) / (n_s[shape(w)] + v_s[shape(w)] + 1))
        assert abs(out[i].score - p) < 1e-6


def test_held_out_gain(spark):
    import random

    from tests.llm.conftest import SCHEMA

    rng = random.Random(8)
    a, b = ["alpha", "beta", "gamma", "delta"], ["uno", "dos", "tres", "cuatro"]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(60)), "en", "s", 1) for i in range(150)]
    out = hm.score(spark.createDataFrame(rows, SCHEMA), held(), states=2, frequent=16, shapes=8).filter("held_out").collect()
    assert len(out) > 5 and all(r.score > r.base_score + 5 for r in out)


def test_empty(none):
    assert hm.score(none, held()).count() == 0
