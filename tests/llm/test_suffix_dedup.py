"""op9: removed bytes against all windows, suffix arrays against sorting, anchors against direct search."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from namewright.llm import anchors, suffix_dedup
from namewright.llm.suffix_array import CoverRanks, difference_cover, repeated_windows, suffix_array
from tests.llm.conftest import SCHEMA, sentence


def brute(rows, n):
    data = [(i, (t or "").encode()) for i, t in rows]
    c = Counter(x[i : i + n] for _, x in data for i in range(len(x) - n + 1))
    out = []
    for d, x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if c[x[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((d, len(x), sum(gone), len([1 for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def check(docs, n=400, **kw):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = suffix_dedup.remove(docs, window=n, **kw).collect()
    got = sorted(((r.doc_id, r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out), key=repr)
    assert got == brute(rows, n)


@pytest.mark.parametrize("name", ["odd", "clashing", "some"])
@pytest.mark.parametrize("most", [8192, 1])
def test_all_windows(request, name, most):
    check(request.getfixturevalue(name), max_contexts=most)


@pytest.mark.parametrize("n", [16, 17, 50, 100])
def test_short_windows(spark, n):
    rng = random.Random(n)
    rows = [(i, "".join(rng.choice("ab") if i % 3 else rng.choice("abcdefgh") for _ in range(rng.randrange(0, 400))), None, None, None) for i in range(40)]
    cut = rows[3][1] * 3 + rows[6][1] + rows[9][1]
    rows += [(50 + k, rows[k][1][: 2 * n] + cut[k * 7 : k * 7 + 3 * n] + "é" * k, None, None, None) for k in range(12)]
    d = spark.createDataFrame(rows, SCHEMA)
    check(d, n)
    check(d, n, max_contexts=2)


def test_small_blocks(spark, some, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1000)
    check(some)


def test_empty_and_text(spark, none):
    assert suffix_dedup.remove(none).count() == 0
    shared = "".join(random.Random(1).choice("äöüß") for _ in range(300))
    rows = [(1, "a" + shared + "é1", None, None, None), (2, "b" + shared + "è2", None, None, None)]
    out = {r.doc_id: r.kept for r in suffix_dedup.remove(spark.createDataFrame(rows, SCHEMA), as_text=True).collect()}
    assert out == {1: "a1", 2: "b2"}  # the cut takes the equal first byte of é and è


def query(spark, d):
    out = entry.queries()["op9_suffix_dedup"](spark, str(d))
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert query(spark, sf) == brute(rows, 400)


@pytest.mark.parametrize("n", [300, 399, 400])
def test_passages_of_over_fifty_words(spark, tmp_path, n):
    """The contract goes by bytes: a shared passage of over 50 words goes from 400 bytes on and stays below; n_bytes is the input's length either way."""
    rng = random.Random(n)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n // 5 + 1))[: n - 1] + "."
    assert len(passage) == n and len(passage.split()) > 50
    # the letters beside a passage differ, so nothing longer is shared
    rows = [(i, f"{sentence(rng, 30)} {i}{passage}{i} {sentence(rng, 30)}", "en", "s", 1) for i in range(4)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = query(spark, tmp_path)
    assert got == brute([r[:2] for r in rows], 400)
    assert [r[1:4] for r in got] == [(len(t.encode()), n if n >= 400 else 0, int(n >= 400)) for _, t, *_ in rows]


def test_covers():
    for v in (8, 16, 32, 64, 128):
        d, shift = difference_cover(v)
        inside = set(d.tolist())
        assert all((i + shift[i, j]) % v in inside and (j + shift[i, j]) % v in inside for i in range(v) for j in range(v))
        assert len(d) <= 0.7 * v


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 6), st.sampled_from([8, 16, 64]))
def test_suffix_array(part, times, v):
    x = part * times
    assert suffix_array(x, v).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_cover_ranks_compare():
    rng = random.Random(2)
    x = bytes(rng.choice(b"ab") for _ in range(400)) * 2
    c = CoverRanks(np.frombuffer(x, np.uint8), 16, 512)
    for _ in range(500):
        i, j = rng.randrange(300), rng.randrange(300)
        a, b = x[i : i + 400], x[j : j + 400]
        if len(a) == len(b) == 400 and a != b:
            assert c.compare(i, j) == (-1 if a < b else 1)


def test_repeated_windows():
    rng = random.Random(3)
    for n in (16, 40, 100):
        ctx = [bytes(rng.choice(b"ab") for _ in range(n + 20)) for _ in range(6)]
        ctx += [c[:5] + ctx[0][5:] for c in ctx] + [ctx[1][:-3] + b"zzz"]
        counts, offs = np.array([21] * len(ctx)), np.array([20] * len(ctx))
        flags = repeated_windows(ctx, np.zeros(len(ctx), np.int64), counts, offs, n)
        want = [sum(d[j : j + n] == c[j : j + n] for d in ctx) > 1 for c in ctx for j in range(21)]
        assert flags.tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.integers(1, 12))
def test_leftmost_least(g, w):
    if w <= len(g):
        assert anchors.leftmost_least(np.array(g, np.uint64), w).tolist() == [i + min(range(w), key=lambda k, i=i: (g[i + k], k)) for i in range(len(g) - w + 1)]


def test_runs_cover_all_windows():
    rng = random.Random(5)
    x = bytes(rng.choice(b"abc") for _ in range(700)) * 2
    for piece in (1 << 22, 100):
        key, ctx, start, n, off = anchors.runs(x, 60, 15, piece)
        assert start.tolist() == np.concatenate([[0], np.cumsum(n)[:-1]]).tolist() and n.sum() == len(x) - 59
        assert (off - n + 1 >= 0).all() and (off <= 45).all()
    # equal windows have equal anchors at equal distances
    place = {}
    for k, s, m, o in zip(key, start, n, off, strict=True):
        for j in range(m):
            place.setdefault(x[s + j : s + j + 60], set()).add((k, o - j))
    assert all(len(v) == 1 for v in place.values())
