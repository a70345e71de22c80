"""op8: equal to the library without dropout, lossless with it, and the many-at-once way equal to the plain one."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namewright.llm import piece_dropout as pd_
from tests.llm.conftest import corpus

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_rate_zero_is_the_library():
    sp, e = sentencepiece.SentencePieceProcessor(model_file=PATH), pd_.Encoder(PATH, 0.0, 1, 1)
    for t in [r[1] for r in corpus(40)] + ["a  b   c", "  lead", "trail  ", "x" * 80 + " abc" * 9, "中文 \U0001f600\n\tq", "Ünïcödé", "don't stop-me.now"]:
        assert np.frombuffer(e(t, 1)[0], e.p.width).tolist() == sp.encode(t)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.sampled_from([0.0, 0.1, 0.6, 0.99]), st.integers(0, 3))
def test_lossless(text, rate, seed):
    text = text.encode("utf-8", "ignore").decode()
    e = pd_.Encoder(PATH, rate, seed, 3)
    ids = np.frombuffer(e(text, seed)[0], e.p.width)
    assert (pd_.decode_ids(ids, e.p) if len(ids) else "") == text


def test_many_is_the_plain_way(monkeypatch):
    p = pd_.load(PATH)
    table, rng = pd_.PairTable(p), random.Random(1)
    chunks = sorted({c for _, t, *_ in corpus(60) for c in pd_._CHUNK.findall("▁" + t.replace(" ", "▁"))} | {"▁", "é\U0001f600", "a" * pd_.SHORT, "\x00"}, key=len)
    keys = [rng.getrandbits(64) for _ in chunks]
    for rate in (0.0, 0.1, 0.7):
        limit = int(rate * 2**64)
        one = [pd_.chunk_ids(c, p, limit, k) for c, k in zip(chunks, keys, strict=True)]
        flat, n, skipped = pd_.merge_many(chunks, keys, p, table, limit)
        parts = np.split(flat.astype(p.width), np.cumsum(n)[:-1])
        assert [(x.tobytes(), k) for x, k in zip(parts, skipped.tolist(), strict=True)] == one
        monkeypatch.setattr(pd_, "SHORT", 0)  # the heap
        assert [pd_.chunk_ids(c, p, limit, k) for c, k in zip(chunks, keys, strict=True)] == one
        monkeypatch.undo()


def test_texts_together_or_alone():
    e, texts = pd_.Encoder(PATH, 0.3, 1, 4), [r[1] for r in corpus(40)] + ["", "a▁b ▁ c", "▁", "y" * 100, "x▁x"]
    assert e.many(texts, list(range(len(texts)))) == [e(t, i) for i, t in enumerate(texts)]


def test_seeds_vary_and_repeat():
    t = corpus(5)[4][1] * 5
    a, b, c = (pd_.Encoder(PATH, 0.2, s, 4)(t, 1) for s in (1, 1, 2))
    assert a == b and a[0] != c[0] and a[1] > 0


def test_every_occurrence_is_drawn():
    e, p = pd_.Encoder(PATH, 0.1, 1), pd_.load(PATH)
    texts = [r[1] for r in corpus(40)] + ["y" * 60 + " the " * 300 + "x▁x"] * 3
    got = e.many(texts, list(range(len(texts))))
    for (ids, skipped), text, doc_id in zip(got, texts, range(len(texts)), strict=True):  # what each key gives alone
        parts = [c for k, x in enumerate(text.split("▁")) for c in ([None] if k else []) + pd_._CHUNK.findall(("" if k else "▁") + x.replace(" ", "▁"))]
        chunks = np.array([pd_.xxhash.xxh3_64_intdigest(c or pd_.LITERAL) for c in parts], np.uint64)
        keys = e.keys(chunks, np.full(len(parts), pd_.xxhash.xxh3_64_intdigest(f"1/{doc_id}"), np.uint64), np.arange(len(parts)))
        one = [(e.literal.astype(p.width).tobytes(), 0) if c is None else pd_.chunk_ids(c, p, e.limit, int(k)) for c, k in zip(parts, keys, strict=True)]
        assert (ids, skipped) == (b"".join(x for x, _ in one), sum(k for _, k in one))
    # copies under other ids have segmentations of their own, and a word of one text is skipped at about the rate
    text = "the stone of the river is quiet in the harbor and the lantern"
    assert len({ids for ids, _ in e.many([text] * 300, list(range(300)))}) > 100
    for word in ("▁x", "▁of"):
        limit = len(pd_.merge(word, p)[0]) < len(word)
        ids, skipped = e(word[1:] + (" " + word[1:]) * 9999, 7)
        assert not limit or 850 < skipped < 1150 * (len(word) - 1)


@pytest.mark.parametrize("name", ["odd", "clashing", "none"])
def test_query(request, name):
    d = request.getfixturevalue(name)
    out = pd_.decode(pd_.encode(d, PATH), PATH)
    got = sorted((((r.doc_id, r.text) for r in out.collect())), key=repr)
    assert got == sorted(((r.doc_id, r.text or "") for r in d.collect()), key=repr)
    assert out.filter(F.sha2("text", 256) != F.col("text_sha256")).count() == 0
