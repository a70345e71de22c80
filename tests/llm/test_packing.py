"""op1: pieces against plain tokenization, and equal ids of the two libraries."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from namewright.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 100_000), st.sampled_from([1, 2, 64, 2048]))
def test_pieces(n, longest):
    p = packing.pieces(n, longest)
    assert sum(p) == n and all(x & (x - 1) == 0 and x <= longest for x in p) and p == sorted(p, reverse=True)
    assert len(p) == n // longest + bin(n % longest).count("1")


@pytest.mark.parametrize("name", ["odd", "clashing", "some"])
def test_pack(request, name):
    docs, t = request.getfixturevalue(name), Tokenizer.from_file(PATH)
    rows = packing.pack(docs, PATH).collect()
    want = sorted([*t.encode(x or "", add_special_tokens=False).ids, 1] for x in (r.text for r in docs.collect()))
    got, parts = [], {}
    for r in rows:
        ids = np.frombuffer(r.tokens, "<u4")
        assert len(ids) == r.length == 1 << r.bucket and r.offset == 0
        parts.setdefault((r.sequence_id >> 41, r.doc_id), []).append((r.sequence_id, r.start, r.doc_tokens, ids.tolist()))
    assert len({r.sequence_id for r in rows}) == len(rows)
    at = []
    for r in rows:  # pieces of a document come one after the other
        if r.start == 0:
            at.append([])
        assert len(at[-1]) == r.start
        at[-1] += np.frombuffer(r.tokens, "<u4").tolist()
        if len(at[-1]) == r.doc_tokens:
            got.append(at[-1])
    assert sorted(got) == want


def test_empty(none):
    assert packing.pack(none, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, PATH, longest=100)


def test_fast_way_has_equal_ids():
    """Every character that the faster library may see, in several surroundings."""
    ids, t = packing.encoder(PATH), Tokenizer.from_file(PATH)
    for c in map(chr, range(ord(packing.FAST_BELOW))):
        for text in (c, f"a{c}b", f" {c}{c} x{c}", f"{c} {c}\n{c}1{c}'s{c}", f"A{c}{c}{c}9 {c}"):
            assert ids(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=60))
def test_fast_way_on_random_texts(text):
    assert packing.encoder(PATH)(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids if text else True
