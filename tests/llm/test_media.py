"""op6: exact round trip through WAV, transforms against a direct sum, and equal values for equal texts."""

import hashlib
import io
import wave
import zlib

import numpy as np
import pytest

from namewright.llm import media


@pytest.mark.parametrize("name", ["odd", "clashing", "some"])
def test_round_trip(request, name):
    docs = request.getfixturevalue(name)
    texts = sorted(((r.doc_id, (r.text or "").encode()) for r in docs.collect()), key=repr)
    enc = media.encode(docs)
    out = media.analyse(enc).collect()
    assert len(out) == len(texts)
    want = []
    for i, b in texts:
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out), key=repr) == sorted(want, key=repr)
    same = {}
    for r in out:
        assert same.setdefault(r.payload_sha256, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)
        assert r.n_prints == len(r.fingerprint) and r.fingerprint == sorted(r.fingerprint)
    for r in enc.collect():
        with wave.open(io.BytesIO(bytes(r.media)), "rb") as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1) and w.getnframes() == len(bytes(r.media)) - 44


def test_empty(none):
    assert media.analyse(media.encode(none)).count() == 0


def test_stft_is_the_direct_sum():
    x = np.random.default_rng(1).integers(0, 256, 1500).astype(np.uint8)
    s = np.concatenate([p for _, p in media.stft(x.tobytes())])
    assert s.shape == (-(-(1500 - media.FRAME) // media.HOP) + 1, media.FRAME // 2 + 1)
    part = (x[media.HOP : media.HOP + media.FRAME].astype(float) - 128) * np.hanning(media.FRAME)
    k = np.arange(media.FRAME // 2 + 1)
    direct = np.abs(np.exp(-2j * np.pi * np.outer(k, np.arange(media.FRAME)) / media.FRAME) @ part)
    assert np.allclose(s[1], direct, atol=0.05)


def test_blocks_do_not_show(monkeypatch):
    x = np.random.default_rng(2).integers(0, 256, 9000).astype(np.uint8).tobytes()
    whole = media.fingerprints(x)
    monkeypatch.setattr(media, "STEP", 3)
    assert (media.fingerprints(x) == whole).all()


def test_short_texts_have_fingerprints():
    texts = ["", "one", "two words", "Hello", "world", "the quiet river", "a lantern in the harbor", "x" * 150, "stone " * 60, "ember " * 100, "cloud " * 180]
    prints = [media.fingerprints(media.pad(t.encode())) for t in texts]
    assert all(set(x & 255) == set(media.LAGS) for x in prints)
    assert len({x.tobytes() for x in prints}) == len(texts)


def test_a_tone_is_found():
    t = np.arange(4096)
    x = (128 + 100 * np.sin(2 * np.pi * 40 * t / media.FRAME)).astype(np.uint8).tobytes()
    assert (media.peaks(x)[:-2, 2] == 40 - 0).all() or (media.peaks(x)[:-2, 2] == 40).all()
