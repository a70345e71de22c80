"""Media columns: WAV bytes, short-time Fourier transforms and spectral-peak pair fingerprints.

Text bytes are taken as the samples of an 8-bit mono WAV (the wave module writes and reads it), so the
payload is kept byte for byte. Spectra come from Hann-windowed frames; the strongest bin of each of a
few bands is a peak; pairs of a peak and a peak some frames later give time-coded fingerprints
(time of the first peak << 32 | first bin << 20 | second bin << 8 | frames between). Payloads with fewer
frames than the lags need (under 1,280 bytes) are centred in silence first, so every text has pairs at all lags.

Defined results: a null text is empty and becomes one padded block; equal payloads have equal values;
repeated rows stay; a null doc_id stays null; an empty table gives an empty result; further columns
are not read. Frames are worked through in blocks, so memory does not grow with a text's length
beyond the text itself.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, RATE = 192, 8000
FRAME, HOP = 512, 256
#: Edges of the frequency bands, in bins.
BANDS = (2, 12, 28, 60, 120, 257)
LAGS = (1, 3)
STEP = 2048


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """Bytes 32 appended up to a positive multiple of block."""
    return data + b" " * (-len(data) % block if data else block)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return f.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def stft(samples: bytes, frame: int = FRAME, hop: int = HOP):
    """Magnitudes of the frames, STEP frames at a time: (first frame, array of frames by bins). A last part shorter than a frame is filled with the middle value 128."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, -(-max(0, len(x) - frame) // hop) + 1)
    win = np.hanning(frame).astype(np.float32)
    for a in range(0, n, STEP):
        m = min(STEP, n - a)
        part = x[a * hop : (a + m - 1) * hop + frame].astype(np.float32) - 128
        part = np.pad(part, (0, (m - 1) * hop + frame - len(part)))
        yield a, np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, frame)[::hop] * win, axis=1))


def peaks(samples: bytes) -> np.ndarray:
    """The strongest bin of each band in each frame, lowest bin first on ties: frames by bands."""
    return np.concatenate([np.stack([lo + np.argmax(np.round(s[:, lo:hi], 2), axis=1) for lo, hi in zip(BANDS, BANDS[1:], strict=False)], axis=1) for _, s in stft(samples)]).astype(np.int64)


def centred(samples: bytes) -> bytes:
    """Samples too short for all lags, with the middle value 128 on both sides, so that they lie where the windows are wide."""
    short = max(0, FRAME + max(LAGS) * HOP - len(samples))
    return b"\x80" * (short // 2) + samples + b"\x80" * (short - short // 2)


def fingerprints(samples: bytes) -> np.ndarray:
    """Time-coded pairs of peaks, in order of time: a peak and the same and the next band's peak some frames later."""
    p = peaks(centred(samples))
    out = []
    for lag in LAGS:
        if len(p) > lag:
            t = np.arange(len(p) - lag, dtype=np.int64)
            for i in range(p.shape[1]):
                for j in {i, (i + 1) % p.shape[1]}:
                    out.append((t << 32) | (p[:-lag, i] << 20) | (p[lag:, j] << 8) | lag)
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded), media (the WAV file's bytes)."""

    def run(batches):
        for b in batches:
            raw = [(x or "").encode() for x in b[1].to_pylist()]
            for a in range(0, len(raw), 256):
                yield pa.RecordBatch.from_arrays([b[0].slice(a, 256), pa.array([len(x) for x in raw[a : a + 256]], pa.int64()), pa.array([to_wav(pad(x)) for x in raw[a : a + 256]], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def analyse(media: DataFrame) -> DataFrame:
    """Adds to (doc_id, n_bytes, media): payload (read back from the WAV bytes), fingerprint (array of long) and feature, its digest by value."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 128):
                s = b.slice(a, 128)
                files = s["media"].to_pylist()
                back = [from_wav(x) for x in files]
                prints = [fingerprints(x) for x in back]
                cols = {
                    "doc_id": s["doc_id"], "n_bytes": s["n_bytes"], "payload_bytes": pa.array([len(x) for x in back], pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back]), "tail_crc32": pa.array([zlib.crc32(x[-16:]) for x in back], pa.int64()),
                    "media_bytes": pa.array([len(x) for x in files], pa.int64()), "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in files]),
                    "n_prints": pa.array([len(x) for x in prints], pa.int64()), "fingerprint": pa.array(prints, pa.list_(pa.int64())),
                    "feature": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() for x in prints]),
                }
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_prints long, fingerprint array<bigint>, feature string")
