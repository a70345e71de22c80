"""Packing by power-of-two decomposition.

Each document's token ids (with the closing id) are cut into whole sequences of the maximum length and
then the binary digits of the rest, largest first, so every piece has a power-of-two length and fills
a sequence of its own length: no padding, and no sequence holds two documents. Sequences of one length
form a bucket; their ids are numbered within (partition, bucket), so no shuffle is needed.

Defined results: a null text is empty (the closing id alone); repeated rows are packed each on its
own; a null doc_id stays null; an empty table gives no pieces; further columns are not read. Texts of
any length are encoded whole. Ids are the same on a retried task as long as its input rows come in the
same order, as they do from files.
"""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long, bucket int"
#: Bits of a sequence id for the number within (partition, bucket); buckets take five bits above, partitions the rest.
NUMBER_BITS = 36


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to arrays of ids, as ``tokenizers`` gives them without special tokens added.

    Where the file is a plain byte-level BPE and the ranks of the same vocabulary stand beside it, the
    faster library encodes texts whose characters all lie below FAST_BELOW, for which tests show equal
    ids; all other texts go through ``tokenizers``.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    ranks_path, fast = path.removesuffix(".json") + ".tiktoken", None
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    pre = made["pre_tokenizer"] or {}
    plain = made["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    if plain and os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {k: v for k, v in slow.get_vocab().items() if v >= len(ranks)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        if fast is not None and (text.isascii() or max(text) < FAST_BELOW):
            return fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")

    return ids


FAST_BELOW = "ɐ"


def pieces(n: int, longest: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then the binary digits of the rest."""
    out, rest = [longest] * (n // longest), n % longest
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces with their ids (tokens: little-endian unsigned 32-bit), one sequence each. longest must be a power of two."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches):
        part, ids = TaskContext.get().partitionId(), encoder(tokenizer)
        number = [0] * 32
        for b in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset", "bucket")}
            held = 0
            for doc_id, text in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                t = np.append(ids(text or ""), np.uint32(end_id)).astype("<u4")
                at = 0
                for n in pieces(len(t), longest):
                    k = n.bit_length() - 1
                    for name, v in zip(out, (doc_id, at, n, t[at : at + n].tobytes(), len(t), (part << (NUMBER_BITS + 5)) | (k << NUMBER_BITS) | number[k], 0, k), strict=True):
                        out[name].append(v)
                    number[k] += 1
                    at += n
                held += 4 * len(t)
                if held > 4 << 20:
                    yield _batch(out)
                    out, held = {k: [] for k in out}, 0
            if out["start"]:
                yield _batch(out)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)


def _batch(out: dict) -> pa.RecordBatch:
    kinds = {"tokens": pa.binary(), "bucket": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))
