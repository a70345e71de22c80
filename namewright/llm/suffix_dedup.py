"""Exact removal of long repeated byte strings by suffix sorting.

A byte goes if a string of ``window`` bytes that covers it also starts anywhere else. Windows are
compared only where their content-defined anchors are equal (namewright.llm.anchors): runs of windows with
one anchor are counted by anchor and by all bytes they cover, so copies, however many, are settled by
a pre-aggregated count. Runs that share an anchor but differ somewhere are sent, once each, to the
suffix sort of their anchor's bucket (difference-cover blockwise sorting, namewright.llm.suffix_array),
which works on bounded blocks. An anchor with more than max_contexts different runs goes an equally
exact way instead: its windows are counted one by one, pre-aggregated.

Defined results: a null text is empty; texts below window bytes lose nothing; repeated rows repeat each
other and lose all windows; rows are told apart by 128 bits of their id and text; null ids stay; an
empty table gives an empty result; further columns are carried along whatever their names, but those
named as a result are replaced by it. Texts are read whole.
Windows and runs are equal where two independent 64-bit hashes are; suffix sorting compares bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.anchors import Rolling, runs
from namewright.llm.common import drop_scratch, stored
from namewright.llm.suffix_array import repeated_windows

BLOCK_BYTES = 4 << 20
RUNS = "u1 long, u2 long, key long, ctx long, start int, n int, off int"
INTERVALS = "u1 long, u2 long, lo int, hi int"


def _named(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def find_runs(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """All runs of all texts (u1, u2, text)."""

    def run(batches):
        for b in batches:
            u1, u2 = b[0].to_numpy(False), b[1].to_numpy(False)
            found, own, held = [], [], 0
            for i, text in enumerate(b[2].to_pylist()):
                r = runs((text or "").encode(), window, gram)
                if len(r[0]):
                    found.append(r)
                    own.append(np.full(len(r[0]), i))
                    held += len(r[0])
                if found and (held > 50_000 or i == b.num_rows - 1):
                    key, ctx, start, n, off = (np.concatenate(c) for c in zip(*found, strict=True))
                    o = np.concatenate(own)
                    yield _named({"u1": pa.array(u1[o]), "u2": pa.array(u2[o]), "key": pa.array(key), "ctx": pa.array(ctx), "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "off": pa.array(off.astype(np.int32))})
                    found, own, held = [], [], 0
            if found:
                key, ctx, start, n, off = (np.concatenate(c) for c in zip(*found, strict=True))
                o = np.concatenate(own)
                yield _named({"u1": pa.array(u1[o]), "u2": pa.array(u2[o]), "key": pa.array(key), "ctx": pa.array(ctx), "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32)), "off": pa.array(off.astype(np.int32))})

    return rows.select("u1", "u2", "text").mapInArrow(run, RUNS)


def _spans(flags: np.ndarray, own: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of flagged starts within one context: (context, lo, hi)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[at[1:]] != own[at[:-1]])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return own[at[first]], j[at[first]], j[at[last]] + 1


def sort_buckets(contexts: DataFrame, window: int) -> DataFrame:
    """Intervals of repeated starts in the runs that occur once (m = 1), from all runs of their anchors' buckets."""

    def solve(block: dict) -> pa.RecordBatch:
        n, m, start = (np.array(block[k], np.int64) for k in ("n", "m", "start"))
        flags = repeated_windows(block["bytes"], np.array(block["key"], np.int64), n, np.array(block["off"], np.int64), window)
        own = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        c, lo, hi = _spans(flags & (m[own] == 1), own, j)
        u1, u2 = np.array(block["u1"], np.int64), np.array(block["u2"], np.int64)
        return _named({"u1": pa.array(u1[c]), "u2": pa.array(u2[c]), "lo": pa.array((start[c] + lo).astype(np.int32)), "hi": pa.array((start[c] + hi).astype(np.int32))})

    def run(batches):
        block, size, last = None, 0, None
        for b in batches:
            cols = {k: b[k].to_pylist() for k in b.schema.names}
            for row in zip(*cols.values(), strict=True):
                if block is None or (row[0] != last and size > BLOCK_BYTES):
                    if block is not None:
                        yield solve(block)
                    block, size = {k: [] for k in cols}, 0
                for k, v in zip(cols, row, strict=True):
                    block[k].append(v)
                last, size = row[0], size + len(row[-1])
        if block is not None:
            yield solve(block)

    dealt = contexts.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "u1", "u2", "start", "n", "off", "m", "bytes").mapInArrow(run, INTERVALS)


def count_windows(rows: DataFrame, listed: DataFrame, window: int) -> DataFrame:
    """Intervals for the runs in listed (u1, u2, list of start, n, m) by counting each window's hashes."""

    def run(batches):
        for b in batches:
            for u1, u2, text, at in zip(*(b[k].to_pylist() for k in ("u1", "u2", "text", "at")), strict=True):
                x = np.frombuffer((text or "").encode(), np.uint8)
                r0, r1 = Rolling(x, 0), Rolling(x, 1)
                for a in at:
                    s = np.arange(a["start"], a["start"] + a["n"])
                    k = len(s)
                    yield _named({"h0": pa.array(r0.some(s, s + window).view(np.int64)), "h1": pa.array(r1.some(s, s + window).view(np.int64)), "m": pa.array(np.full(k, a["m"])), "u1": pa.array(np.full(k, u1)), "u2": pa.array(np.full(k, u2)), "lo": pa.array(s.astype(np.int32))})

    w = rows.join(listed, ["u1", "u2"]).select("u1", "u2", "text", "at").mapInArrow(run, "h0 long, h1 long, m long, u1 long, u2 long, lo int")
    often = w.groupBy("h0", "h1").agg(F.sum("m").alias("total")).filter("total > 1")
    return w.join(often, ["h0", "h1"]).select("u1", "u2", "lo", (F.col("lo") + 1).alias("hi"))


def repeated_starts(rows: DataFrame, window: int, gram: int, max_contexts: int, scratch: list[str]) -> DataFrame:
    """Intervals (u1, u2, lo, hi) of starts whose window also starts elsewhere."""
    found = stored(find_runs(rows, window, gram), "suffix-runs", scratch)
    kinds = found.groupBy("key", "ctx", "n").agg(F.count("*").alias("m"), F.first("u1").alias("u1"), F.first("u2").alias("u2"), F.first("start").alias("start"), F.first("off").alias("off"))
    kinds = stored(kinds, "suffix-kinds", scratch)
    # stored before it is joined back, so that a hot anchor's rows are split over tasks (skewed join)
    buckets = stored(kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "suffix-buckets", scratch)
    copies = found.join(kinds.filter("m > 1").select("key", "ctx", "n"), ["key", "ctx", "n"]).select("u1", "u2", F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi"))
    unlike = kinds.join(buckets, "key")
    listed = unlike.groupBy("u1", "u2", (F.col("kinds") > max_contexts).alias("hot")).agg(F.collect_list(F.struct("key", "start", "n", "off", "m")).alias("at"))
    listed = stored(listed, "suffix-listed", scratch)

    def cut(batches):
        for b in batches:
            out, held = {k: [] for k in ("key", "u1", "u2", "start", "n", "off", "m", "bytes")}, 0
            for u1, u2, text, at in zip(*(b[k].to_pylist() for k in ("u1", "u2", "text", "at")), strict=True):
                data = (text or "").encode()
                for a in at:
                    piece = data[a["start"] : a["start"] + a["n"] - 1 + window]
                    for k, v in zip(out, (a["key"], u1, u2, a["start"], a["n"], a["off"], a["m"], piece), strict=True):
                        out[k].append(v)
                    held += len(piece)
                if held > 4 << 20:
                    yield _contexts(out)
                    out, held = {k: [] for k in out}, 0
            if out["key"]:
                yield _contexts(out)

    contexts = rows.join(listed.filter("not hot").drop("hot"), ["u1", "u2"]).select("u1", "u2", "text", "at").mapInArrow(cut, "key long, u1 long, u2 long, start int, n int, off int, m long, bytes binary")
    out = copies.union(sort_buckets(contexts, window))
    if not listed.filter("hot").isEmpty():
        out = out.union(count_windows(rows, listed.filter("hot").select("u1", "u2", F.transform("at", lambda a: F.struct(a["start"].alias("start"), a["n"].alias("n"), a["m"].alias("m"))).alias("at")), window))
    return out


def _contexts(out: dict) -> pa.RecordBatch:
    kinds = {"start": pa.int32(), "n": pa.int32(), "off": pa.int32(), "bytes": pa.binary()}
    return _named({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})


def covered(at: list, window: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by the windows of these intervals of starts, as (lo, hi)."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((a["lo"], a["hi"] - 1 + window) for a in at):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, gram: int | None = None, max_contexts: int = 8192, as_text: bool = False) -> DataFrame:
    """One row for each row of docs: its columns, then n_bytes, spans (removed bytes, array of lo, hi), kept (the other bytes).

    With as_text kept is a string, without the bytes of characters that a cut went through.
    """
    gram = gram or max(1, window // 4)
    names = [c for c in docs.columns if c not in ("n_bytes", "spans", "kept")]
    columns = [f"c{i}" for i in range(len(names))]
    id_field, text_field = columns[names.index(id_col)], columns[names.index(text_col)]
    base = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, columns, strict=True)])
    keyed = base.withColumns({"_u1": F.xxhash64(F.col(id_field), F.col(text_field)), "_u2": F.xxhash64(F.col(text_field), F.lit(1), F.col(id_field))})
    scratch: list[str] = []
    starts = repeated_starts(keyed.select(F.col("_u1").alias("u1"), F.col("_u2").alias("u2"), F.col(text_field).alias("text")), window, gram, max_contexts, scratch)
    at = starts.groupBy(F.col("u1").alias("_u1"), F.col("u2").alias("_u2")).agg(F.collect_list(F.struct("lo", "hi")).alias("_at"))
    at = stored(at, "suffix-intervals")
    drop_scratch(docs.sparkSession, scratch)

    def run(batches):
        for b in batches:
            n_bytes, spans, kept = [], [], []
            for text, a in zip(b[text_field].to_pylist(), b["_at"].to_pylist(), strict=True):
                data = (text or "").encode()
                gone = covered(a or [], window)
                edges = [0, *[x for s in gone for x in s], len(data)]
                n_bytes.append(len(data))
                spans.append([{"lo": lo, "hi": hi} for lo, hi in gone])
                kept.append(b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield _named({c: b[c] for c in columns} | {"n_bytes": pa.array(n_bytes, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), "kept": pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    # intervals grow with the corpus: a merge join at every size, so that small runs show what large ones cost
    out = keyed.join(at.hint("merge"), ["_u1", "_u2"], "left").drop("_u1", "_u2").mapInArrow(run, f"{schema}, n_bytes long, spans array<struct<lo:int,hi:int>>, kept {'string' if as_text else 'binary'}")
    return out.toDF(*names, "n_bytes", "spans", "kept")
