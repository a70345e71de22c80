"""Near-duplicates by MinHash bands with sequential Bayesian verification, confirmed on full shingle sets.

Documents of equal word sequences form a class, which stands for all its copies. Classes whose MinHash
signatures agree in a band are candidates. In every bucket each member first meets only one hub; what
turns out linked is one component, and only members of different components then meet each other, in
bounded blocks that give out likely links alone. So a bucket of copies costs about as many comparisons
as it has members, no pairs are listed, and no link between different texts is lost. A candidate's signatures are compared in batches: after n values with m equal, the pair is
dropped where the posterior probability of a similarity at or above the threshold (uniform prior) is
below the chosen miss probability. Survivors are confirmed by intersecting their whole shingle sets.

Defined results: a text without words (null, empty) is linked with nothing and stays; fewer words than
a shingle make one shingle; the component id is the least id reached, nulls apart; a row is kept if its
id is the component's, or if its component has no id at all; repeated rows share a class; an empty
table gives an empty result; further columns are not read. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import drop_scratch, stored
from namewright.llm.components import components

BANDS, ROWS, BATCH = 32, 5, 20
#: Most rows of a block on average: members outside the largest component, and all members; most shingles of either.
CHUNKS = (512, 2048, 4_000_000)
MISS = 1e-7
SEED = 7


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], k: int) -> set:
    """The full set: distinct k-word sequences; of fewer words, the whole sequence."""
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else set(zip(*[words[i:] for i in range(k)], strict=False))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hashes(words: list[bytes], k: int, memo: dict) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    h = np.fromiter((memo.get(w) or memo.setdefault(w, xxhash.xxh3_64_intdigest(w, SEED)) for w in words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = _mix(out + h[i : i + n])
    return np.unique(out)


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(x: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Upper halves of the least products modulo 2**64, one for each factor."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(x), 512):
        np.minimum(best, (factors[:, None] * x[None, a : a + 512]).min(1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def sign(docs: DataFrame, k: int, n_hashes: int) -> DataFrame:
    """(doc_id, text_hash, n, digest, sig) of each row; digest and sig are null for texts without words."""

    def run(batches):
        factors, memo = multipliers(n_hashes), {}
        for b in batches:
            for a in range(0, b.num_rows, 512):
                s = b.slice(a, 512)
                n, digest, sig = [], [], []
                for text in s[1].to_pylist():
                    w = word_list(text)
                    n.append(len(shingles(w, k)))
                    digest.append(hashlib.md5(b" ".join(w)).digest() if w else None)
                    sig.append(signature(hashes(w, k, memo), factors).tobytes() if w else None)
                    if len(memo) > 300_000:
                        memo.clear()
                yield pa.RecordBatch.from_arrays([s[0], s[2], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "n", "digest", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n long, digest binary, sig binary")


def least_matches(n_hashes: int, threshold: float, miss: float, batch: int) -> list[int]:
    """After each batch: the least number of equal values with which a pair stays.

    With a uniform prior, P(similarity >= t | m of n equal) is the chance of m or fewer successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(batch, n_hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log(1 - threshold)) if threshold < 1 else 0.0
        out.append(m if threshold < 1 else n)
    return out


def survive(pairs: DataFrame, n_hashes: int, percent: int, miss: float) -> DataFrame:
    """Of (a, b, sig_a, sig_b) the pairs (a, b) that sequential comparison does not rule out."""
    needed = least_matches(n_hashes, percent / 100, miss, BATCH)

    def run(batches):
        for t in batches:
            x, y = (np.frombuffer(b"".join(t[c].to_pylist()), "<u4").reshape(-1, n_hashes) for c in ("sig_a", "sig_b"))
            alive, m = np.arange(len(x)), np.zeros(len(x), np.int64)
            for i, least in enumerate(needed):
                part = slice(i * BATCH, (i + 1) * BATCH)
                m = m + (x[alive, part] == y[alive, part]).sum(1)
                stay = m >= least
                alive, m = alive[stay], m[stay]
            at = pa.array(alive)
            yield pa.RecordBatch.from_arrays([t["a"].take(at), t["b"].take(at)], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of (a, b) the pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches):
        last, own = None, set()
        for t in batches:
            keep = []
            for a, wa, wb in zip(t["a"].to_pylist(), t["wa"].to_pylist(), t["wb"].to_pylist(), strict=True):
                if a != last:
                    last, own = a, shingles(wa.split(), k)
                other = shingles(wb.split(), k)
                both = len(own & other)
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            t = t.filter(pa.array(keep))
            yield t.select(["a", "b"])

    met = pairs.join(texts.select(F.col("digest").alias("b"), F.col("words").alias("wb")), "b").join(texts.select(F.col("digest").alias("a"), F.col("words").alias("wa")), "a")
    return met.select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary")


def load_words(docs: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """(digest, words) once for each digest in ends: the words of its text, joined by spaces."""
    ids = ends.join(nodes.select("digest", "least"), "digest").select("least").distinct()

    def load(batches):
        for t in batches:
            w = [b" ".join(word_list(x)) for x in t[0].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(x).digest() for x in w], pa.binary()), pa.array(w, pa.binary())], ["digest", "words"])

    found = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").select("text").mapInArrow(load, "digest binary, words binary")
    return found.join(ends, "digest", "left_semi").dropDuplicates(["digest"])


def cross_links(rest: DataFrame, texts: DataFrame, nodes: DataFrame, k: int, percent: int, bands: int, rows: int, miss: float, scratch: list[str], most: int | None = 16) -> DataFrame:
    """Likely links (a, b, root_a, root_b, more) between members of different components within the buckets of rest (key, band, digest, n, root).

    In each bucket the members outside its largest component meet all its members. Both sides are dealt
    in chunks, so a bucket of any size is worked through in blocks of at most some CHUNKS rows, and no
    pair leaves a block but likely links: of each two components the first ``most`` found, as one true link
    joins the two; more says that there are others, and all_cross_links() takes those where none of the
    first is true. A pair is looked at in its first common band only; it must survive the sequential
    comparison and the intersection of its whole sets, hashed to 64 bits: 100,000 shingles have a
    collision with a probability of about 3e-10. confirm() has the last word.
    """
    n_hashes, needed = bands * rows, least_matches(bands * rows, percent / 100, miss, BATCH)
    counted = rest.groupBy("key", "root").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    sized = counted.groupBy("key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("size"), F.max("n").alias("n"))
    chunks = lambda c, most: F.greatest(F.lit(1), F.ceil(c / most), F.ceil(c * F.col("n") / CHUNKS[2]))
    sized = sized.select("key", F.col("main.root").alias("main"), chunks(F.col("size") - F.col("main.c"), CHUNKS[0]).alias("n_out"), chunks(F.col("size"), CHUNKS[1]).alias("n_all"))
    met = rest.join(stored(sized, "dedup-sized", scratch), "key")
    place = lambda n, seed: F.pmod(F.xxhash64("digest", F.lit(seed)), n)
    as_all = met.select("key", "band", "digest", "root", F.lit(False).alias("out"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_out") - 1)).alias("i"), place(F.col("n_all"), 1).alias("j"))
    as_out = met.filter("root <> main").select("key", "band", "digest", "root", F.lit(True).alias("out"), place(F.col("n_out"), 2).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_all") - 1)).alias("j"))
    ends = rest.select("digest").distinct()

    def shrink(batches):
        memo: dict = {}
        for t in batches:
            yield pa.RecordBatch.from_arrays([t["digest"], pa.array([hashes(w.split(), k, memo).astype("<u8").tobytes() for w in t["words"].to_pylist()], pa.binary())], ["digest", "shingles"])
            if len(memo) > 300_000:
                memo.clear()

    sets = texts.join(ends, "digest", "left_semi").mapInArrow(shrink, "digest binary, shingles binary").join(nodes.select("digest", "sig"), "digest")
    entries = as_all.unionByName(as_out).withColumn("block", F.xxhash64("key", "i", "j")).join(stored(sets, "dedup-sets", scratch), "digest")
    factors = multipliers(rows)

    def solve(block: list) -> list:
        out, everyone = [r for r in block if r["out"]], [r for r in block if not r["out"]]
        if not out or not everyone:
            return []
        band = block[0]["band"]
        x, y = (np.frombuffer(b"".join(r["sig"] for r in side), "<u4").reshape(-1, n_hashes) for side in (out, everyone))
        kx, ky = ((s.reshape(-1, bands, rows).astype(np.uint64) * factors).sum(2, dtype=np.uint64) for s in (x, y))
        names = sorted({r["root"] for r in block})
        code = {v: i for i, v in enumerate(names)}
        rx, ry = (np.array([code[r["root"]] for r in side]) for side in (out, everyone))
        open_ = rx[:, None] != ry[None, :]
        for e in range(band):
            open_ &= kx[:, None, e] != ky[None, :, e]
        p, q = np.nonzero(open_)
        m = np.zeros(len(p), np.int64)
        for i, least in enumerate(needed):
            part = slice(i * BATCH, (i + 1) * BATCH)
            for a in range(0, len(p), 1 << 16):
                m[a : a + (1 << 16)] += (x[p[a : a + (1 << 16)], part] == y[q[a : a + (1 << 16)], part]).sum(1)
            stay = m >= least
            p, q, m = p[stay], q[stay], m[stay]
        order = np.argsort(-m, kind="stable")
        p, q = p[order], q[order]
        found, taken = [], {}
        got = [np.frombuffer(r["shingles"], "<u8") for r in everyone]
        size = np.array([len(g) for g in got])
        for i in np.unique(p):
            mine = np.frombuffer(out[i]["shingles"], "<u8")
            js = q[p == i]
            fit = 100 * np.minimum(size[js], len(mine)) >= percent * np.maximum(size[js], len(mine))
            js = js[fit]
            for a in range(0, len(js), 1024):
                part = js[a : a + 1024]
                flat = np.concatenate([got[j] for j in part])
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[part])[:-1]]))
                for j in part[100 * both >= percent * (len(mine) + size[part] - both)]:
                    pair = (min(rx[i], ry[j]), max(rx[i], ry[j]))
                    taken[pair] = taken.get(pair, 0) + 1
                    if most is None or taken[pair] <= most:
                        found.append((out[i]["digest"], everyone[j]["digest"], pair))
        return [(a, b, names[pair[0]], names[pair[1]], most is not None and taken[pair] > most) for a, b, pair in found]

    def run(batches):
        block, last = [], None
        for t in batches:
            found = []
            for r in t.to_pylist():
                if r["block"] != last and block:
                    found += solve(block)
                    block = []
                last = r["block"]
                block.append(r)
            yield _pairs(found)
        if block:
            yield _pairs(solve(block))

    dealt = entries.select("block", "band", "digest", "root", "out", "sig", "shingles").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "a binary, b binary, root_a binary, root_b binary, more boolean").groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "root_a", "root_b").agg(F.bool_or("more").alias("more"))


def _pairs(found: list) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.binary()) for c in cols[:4]], pa.array(cols[4], pa.bool_())], ["a", "b", "root_a", "root_b", "more"])


def all_cross_links(rest: DataFrame, texts: DataFrame, nodes: DataFrame, k: int, percent: int, bands: int, rows: int, miss: float, scratch: list[str], most: int = 16) -> DataFrame:
    """Confirmed links (a, b) of cross_links(). Where a block had more likely links of two components than it gave out and none is true, all of them are tried."""
    likely = stored(cross_links(rest, texts, nodes, k, percent, bands, rows, miss, scratch, most), "dedup-likely", scratch)
    linked = stored(confirm(likely.select("a", "b"), texts, k, percent), "dedup-links", scratch)
    ends = ["root_a", "root_b"]
    left = stored(likely.filter("more").select(*ends).distinct().join(likely.join(linked, ["a", "b"]).select(*ends), ends, "left_anti"), "dedup-open", scratch)
    if left.isEmpty():
        return linked
    again = rest.join(left.select(F.explode(F.array(*ends)).alias("root")).distinct(), "root", "left_semi")
    every = cross_links(again, texts, nodes, k, percent, bands, rows, miss, scratch, None).join(left, ends, "left_semi")
    return linked.union(stored(confirm(stored(every, "dedup-likely", scratch).select("a", "b"), texts, k, percent), "dedup-links", scratch))


def links(docs: DataFrame, nodes: DataFrame, k: int, percent: int, bands: int, rows: int, miss: float, scratch: list[str]) -> DataFrame:
    """Confirmed links (a, b) that connect all classes which any chain of links connects.

    The hub of a bucket is its member with the most bucket mates over all bands, which is the most central one of a family of copies.
    """
    width = 4 * rows
    keys = F.array(*[F.xxhash64(F.substring("sig", i * width + 1, width), F.lit(i)) for i in range(bands)])
    entries = nodes.select("digest", "n", F.posexplode(keys).alias("band", "key"))
    # the grouped tables are stored before they are joined back: then a hot bucket's rows are split over tasks (skewed join)
    shared = stored(entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "dedup-shared", scratch)
    entries = stored(entries.join(shared, "key"), "dedup-buckets", scratch)
    # from here on only classes that share a bucket; their words come in one pass over the texts
    mates = entries.select("digest").distinct()
    nodes = stored(nodes.join(mates, "digest", "left_semi"), "dedup-mates", scratch)
    texts = stored(load_words(docs, nodes, nodes.select("digest")), "dedup-texts", scratch)
    weight = entries.groupBy("digest").agg(F.sum("size").alias("weight"))
    hubs = stored(entries.join(weight, "digest").groupBy("key").agg(F.max(F.struct("weight", "digest")).alias("h")).select("key", F.col("h.digest").alias("hub")), "dedup-hubs", scratch)
    pairs = hubs.join(entries, "key").select(F.col("hub").alias("a"), F.col("digest").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    side = lambda x: nodes.select(F.col("digest").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    found = stored(confirm(stored(survive(met, bands * rows, percent, miss), "dedup-pairs", scratch), texts, k, percent), "dedup-links", scratch)
    roots = components(found)
    rest = entries.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("key", "band", "digest", "n", F.coalesce("root", "digest").alias("root"))
    split = stored(rest.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key"), "dedup-split", scratch)
    rest = stored(rest.join(split, "key"), "dedup-rest", scratch)
    return found.union(all_cross_links(rest, texts, nodes, k, percent, bands, rows, miss, scratch))


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS, miss: float = MISS,
) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, class_id, component_id, kept, text_hash (xxhash64 of the text, to tell rows of one id apart)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(sign(docs, shingle, bands * rows), "dedup-signed")
    nodes = stored(signed.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.first("sig").alias("sig")), "dedup-nodes")
    scratch: list[str] = []
    roots = components(links(docs, nodes, shingle, percent, bands, rows, miss, scratch))
    drop_scratch(docs.sparkSession, scratch)
    labels = nodes.select("digest", "least").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = labels.join(stored(least, "dedup-least"), "root").select("digest", F.col("least").alias("class_id"), "component_id")
    out = signed.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "digest").join(labels, "digest", "left")
    empty = F.col("digest").isNull()
    out = out.withColumns({"class_id": F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")), "component_id": F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))})
    return out.select("doc_id", "n_shingles", "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "text_hash")
