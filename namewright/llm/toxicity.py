"""Toxicity by classifier chains.

Labelled texts give the categories, in the order of the chain: ``insult`` (toxic with a word that the
labelled texts show to be abusive), ``severe`` (toxic with three such words or more) and ``toxic`` (the
label). Each category has a linear model over its own view of a text and over the probabilities of the
categories before it; in training these come out of fold, so that later models learn to use
predictions and not the truth. The views differ, so that each link adds what the next does not see:
``insult`` sees which selected words and word beginnings are there, ``severe`` how many abusive words
there are, alone and for the text's length, and ``toxic`` the words again with both probabilities.

Defined results: a null text has no words and gets the models' base rates; without labels of both
kinds all probabilities are the smoothed label rate; an id with several labels is toxic if any says
so; repeated rows are scored each on its own; null ids stay; an empty table gives an empty result;
further columns are not read. Texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("insult", "severe", "toxic")
#: Beginnings of words that are features beside whole words.
PREFIXES = (4, 5)
FOLDS = 5
#: Numbers that the second view holds: abusive words (up to MOST), the text's length in words by powers of two, and their ratio.
COUNTS, MOST = 3, 8
_WORD = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """Words, and beginnings with a mark after them."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def abuse_counts(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, n): labelled documents with each feature."""

    def run(batches):
        c = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                c[y].update(features(text))
                if len(c[y]) > 200_000:
                    yield _counted(c)
                    c = (Counter(), Counter())
        yield _counted(c)

    return labelled.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _counted(c: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = list(c[0].keys() | c[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([c[1][x] for x in names], pa.int64()), pa.array([c[0][x] for x in names], pa.int64())], ["feature", "pos", "neg"])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.5, rounds: int = 25) -> np.ndarray:
    """Weights and, last, bias of an L2-penalised logistic regression by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    rate = float(np.clip((weight @ y + 0.5) / (weight.sum() + 1), 1e-6, 1 - 1e-6))
    w, pen = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
    w[-1], pen[-1] = math.log(rate / (1 - rate)), 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (weight * (y - p)) - pen * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-5:
            break
    return w


def counts_view(n_abusive: int, n_words: int) -> tuple[float, float, float]:
    n, size = float(min(n_abusive, MOST)), float(n_words.bit_length())
    return n, size, n / (1 + size)


@dataclass
class Chain:
    index: dict[str, int] = field(default_factory=dict)
    models: list[np.ndarray] = field(default_factory=list)
    views: list[slice] = field(default_factory=list)  # the columns that each link sees

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the categories, in order, for rows of features."""
        out = np.empty((len(x), len(self.models)))
        for i, (w, view) in enumerate(zip(self.models, self.views, strict=True)):
            n = x[:, view].shape[1]
            z = x[:, view] @ w[:n] + out[:, :i] @ w[n:-1] + w[-1]
            out[:, i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def train_chain(index: dict[str, int], x: np.ndarray, targets: np.ndarray, folds: np.ndarray, weight: np.ndarray, views: list[slice] | None = None) -> Chain:
    """targets: rows by categories. Earlier probabilities are features, out of fold while training."""
    chain, before = Chain(index, views=views or [slice(None)] * targets.shape[1]), np.empty((len(x), 0))
    for i in range(targets.shape[1]):
        seen, out = np.column_stack([x[:, chain.views[i]], before]), np.empty(len(x))
        for f in range(FOLDS):
            w = fit(seen[folds != f], targets[folds != f, i], weight[folds != f])
            out[folds == f] = 1 / (1 + np.exp(-np.clip(np.column_stack([seen[folds == f], np.ones((folds == f).sum())]) @ w, -30, 30)))
        chain.models.append(fit(seen, targets[:, i], weight))
        before = np.column_stack([before, out])
    return chain


def _views(n: int) -> list[slice]:
    return [slice(0, n), slice(n, n + COUNTS), slice(0, n)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, max_features: int = 512, least_docs: int = 3) -> Chain:
    """Fits on the labelled documents, at most max_labelled of them, chosen by a hash of the id; that bounds the ids that are broadcast and, where an id has several rows, the rows that are collected."""
    spark = docs.sparkSession
    picked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("_id").agg(F.max("y").alias("y"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    labelled = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id")
    sizes = dict(labelled.groupBy("y").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    odds = F.log((pos + 0.5) / (n1 + 1)) - F.log((neg + 0.5) / (n0 + 1))
    # words that toxic texts hold far more often; ranked by how much they tell over all labelled texts
    best = abuse_counts(labelled).filter((F.col("pos") >= least_docs) & (odds > math.log(8))).orderBy(F.desc(pos * odds), "feature").limit(max_features).select("feature").collect() if n1 and n0 else []
    index = {r[0]: i for i, r in enumerate(best)}
    abuse = spark.sparkContext.broadcast(index)

    def run(batches):
        whole, begin = split_index(abuse.value)
        for b in batches:
            seen, n_abusive, size = [], [], []
            for text in b[1].to_pylist():
                found, n, n_words = look(text, whole, begin)
                seen.append(sorted(found))
                n_abusive.append(min(n, MOST))
                size.append(n_words)
            yield pa.RecordBatch.from_arrays([b[0], b[2], pa.array(seen, pa.list_(pa.int32())), pa.array(n_abusive, pa.int32()), pa.array(size, pa.int64())], ["_id", "y", "seen", "n_abusive", "size"])

    rows = labelled.select("_id", "text", "y").mapInArrow(run, "_id long, y int, seen array<int>, n_abusive int, size long")
    rows = rows.orderBy(F.xxhash64("_id", "seen", "size"), "_id", "size", "seen").limit(max_labelled).collect()
    # rows that look the same are one row with their number as its weight
    same: Counter = Counter((tuple(r["seen"]), counts_view(r["n_abusive"], r["size"]), r["n_abusive"], r["y"], zlib.crc32(str(r["_id"]).encode()) % FOLDS) for r in rows)
    keys = sorted(same)
    x = np.zeros((len(keys), len(index) + COUNTS))
    for i, k in enumerate(keys):
        x[i, list(k[0])] = 1.0
        x[i, len(index) :] = k[1]
    targets = np.array([(k[3] and k[2] > 0, k[3] and k[2] >= 3, k[3]) for k in keys], float).reshape(-1, len(CATEGORIES))
    return train_chain(index, x, targets, np.array([k[4] for k in keys], int), np.array([same[k] for k in keys], float), _views(len(index)))


def split_index(index: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
    """Whole words, and beginnings without their mark."""
    return {k: i for k, i in index.items() if not k.endswith("*")}, {k[:-1]: i for k, i in index.items() if k.endswith("*")}


def look(text: str | None, whole: dict[str, int], begin: dict[str, int]) -> tuple[set[int], int, int]:
    """The features of a text, how many of its words are abusive, and how many words it has."""
    every = _WORD.findall((text or "").lower())
    words = set(every)
    found = {whole[w] for w in whole.keys() & words}
    for n in PREFIXES:
        found |= {begin[p] for p in begin.keys() & {w[:n] for w in words if len(w) > n}}
    n_abusive = sum(w in whole or any(w[:n] in begin for n in PREFIXES if len(w) > n) for w in every) if found else 0
    return found, n_abusive, len(every)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, a probability for each category (p_...), is_toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        c = shared.value
        whole, begin = split_index(c.index)
        for t in batches:
            for a in range(0, t.num_rows, 2048):
                b = t.slice(a, 2048)
                x = np.zeros((b.num_rows, len(c.index) + COUNTS))
                for i, text in enumerate(b[1].to_pylist()):
                    found, n_abusive, n_words = look(text, whole, begin)
                    x[i, list(found)] = 1.0
                    x[i, len(c.index) :] = counts_view(n_abusive, n_words)
                p = c.predict(x)
                yield pa.RecordBatch.from_arrays([b[0], *[pa.array(p[:, i]) for i in range(p.shape[1])], pa.array(p[:, -1] >= threshold)], ["doc_id", *[f"p_{k}" for k in CATEGORIES], "is_toxic"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, " + ", ".join(f"p_{k} double" for k in CATEGORIES) + ", is_toxic boolean")
