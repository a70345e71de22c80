"""Quality classifier with hierarchical empirical Bayes (DataFrame functions on the whole corpus).

A logistic classifier on a few text ratios gives each document's evidence, scaled by how well it
foretells labels out of fold. Hosts and the paths below them get posterior quality rates from the
summed evidence of all their documents: a path shrinks towards its host and a host towards the global
rate, the more so the fewer documents it has; how much is estimated from the spread between hosts and
between paths (method of moments). A document's odds are then moved by the posterior odds of its path
against the global ones, for which the path's and the host's sums are taken without the document
itself: its own evidence counts once, and a site's only document is judged by the global rate.

Defined results: a null text counts as empty; null hosts and paths are groups of their own; without
labels of both kinds the document evidence is the smoothed share of good labels; an id with several
labels is good if any says so; repeated rows are scored each on its own; an empty table gives an empty
result; further columns are carried along whatever their names, but those named as a result are
replaced by it.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import stored, words

FEATURES = ["symbols", "exclaim", "upper", "digits", "stops", "distinct", "echo", "word_len", "log_words", "lines_again"]
NONE = "\x00"
FOLDS = 5


@dataclass
class Model:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column _f, the array of FEATURES."""
    d = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_w", words(F.col("_t")))
    n = F.greatest(F.lit(1), F.length("_t")).cast("double")
    n_w = F.greatest(F.lit(1), F.size("_w")).cast("double")
    ratio = lambda outside: F.length(F.regexp_replace("_t", outside, "")) / n
    lines = F.split("_t", "\n")
    return d.withColumn(
        "_f",
        F.array(
            ratio(r"[^#*$%&|<>]+"), ratio(r"[^!]+"), ratio(r"[^A-Z]+"), ratio(r"[^0-9]+"), ratio(r"[^.,;:]+"),
            F.size(F.array_distinct("_w")) / n_w,
            # its lambdas hold no column: a filter on a result may carry this expression below a join, where _w would be split again for every word
            F.size(F.filter(F.zip_with("_w", F.slice("_w", F.lit(2), F.greatest(F.lit(0), F.size("_w"))), lambda x, y: x == y), lambda same: same)) / n_w,
            F.least(n / n_w, F.lit(40.0)), F.log(n_w), 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        ),
    ).drop("_t", "_w")


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> Model:
    """Newton's method for L2-penalised logistic regression on standardised features."""
    rate = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Model([0.0] * len(FEATURES), [1.0] * len(FEATURES), [0.0] * len(FEATURES), logit(float(rate)))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, pen = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
    pen[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (y - p) - pen * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))


def calibrated(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> Model:
    """fit(), with its log odds scaled and shifted as fits the labels best where the folds' models foretell them."""
    m = fit(x, y)
    if not any(m.weights):
        return m
    z = np.empty(len(x))
    for f in range(FOLDS):
        part = fit(x[folds != f], y[folds != f])
        z[folds == f] = np.clip(((x[folds == f] - part.mean) / part.scale) @ np.array(part.weights) + part.bias, -30, 30)
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton's method, drawn towards no change by one observation's worth
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p)
        grad = np.array([z @ (y - p) - (a - 1), (y - p).sum() - b])
        step = np.linalg.solve(np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]]), grad)
        a, b = max(0.05, a + float(np.clip(step[0], -0.5, 0.5))), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return Model(m.mean, m.scale, [a * w for w in m.weights], a * m.bias + b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> Model:
    """Fits on the labelled documents, at most max_labelled of them, chosen by a hash of the id.

    That parameter bounds the ids that are broadcast and, where an id has several rows, the feature rows that come to the driver.
    """
    picked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    rows = with_features(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id")).select("_id", "_f", "_y")
    rows = rows.orderBy(F.xxhash64("_id", "_f"), "_id", "_f").limit(max_labelled).collect()
    folds = np.array([zlib.crc32(str(r[0]).encode()) % FOLDS for r in rows], int)
    return calibrated(np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[2] for r in rows], float), folds)


def evidence(model: Model, bound: float = 12.0) -> Column:
    """The document's log odds from _f, within +-bound; never null."""
    z = F.lit(model.bias)
    for i, (m, s, w) in enumerate(zip(model.mean, model.scale, model.weights, strict=True)):
        z = z + (F.get("_f", F.lit(i)) - m) / s * w
    # never null, and said so: else a filter on a result would first ask whether all the features are null, row by row
    return F.coalesce(F.greatest(F.lit(-bound), F.least(F.lit(bound), z)), F.lit(0.0))


def strength(rate: float, between: float, least: float = 2.0, most: float = 10_000.0) -> float:
    """Prior documents' worth of a Beta prior of that mean and variance."""
    return min(most, max(least, rate * (1 - rate) / max(between, 1e-12) - 1))


@dataclass
class Prior:
    rate: float
    k_host: float  # documents' worth of the global rate, for hosts
    k_path: float  # and of the host's rate, for paths


def posteriors(evid: DataFrame) -> tuple[DataFrame, Prior]:
    """From (host, path, p) of all documents: the groups' sums (host, path, n, s, hn, hs), their posteriors and the priors.

    The sums are pre-aggregated before the shuffle, so a host with a third of all rows is no burden.
    """
    paths = evid.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * (1 - F.col("p"))).alias("noise"))
    paths = stored(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("noise").alias("h_noise"))
    whole = hosts.agg(F.sum("hn"), F.sum("hs")).first()
    n, total = whole[0] or 0, whole[1] or 0.0
    rate = min(1 - 1e-6, max(1e-6, (total + 1) / (n + 2)))
    # spread of the groups' means about the level above, less the part that counting noise explains
    spread = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - rate, 2) - F.col("h_noise") / F.col("hn")) / F.sum("hn")).first()[0] or 0.0
    k_host = strength(rate, spread)
    hosts = hosts.withColumn("host_posterior", (F.col("hs") + k_host * rate) / (F.col("hn") + k_host))
    both = paths.join(hosts, "host")
    spread = both.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("host_posterior"), 2) - F.col("noise") / F.col("n")) / F.sum("n")).first()[0] or 0.0
    k_path = strength(rate, spread)
    out = both.select("host", "path", "n", "s", "hn", "hs", "host_posterior", ((F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)).alias("path_posterior"))
    return out, Prior(rate, k_host, k_path)


RESULTS = ["_host", "_path", "p_document", "host_posterior", "path_posterior", "p_quality", "kept"]


def score(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
    max_labelled: int = 20_000, threshold: float = 0.5,
) -> DataFrame:
    """All columns of docs, then _host, _path, p_document, host_posterior, path_posterior, p_quality, kept.

    The posteriors are those of the site without the document. Two passes over the texts: one sums the evidence of hosts and paths, one scores. The texts are
    joined with the group table, not shuffled by document; where that table is large, Spark splits
    the hot groups' partitions (skewed join).
    """
    model = train(docs, labels, id_col, text_col, max_labelled=max_labelled)
    names = [c for c in docs.columns if c not in RESULTS]
    aside = [f"c{i}" for i in range(len(names))]
    site = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    base = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(names, aside, strict=True)], site(host).alias("host"), site(path).alias("path"))
    z = with_features(base, aside[names.index(text_col)]).withColumn("z", evidence(model)).drop("_f").withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    groups, prior = posteriors(z.select("host", "path", "p"))
    out = z.join(groups.drop("host_posterior", "path_posterior"), ["host", "path"], "left")
    out = out.withColumn("at_host", (F.col("hs") - F.col("p") + prior.k_host * prior.rate) / (F.col("hn") - 1 + prior.k_host))
    out = out.withColumn("at_path", (F.col("s") - F.col("p") + prior.k_path * F.col("at_host")) / (F.col("n") - 1 + prior.k_path))
    odds = F.col("z") + F.log(F.col("at_path") / (1 - F.col("at_path"))) - logit(prior.rate)
    quality = 1 / (1 + F.exp(-odds))
    shown = [F.col("host"), F.col("path"), F.col("p"), F.col("at_host"), F.col("at_path"), quality, F.coalesce(quality >= threshold, F.lit(False))]
    return out.select(*[F.col(a).alias(c) for a, c in zip(aside, names, strict=True)], *[c.alias(n) for c, n in zip(shown, RESULTS, strict=True)])
