"""op5 and op10: counts against plain Python, distances and posteriors against numpy, and verdicts on planted junk."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from namewright.llm import quality_classifier as qc
from namewright.llm import quality_rules as qr
from tests.llm.conftest import SCHEMA, sentence


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            again += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


@pytest.mark.parametrize("name", ["odd", "clashing", "some"])
def test_counts(request, name):
    docs = request.getfixturevalue(name)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in qr.score(docs).collect()), key=repr)
    assert got == sorted(((r.doc_id, *counts(r.text)) for r in docs.collect()), key=repr)


def test_repeated_windows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(80):
        w = [rng.choice("ab") if i % 2 else rng.choice("abcdefghij") for _ in range(rng.randrange(0, 60))]
        rows.append((i, " ".join(w + (w[:12] if i % 3 == 0 else [])), "en", "s", 1))
    d = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.n_repeat_words for r in qr.score(d).collect()} == {r[0]: counts(r[1])[4] for r in rows}


def test_jensen_shannon(spark):
    rng = np.random.default_rng(1)
    rows = [([int(x) for x in rng.integers(0, 9, 5)], [float(x) for x in rng.random(5)]) for _ in range(20)] + [([0] * 5, [1.0] * 5), ([1, 0, 0, 0, 0], [0.0, 1.0, 0.0, 0.0, 0.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<bigint>, q array<double>").select(qr.jensen_shannon("p", "q")).collect()]
    for (p, q), g in zip(rows, got, strict=True):
        if sum(p) == 0:
            assert g is None
            continue
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        kl = lambda a, m=m: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        assert abs(g - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-9
    assert got[-1] == 1.0


def test_verdicts(spark):
    rng = random.Random(2)
    good = [(i, sentence(rng, 150), "en", "s", 1) for i in range(60)]
    bad = [(100 + i, " ".join(w + "***$$$" for w in sentence(rng, 150).split()), "en", "s", 1) for i in range(5)] + [(200 + i, sentence(rng, 150).upper().replace(" ", "!! "), "en", "s", 1) for i in range(5)]
    short = [(300, "ODD *** " + sentence(rng, 22)[:100], "en", "s", 1)]
    kept = {r.doc_id: r.kept for r in qr.score(spark.createDataFrame(good + bad + short, SCHEMA)).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[r[0]] for r in bad)


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int")


def test_classifier(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 80) if i % 4 else "buy!! #### $$$ " * 20, "en", f"s{i % 3}", 1) for i in range(120)]
    d = spark.createDataFrame(rows, SCHEMA)
    out = qc.score(d, labels(spark, [(i, int(i % 4 > 0)) for i in range(0, 120, 2)]), F.col("source"), F.col("lang")).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in out) and out[0].asDict().keys() >= {"text", "p_document", "path_posterior"}


@pytest.mark.parametrize("name", ["odd", "clashing", "none"])
def test_classifier_edges(request, spark, name):
    d = request.getfixturevalue(name)
    for lab in (labels(spark, []), labels(spark, [(5, 1), (13, 0), (None, 1), (6, None), (5, 1)])):
        out = qc.score(d, lab, F.col("source"), F.col("lang")).collect()
        assert len(out) == d.count() and all(0 < r.p_quality < 1 and r.kept is not None for r in out)


def test_fit_against_gradient():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(qc.FEATURES)))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=300) > 0).astype(float)
    m = qc.fit(x, y)
    z = (x - m.mean) / m.scale
    p = 1 / (1 + np.exp(-(z @ m.weights + m.bias)))
    assert np.abs(z.T @ (y - p) - np.array(m.weights)).max() < 1e-3


def test_shrinkage(spark):
    """Sparse hosts and paths lie between their own rate and the level above; large ones keep theirs."""
    rows = [("big", "a", 0.9)] * 400 + [("big", "b", 0.1)] * 400 + [("poor", "a", 0.1)] * 400 + [("tiny", "a", 0.99)]
    out, rate = qc.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    by = {(r.host, r.path): r for r in out.collect()}
    rate = rate.rate
    assert abs(by["big", "a"].path_posterior - 0.9) < 0.02 and abs(by["big", "b"].path_posterior - 0.1) < 0.02
    t = by["tiny", "a"]
    assert rate < t.host_posterior < 0.99 and t.host_posterior <= t.path_posterior < 0.99
    empty, rate = qc.posteriors(spark.createDataFrame([], "host string, path string, p double"))
    assert empty.count() == 0 and rate.rate == 0.5


def plain_sites(rows, threshold=0.5):
    """From (site, z): posteriors and verdicts by plain loops, each row's sites taken without the row."""
    p = [1 / (1 + np.exp(-z)) for _, z in rows]
    n, total = len(rows), sum(p)
    rate = min(1 - 1e-6, max(1e-6, (total + 1) / (n + 2)))
    host, path = {}, {}
    for ((h, q), _), x in zip(rows, p, strict=True):
        for d, k in ((host, h), (path, (h, q))):
            c, s, noise = d.get(k, (0, 0.0, 0.0))
            d[k] = (c + 1, s + x, noise + x * (1 - x))
    k_host = qc.strength(rate, sum(c * (s / c - rate) ** 2 - v / c for c, s, v in host.values()) / n)
    post = {h: (s + k_host * rate) / (c + k_host) for h, (c, s, _) in host.items()}
    k_path = qc.strength(rate, sum(c * (s / c - post[k[0]]) ** 2 - v / c for k, (c, s, v) in path.items()) / n)
    out = []
    for ((h, q), z), x in zip(rows, p, strict=True):
        at_host = (host[h][1] - x + k_host * rate) / (host[h][0] - 1 + k_host)
        at_path = (path[h, q][1] - x + k_path * at_host) / (path[h, q][0] - 1 + k_path)
        odds = z + np.log(at_path / (1 - at_path)) - qc.logit(rate)
        out.append((x, at_host, at_path, 1 / (1 + np.exp(-odds))))
    return out


def plain_features(t):
    t = t or ""
    w, n = re.findall(r"[^\x20\x09-\x0D]+", t), max(1, len(t))
    share = lambda allowed: sum(c in allowed for c in t) / n
    lines, n_w = t.split("\n"), max(1, len(w))
    return [
        share("#*$%&|<>"), share("!"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share(".,;:"), len(set(w)) / n_w, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n_w,
        min(n / n_w, 40.0), np.log(n_w), 1 - len(set(lines)) / len(lines),
    ]


@pytest.mark.parametrize("name", ["odd", "clashing", "some", "sf"])
def test_whole_results(request, spark, sf, name):
    """Every number of every row, from the texts on, against plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet") if name == "sf" else request.getfixturevalue(name)
    lab = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality") if name == "sf" else labels(spark, [(i, i % 3 % 2) for i in range(0, 100, 2)])
    m = qc.train(docs, lab)
    rows = [(r.doc_id, r.text, (r.source or qc.NONE, r.lang or qc.NONE)) for r in docs.collect()]
    z = [float(np.clip(((np.array(plain_features(t)) - m.mean) / m.scale) @ np.array(m.weights) + m.bias, -12, 12)) for _, t, _ in rows]
    want = plain_sites([(site, x) for (_, _, site), x in zip(rows, z, strict=True)])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((d, np.round(w[3], 6), *w, w[3] >= 0.5) for (d, _, _), w in zip(rows, want, strict=True)), key=key)
    got = sorted(((r.doc_id, np.round(r.p_quality, 6), r.p_document, r.host_posterior, r.path_posterior, r.p_quality, r.kept) for r in qc.score(docs, lab, F.col("source"), F.col("lang")).collect()), key=key)
    assert [(g[0], g[6]) for g in got] == [(w[0], w[6]) for w in want]
    assert np.allclose([g[2:6] for g in got], [w[2:6] for w in want], rtol=1e-7, atol=1e-9)


def test_sites_turn_verdicts(spark):
    """Documents that tell little by themselves go the way of their site's others; a site's only document keeps its own verdict."""
    rng = random.Random(6)
    junk, between = "buy!! #### $$$ " * 20, lambda: sentence(rng, 60) + " !!! ### " * 4
    rows = [(i, sentence(rng, 80), "en", "good.example", 1) for i in range(200)] + [(1000 + i, junk, "en", "bad.example", 1) for i in range(200)]
    rows += [(3000 + i, between(), "en", "good.example" if i < 10 else "bad.example", 1) for i in range(20)] + [(5000, between(), "en", "alone.example", 1)]
    mixed = [(i, between(), "en", f"any{i}.example", 1) for i in range(4000, 4060)]
    lab = labels(spark, [(i, 1) for i in range(60)] + [(1000 + i, 0) for i in range(60)] + [(4000 + i, i % 2) for i in range(60)])
    out = {r.doc_id: r for r in qc.score(spark.createDataFrame(rows + mixed, SCHEMA), lab, F.col("source"), F.col("lang")).collect()}
    at_good, at_bad = [out[3000 + i] for i in range(10)], [out[3010 + i] for i in range(10)]
    assert all(r.kept for r in at_good) and not any(r.kept for r in at_bad)
    assert any((r.p_document >= 0.5) != r.kept for r in at_good + at_bad)
    alone = out[5000]
    assert abs(alone.p_quality - alone.p_document) < 1e-9 and all(out[i].kept for i in range(200)) and not any(out[1000 + i].kept for i in range(200))


def test_user_columns_stay(spark, clashing):
    d = clashing.selectExpr("*", "'m' AS _t", "'m' AS _w", "'m' AS z", "'m' AS p", "'m' AS c0", "'m' AS host", "'m' AS at_path", "'m' AS `a.b`")
    out = qc.score(d, labels(spark, [(5, 1), (13, 0)]), F.col("source"), F.col("lang"))
    assert out.columns == [c for c in d.columns if c not in qc.RESULTS] + qc.RESULTS
    assert all(r[c] in ("m", "mine") for r in out.collect() for c in ("_t", "_w", "z", "p", "c0", "host", "at_path", "a.b", "_f", "w"))


def test_filters_do_not_repeat_the_features(odd, spark):
    """A filter on the verdict must not bring the features into a filter of its own below the join."""
    kept = qc.score(odd, labels(spark, [(5, 1), (13, 0)]), F.col("source"), F.col("lang")).filter("kept").select("doc_id")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_replace" in line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter"))
