"""op7: planted toxic texts are found, clean ones are not, and the chain trains out of fold."""

import math
import random
import re

import numpy as np
import pytest

from namewright.llm import toxicity as tx
from tests.llm.conftest import SCHEMA

BAD = ["idiot", "moron", "scumbag"]
CLEAN = ["tree", "river", "stone", "cloud", "ember", "lantern", "quiet", "harbor"]


def data(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(CLEAN) + str(rng.randrange(100)) for _ in range(rng.randrange(20, 200))]
        bad = i % 7 == 0
        for _ in range(rng.randrange(1, 6) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(BAD) if i % 2 else "vilen" + rng.choice("abcdefgh")
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out(spark):
    rows, labels = data(1, 700)
    d = spark.createDataFrame(rows, SCHEMA)
    chain = tx.train(d, spark.createDataFrame(labels[:400], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in tx.score(d, chain).collect()}
    assert all(got[i].is_toxic == bool(y) for i, y in labels[400:])
    assert all(0 <= getattr(got[i], f"p_{c}") <= 1 for i in got for c in tx.CATEGORIES)


@pytest.mark.parametrize("name", ["odd", "clashing", "none"])
def test_edges(request, spark, name):
    d = request.getfixturevalue(name)
    for lab in ([], [(5, 1), (9, 0), (None, 1), (6, None), (5, 1)], [(5, 1)]):
        out = tx.score(d, tx.train(d, spark.createDataFrame(lab, "doc_id long, toxic int"))).collect()
        assert len(out) == d.count() and all(r.is_toxic is not None for r in out)


def test_chain_uses_earlier_predictions():
    rng = np.random.default_rng(3)
    x = (rng.random((400, 3)) < 0.3).astype(float)
    first = (x[:, 0] > 0).astype(float)
    t = np.column_stack([first, first * (rng.random(400) < 0.9)])
    chain = tx.train_chain({"a": 0, "b": 1, "c": 2}, x, t, np.arange(400) % tx.FOLDS, np.ones(400))
    assert len(chain.models[0]) == 4 and len(chain.models[1]) == 5 and chain.models[1][3] > 0
    p = chain.predict(np.array([[1.0, 0, 0], [0, 1.0, 1.0]]))
    assert p[0].min() > 0.5 > p[1].max()


def plain_probabilities(chain, text):
    """The chain by hand for one text."""
    words = re.findall(r"\w+", (text or "").lower())
    begins = lambda w: [w[:n] + "*" for n in tx.PREFIXES if len(w) > n]
    here = {f for w in words for f in [w, *begins(w)]}
    presence = [1.0 if f in here else 0.0 for f, _ in sorted(chain.index.items(), key=lambda kv: kv[1])]
    n = min(tx.MOST, sum(any(f in chain.index for f in [w, *begins(w)]) for w in words))
    size = len(bin(len(words))) - 2 if words else 0
    out = []
    for w, view in zip(chain.models, (presence, [n, size, n / (1 + size)], presence), strict=True):
        z = sum(a * b for a, b in zip(w, [*view, *out, 1.0], strict=True))
        out.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return out


@pytest.mark.parametrize("name", ["odd", "clashing", "sf"])
def test_whole_results(request, spark, sf, name):
    """Every row of the query's table against plain Python."""
    if name == "sf":
        d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    else:
        d, lab = request.getfixturevalue(name), spark.createDataFrame([(r[0], r[1]) for r in data(2, 120)[1]], "doc_id long, toxic int")
        d = d.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t, *_ in data(2, 120)[0]], "doc_id long, text string"))
    chain = tx.train(d, lab)
    assert chain.index
    got = sorted(((r.doc_id, r.p_insult, r.p_severe, r.p_toxic, r.is_toxic) for r in tx.score(d, chain).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    want = sorted(((r.doc_id, *plain_probabilities(chain, r.text)) for r in d.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1:4] for g in got], [w[1:] for w in want], atol=1e-9)
    assert all(g[4] == (w[3] >= 0.5) for g, w in zip(got, want, strict=True) if abs(w[3] - 0.5) > 1e-9)


def test_links_add_what_the_last_model_does_not_see(spark):
    """Where only the number of abusive words tells, the last model is better with the links than alone."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(3000):
        n = rng.choice((0,) * 16 + (1, 4, 5))
        w = [rng.choice(CLEAN) + str(rng.randrange(100)) for _ in range(30)]
        for k in rng.sample(range(30), n):
            w[k] = "idiot"
        rows.append((i, " ".join(w)))
        labels.append((i, int(n >= 4 or (n == 1 and rng.random() < 0.1))))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    chain = tx.train(d, spark.createDataFrame(labels[:2000], "doc_id long, toxic int"))
    got = {r.doc_id: r.p_toxic for r in tx.score(d, chain).collect()}
    x, y = np.array([["idiot" in t.split()] for _, t in rows], float), np.array([v for _, v in labels], float)
    alone = tx.fit(x[:2000], y[:2000], np.ones(2000))
    p = 1 / (1 + np.exp(-(x[2000:, 0] * alone[0] + alone[1])))
    loss = lambda p: -np.mean(y[2000:] * np.log(p) + (1 - y[2000:]) * np.log(1 - p))
    with_links = loss(np.clip([got[i] for i in range(2000, 3000)], 1e-9, 1 - 1e-9))
    assert with_links < 0.7 * loss(p)


def test_very_long_text(spark):
    d = spark.createDataFrame([(1, "tree " * 300_000 + "moron"), (2, "tree " * 300_000)], "doc_id long, text string")
    rows, labels = data(4, 140)
    chain = tx.train(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in tx.score(d, chain).collect()}
    assert got[1].p_insult > got[2].p_insult and not got[2].is_toxic
