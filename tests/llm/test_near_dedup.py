"""op4: components against all pairs, in every way that a link can be found."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from namewright.llm import near_dedup as nd
from namewright.llm.components import components
from tests.llm.conftest import SCHEMA, sentence


def test_cross_links_keep_shingles_apart(spark):
    """A pair of exactly 0.8 whose shared shingles hold two with equal low halves of their hashes."""
    words = [f"w{i}".encode() for i in range(300_000)]
    low = nd._mix(np.fromiter((nd.xxhash.xxh3_64_intdigest(w, nd.SEED) for w in words), np.uint64, len(words))).astype("<u4")
    order = np.argsort(low, kind="stable")
    i = np.flatnonzero(np.diff(low[order].astype(np.int64)) == 0)[0]
    alike = [words[order[i]].decode(), words[order[i + 1]].decode()]
    shared = alike + [f"shared{i}" for i in range(78)]
    docs = spark.createDataFrame([(1, " ".join(shared + [f"a{i}" for i in range(10)])), (2, " ".join(shared + [f"b{i}" for i in range(10)]))], "doc_id long, text string")
    nodes = nd.sign(docs, 1, nd.BANDS * nd.ROWS).selectExpr("digest", "doc_id AS least", "n", "sig")
    rest = nodes.selectExpr("1L AS key", "0 AS band", "digest", "n", "digest AS root")
    texts = nd.load_words(docs, nodes, nodes.select("digest"))
    likely = nd.cross_links(rest, texts, nodes, 1, 80, nd.BANDS, nd.ROWS, nd.MISS, [])
    assert likely.count() == 1 and nd.confirm(likely, texts, 1, 80).count() == 1


def brute(rows, k, percent=80):
    sets = [nd.shingles(nd.word_list(t), k) for _, t in rows]
    at, root = defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in at[g])
        for g in s:
            at[g].append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)), least.get(find(i)) is None or d == least[find(i)]) for i, (d, _) in enumerate(rows)]


def check(docs, k, **kw):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.dedup(docs, shingle=k, **kw).collect()), key=repr)
    assert got == sorted(brute(rows, k), key=repr)


@pytest.mark.parametrize("name,k", [("odd", 2), ("clashing", 5), ("some", 2), ("some", 5)])
def test_all_pairs(request, name, k):
    check(request.getfixturevalue(name), k)


def family(seed, n, edits):
    """Near copies of one text whose similarities to each other lie about the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = f"x{i}_{rng.randrange(1000)}"
        out.append((i, " ".join(w), "en", "s", 1))
    return out


def test_family_about_the_threshold(spark, monkeypatch):
    check(spark.createDataFrame(family(1, 150, [2, 4, 6, 8, 12]), SCHEMA), 2)
    monkeypatch.setattr(nd, "CHUNKS", (7, 16, 500))  # many blocks a bucket
    check(spark.createDataFrame(family(2, 120, [5, 8, 10]), SCHEMA), 2)


def test_links_past_the_limit(spark, monkeypatch):
    """Where no link that a block gave out first is true, all its likely links are tried."""
    docs = spark.createDataFrame([(r[0], r[1]) for r in family(3, 40, [1, 2])], "doc_id long, text string")
    nodes = nd.sign(docs, 1, nd.BANDS * nd.ROWS).selectExpr("digest", "doc_id AS least", "n", "sig").cache()
    rest = nodes.selectExpr("1L AS key", "0 AS band", "digest", "n", "unhex(lpad(hex(least % 2), 2, '0')) AS root")
    texts = nd.load_words(docs, nodes, nodes.select("digest")).cache()
    confirm, calls = nd.confirm, []
    given = nd.cross_links(rest, texts, nodes, 1, 80, nd.BANDS, nd.ROWS, nd.MISS, [], 3)
    assert given.count() == 3 and given.filter("more").count() == 3
    every = confirm(nd.cross_links(rest, texts, nodes, 1, 80, nd.BANDS, nd.ROWS, nd.MISS, [], None).select("a", "b"), texts, 1, 80).count()

    def fails_at_first(pairs, *a):
        calls.append(pairs.count())
        return confirm(pairs, *a).limit(0) if len(calls) == 1 else confirm(pairs, *a)

    monkeypatch.setattr(nd, "confirm", fails_at_first)
    out = nd.all_cross_links(rest, texts, nodes, 1, 80, nd.BANDS, nd.ROWS, nd.MISS, [], 3)
    assert calls[0] == 3 and out.count() == every > 100
    monkeypatch.setattr(nd, "confirm", confirm)
    assert nd.all_cross_links(rest, texts, nodes, 1, 80, nd.BANDS, nd.ROWS, nd.MISS, [], 3).count() == 3


def test_empty(none):
    assert nd.dedup(none).count() == 0


def test_signature_estimates():
    rng = random.Random(4)
    f, a = nd.multipliers(2000), sentence(rng, 300).split()
    b = a[:200] + sentence(rng, 100).split()
    x, y = (nd.signature(nd.hashes([w.encode() for w in s], 2, {}), f) for s in (a, b))
    sa, sb = nd.shingles(a, 2), nd.shingles(b, 2)
    assert abs((x == y).mean() - len(sa & sb) / len(sa | sb)) < 0.05


def test_least_matches():
    """The posterior by numerical integration."""
    s = np.linspace(0, 1, 20001)[1:-1]
    for i, m in enumerate(nd.least_matches(160, 0.8, 1e-7, 20)):
        n = 20 * (i + 1)
        for k, keeps in ((m, True), (m - 1, False)):
            if k >= 0:
                like = np.exp(k * np.log(s) + (n - k) * np.log1p(-s) - max(k * math.log(max(k / n, 1e-9)) + (n - k) * math.log(max(1 - k / n, 1e-9)), -700))
                assert (like[s >= 0.8].sum() / like.sum() >= 1e-7) == keeps


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 540)]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {x: find(x) for x in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
