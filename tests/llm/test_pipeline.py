"""The pipeline: each stage on all that its predecessor kept, against the operators' verdicts and brute force."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from namewright.llm import near_dedup, quality_classifier, quality_rules
from tests.llm.test_near_dedup import brute
from tests.llm.test_suffix_dedup import brute as windows


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = dict(cp.STAGES)
    assert list(s) == ["quality_classifier", "quality_rules", "near_dedup", "suffix_dedup", "packing"]
    a = s["quality_classifier"](spark, docs, sf).cache()
    verdict = quality_classifier.score(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.col("source"), F.col("lang"))
    assert a.columns == docs.columns and ids(a) == ids(verdict.filter("kept"))
    b = s["quality_rules"](spark, a, sf).cache()
    assert b.columns == docs.columns and ids(b) == ids(quality_rules.score(a).filter("kept"))
    c = s["near_dedup"](spark, b, sf).cache()
    rows = [(r.doc_id, r.text) for r in b.collect()]
    assert ids(c) == sorted((d for d, _, _, kept in brute(rows, 5) if kept), key=repr)
    e = s["suffix_dedup"](spark, c, sf).cache()
    want = {d: left for d, n, gone, _, _ in windows([(r.doc_id, r.text) for r in c.collect()], cp.REPEAT_BYTES) if (left := n - gone) >= 0}
    for r in e.collect():
        assert 0 <= want[r.doc_id] - len(r.text.encode()) <= 6 and r.n_chars == len(r.text)
    assert ids(e) == ids(c)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in s["packing"](spark, e, sf).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.tokens, "<u4").tolist())
    assert got == {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in e.collect()}
    whole = {}
    for r in entry.queries()["pipeline"](spark, sf).orderBy("doc_id", "start").collect():
        whole.setdefault(r.doc_id, []).extend(np.frombuffer(r.tokens, "<u4").tolist())
    assert whole == got


def test_passages_of_over_fifty_words(spark, sf):
    """Shared passages of 51 words and less than 400 bytes go; texts about them, and other texts, stay."""
    import random

    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice((3, 4, 5, 6)))) for _ in range(n))
    passages = [words(51) for _ in range(5)]
    rows, own = [], {}
    for i in range(40):
        a, b = words(60), words(45)
        own[i] = (a, b)
        rows.append((i, f"{a}\n{passages[i % 5]}\n{b}" if i < 20 else f"{a} {b}", "en", "s", 1))
    assert all(cp.REPEAT_BYTES <= len(p) < 400 for p in passages)
    got = {r.doc_id: r.text for r in cp.cut_repeats(spark, spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars"]), sf).collect()}
    for i, (a, b) in own.items():
        if i < 20:  # letters beside a passage may happen to be the same, too
            assert passages[i % 5] not in got[i] and got[i].startswith(a[:-8]) and got[i].endswith(b[8:]) and len(a + b) - 16 <= len(got[i]) <= len(a + b)
        else:
            assert got[i] == f"{a} {b}"


def test_odd_tables(spark, sf, odd, clashing, none):
    for docs in (odd, clashing, none):
        d = docs
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, d, sf).cache()
            assert out.columns == docs.columns and out.count() <= d.count()
            if "kept" in out.columns:
                assert out.filter("kept <> 'mine' or kept is null").count() == 0
            d = out
        cp.STAGES[-1][1](spark, d, sf).collect()
    # rows that share an id are told apart
    kept = near_dedup.dedup(odd).filter("doc_id = 3").collect()
    assert len(kept) == 2


def test_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline" and n[2:3].isdigit()) == list(range(1, 11)) and "pipeline" in names
