import random

import pytest
from pyspark.sql import types as T

WORDS = ["the", "of", "and", "to", "in", "is", "idiot", "Zebra", "naïve", "tree,", "river.", "stone", "cloud", "ember", "lantern", "quiet", "harbor", "violet"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use for columns of their own.
CLASHING = ["kept", "n", "digest", "key", "_f", "_z", "_at", "spans", "text_hash", "words", "w", "t"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.5 else "") for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties, equal texts under other ids."""
    rng = random.Random(5)
    base, long_ = sentence(rng, 120), sentence(rng, 20_000)
    texts = [None, "", "  \n\t ", "one", "two words", base, base, base + " more", base.replace("the", "an"), long_, long_ + " tail", "é▁ü 中文 \U0001f600\n\tq", "a\nb\na\nb\n\na", "x" * 5000, "ab" * 3000, "\x0b\x0c \x00 z", "<|endoftext|> A B"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [(None, base, None, None, None), (None, None, None, None, None), rows[5], rows[5], (3, "another text under a used id", "xx", "s1", 5)]


def corpus(n=120, seed=1):
    """Texts with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    out, passage = [], sentence(rng, 90)
    for i in range(n):
        kind = i % 6
        if kind == 1 and out:
            t = rng.choice(out)
        elif kind == 2 and out:
            w = rng.choice(out).split(" ")
            for _ in range(max(1, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            t = " ".join(w)
        elif kind == 3:
            t = sentence(rng, 40) + " " + passage + " " + sentence(rng, 30)
        else:
            t = sentence(rng, rng.randrange(1, 200))
        out.append(t)
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("mine").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}
