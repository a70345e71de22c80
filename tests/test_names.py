"""Splitting, cases, patterns and joining of names, in both forms (columns and plain Python)."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namewright.functions import names
from namewright.operators import edits

CASES = [
    ("testCamelCase", ["test", "camel", "case"], ["LOWER", "TITLE", "TITLE"], ["", "", "", ""], ["LCAMEL"]),
    ("TEST_SNAKE_CASE", ["test", "snake", "case"], ["UPPER"] * 3, ["", "_", "_", ""], ["SNAKE"]),
    ("$del_ImiteR__TESt_", ["del", "imite", "r", "te", "st"], ["LOWER", "TITLE", "UPPER", "UPPER", "TITLE"], ["$", "_", "", "__", "", "_"], []),
    ("getResult", ["get", "result"], ["LOWER", "TITLE"], ["", "", ""], ["LCAMEL"]),
    ("A", ["a"], ["UPPER"], ["", ""], []),
    ("Foo<Bar_1>", ["foo"], ["TITLE"], ["", ""], ["TCAMEL"]),
    ("items[0]", ["items"], ["LOWER"], ["", ""], ["LCAMEL"]),
    ("Snake_Case", ["snake", "case"], ["TITLE", "TITLE"], ["", "_", ""], ["TCAMEL", "SNAKE"]),
]


@pytest.mark.parametrize("name,words,cases,delims,patterns", CASES)
def test_split(spark, name, words, cases, delims, patterns):
    d = spark.createDataFrame([(name,)], "n string").select(names.words("n").alias("w"), names.cases("n").alias("c"), names.delimiters("n").alias("d"))
    r = d.withColumn("p", names.patterns("c", "d")).first()
    assert (r.w, r.c, r.d, r.p) == (words, cases, delims, patterns)
    n = edits.parse(name)
    assert n.words == words and [p.case for p in n.parts] == cases and list(n.patterns) == patterns
    assert [n.lead, *[p.after for p in n.parts]] == delims


def test_odd_names(spark):
    rows = spark.createDataFrame([("",), ("$",), ("HTTPServer2Go",), (None,), ("ÄBc",)], "n string").select("n", names.words("n").alias("w"), names.delimiters("n").alias("d")).collect()
    by = {r.n: (r.w, r.d) for r in rows}
    assert by[""] == ([], [""]) and by["$"] == ([], ["$"]) and by[None] == (None, None)
    assert by["HTTPServer2Go"] == (["http", "server", "go"], ["", "", "2", ""])
    assert by["ÄBc"][0] == ["ä", "bc"]


@settings(max_examples=200, deadline=None)
@given(st.text("aBcD_$1", min_size=1, max_size=12))
def test_python_parse_keeps_every_character(name):
    n = edits.parse(name)
    assert n.lead + "".join(p.word + p.after for p in n.parts) == name.lower()
    assert all(re.fullmatch("[_$0-9]*", p.after) for p in n.parts)


def test_recase_and_join(spark):
    def one(words, patterns, cases, delims):
        d = spark.createDataFrame([(words, patterns, cases, delims)], "w array<string>, p array<string>, c array<string>, d array<string>")
        return d.select(names.join(names.recase("w", "p", "c"), "p", "d")).first()[0]

    assert one(["get", "as", "long"], ["LCAMEL"], ["LOWER"] * 3, [""] * 4) == "getAsLong"
    assert one(["get", "long"], ["TCAMEL"], ["LOWER"] * 2, [""] * 3) == "GetLong"
    assert one(["super", "ctx"], ["SNAKE"], ["LOWER"] * 2, ["", "_", ""]) == "super_ctx"
    assert one(["te", "st"], [], ["UPPER", "TITLE"], ["$", "_", "$"]) == "$TE_St$"


def test_lists(spark):
    d = spark.createDataFrame([(["a", "b", "c"], ["b", "c"])], "x array<string>, y array<string>")
    r = d.select(names.padded("x", F.lit(5)), names.padded("x", F.lit(2)), names.find_slice("x", "y"), names.find_slice("y", "x"), names.replace_slice("x", F.lit(1), F.lit(2), F.array(F.lit("z"), F.lit("w")))).first()
    assert list(r) == [["a", "b", "c", "c", "c"], ["a", "b"], 1, -1, ["a", "z", "w", "c"]]


def test_words_alike(spark):
    d = spark.createDataFrame([("abcd", "acd"), ("abcd", "adc"), ("abcd", "bcd")], "t string, a string")
    assert [r[0] for r in d.select(names.subsequence(F.col("t"), F.col("a"))).collect()] == [True, False, False]
    e = spark.createDataFrame([("Items ", "item"), ("s", ""), ("bus", "bu")], "a string, b string")
    assert [r[0] for r in e.select(names.same_word(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    assert spark.range(1).select(names.same_expansion(F.lit("string builder;x"), F.lit("string#builders"))).first()[0]


def test_abbreviated(spark):
    d = spark.createDataFrame([(["string", "context", "value"], ["H1", "H3", "ST"], {"context": "ctx"})], "w array<string>, h array<string>, m map<string,string>")
    assert d.select(names.abbreviated("w", "h", F.col("m"))).first()[0] == ["s", "ctx", "value"]
