"""Edge builders, transitive relations and best-first recommendation against a plain heap model."""

import heapq
import random

from pyspark.sql import functions as F

from namewright.operators import expand, graph


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_builders(spark):
    owned = spark.createDataFrame([("C", "f"), ("C", "g"), ("D", "h")], "cls string, member string")
    assert rows(graph.siblings(owned)) == [("f", "siblings", "g"), ("g", "siblings", "f")]
    assert ("C", "fields", "f") in rows(graph.members(owned, "fields")) and ("f", "enclosingClass", "C") in rows(graph.members(owned, "fields"))
    assert rows(graph.hierarchy(spark.createDataFrame([("A", "B")], "child string, parent string"))) == [("A", "parents", "B"), ("B", "subclass", "A")]
    assigned = spark.createDataFrame([(["a"], ["b", "c"])], "left array<string>, right array<string>")
    assert len(rows(graph.assignments(assigned))) == 4
    assert rows(graph.parameters(spark.createDataFrame([("m", "p")], "method string, param string"))) == [("m", "parameter", "p"), ("p", "enclosingMethod", "m")]
    assert len(rows(graph.types(spark.createDataFrame([("v", "T")], "id string, type_id string")))) == 2


def test_ancestors_and_cycles(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("X", "Y"), ("Y", "X")], "child string, parent string")
    got = {(r.src, r.dst) for r in graph.ancestors(spark, e).filter("rel = 'ancestor'").collect()}
    assert got == {("A", "C"), ("A", "D"), ("B", "D"), ("X", "X"), ("Y", "Y"), ("X", "Y"), ("Y", "X")}


def test_invocations(spark):
    calls = spark.createDataFrame([("c1", "m", "v", [["x"], ["y", "K"]]), ("c2", "m", None, [["z"]])], "call string, method string, invoker string, args array<array<string>>")
    params = spark.createDataFrame([("m", "p0", 0), ("m", "p1", 1)], "method string, param string, pos int")
    classes = spark.createDataFrame([("K",)], "id string")
    assert rows(graph.invocations(calls, params, classes)) == sorted([("x", "parameterArgument", "p0"), ("p0", "argument", "x"), ("y", "parameterArgument", "p1"), ("p1", "argument", "y"), ("v", "methodInvocated", "m")])


def test_comments_types_lines(spark):
    comments = spark.createDataFrame([("f", 1, 1, "same"), ("f", 3, 4, "next"), ("f", 9, 9, "none")], "file string, start int, stop int, comment string")
    code = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("f", 5, "c")], "file string, line int, id string")
    assert [(r.comment, r.id) for r in graph.attach_comments(comments, code).orderBy("id").collect()] == [("same", "a"), ("next", "c")]
    listed = spark.createDataFrame([("i", "MethodName"), ("i", "VariableName"), ("j", "ClassName")], "id string, id_type string")
    assert rows(graph.one_kind(listed)) == [("i", "VariableName"), ("j", "ClassName")]
    ids = spark.createDataFrame([("i", "n"), ("k", "n")], "id string, name string")
    assert [(r.id, r.line) for r in graph.located(ids, spark.createDataFrame([("i", 7)], "id string, line int")).orderBy("id").collect()] == [("i", 7), ("k", -1)]
    edges = spark.createDataFrame([("i", "r", "q")], "src string, rel string, dst string")
    assert rows(graph.unlisted(edges, ids)) == [("q",)]


def heap_model(trigger, nodes, edges, hit):
    """Best-first by a priority queue; first pop of each id counts."""
    heap, seen, out = [(0, trigger)], set(), {}
    while heap:
        s, i = heapq.heappop(heap)
        if i in seen:
            continue
        seen.add(i)
        ok = i != trigger and hit(trigger, i)
        if ok:
            out[i] = s
        for j in edges.get(i, ()):
            t = s + 1 + (0 if ok or i == trigger else 5) + (nodes[i] != nodes[j])
            if t < graph.MOST_SCORE and j not in seen:
                heapq.heappush(heap, (t, j))
    return out


def test_best_first(spark):
    rng = random.Random(3)
    nodes = {i: rng.choice("fg") for i in range(30)}
    pairs = {(a, b) for a in nodes for b in rng.sample(range(30), 3) if a != b}
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, []).append(b)
    hit = lambda t, i: (t + i) % 3 == 0
    ids = spark.createDataFrame([(i, f, str(i)) for i, f in nodes.items()], "id long, file string, name string")
    triggers = spark.createDataFrame([(i, i, str(i), "new") for i in nodes], "trigger_id long, id long, old_name string, new_name string")
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    rec = lambda old, new, name: F.when((old.cast("int") + name.cast("int")) % 3 == 0, F.concat(name, F.lit("'")))
    got = {}
    for r in graph.best_first(triggers, ids, e, rec).collect():
        got.setdefault(r.trigger_id, {})[r.id] = r["rank"]
    assert got == {t: m for t in nodes if (m := heap_model(t, nodes, adj, hit))}
    few = graph.best_first(triggers, ids, e, rec, most_found=2).groupBy("trigger_id").count().agg(F.max("count")).first()[0]
    assert few == 2


def test_scan_all(spark):
    t = spark.createDataFrame([("t", "s", "1", "a", "b")], "trigger_id string, snapshot string, id string, old_name string, new_name string")
    i = spark.createDataFrame([("s", "1", "a"), ("s", "2", "a"), ("s", "3", "c"), ("z", "4", "a")], "snapshot string, id string, name string")
    rec = lambda old, new, name: F.when(name == old, new)
    assert rows(graph.scan_all(t, i, rec)) == [("t", "2", "b", 0)]


def test_siblings_of_several_classes(spark):
    """A pair comes once, however many classes it shares; classes of two columns; nothing is dealt out again after pairs of members of one class alone are formed."""
    owned = spark.createDataFrame([("f", 1, "a"), ("f", 1, "b"), ("f", 1, "c"), ("f", 2, "a"), ("f", 2, "b"), ("g", 1, "d"), (None, 1, "e"), (None, 1, "x")], "file string, line int, member string")
    want = [(x, "siblings", y) for x, y in ("ab", "ac", "ba", "bc", "ca", "cb")]
    assert rows(graph.siblings(owned, ("file", "line"))) == want
    kinds = spark.createDataFrame([("a", "MethodName"), ("b", "ParameterName")], "id string, id_type string")
    assert rows(graph.siblings(owned, ("file", "line"), graph.carriers(kinds, "siblings"))) == [r for r in want if r[0] == "a"]


def test_scan_all_works_each_case_out_once(spark):
    """Ten triggers of one rename and a hundred candidates of two names are two cases; what does not change is dropped before ids meet."""
    t = spark.range(10).selectExpr("id as trigger_id", "'s' as snapshot", "id", "'a' as old_name", "'b' as new_name")
    i = spark.range(100).selectExpr("'s' as snapshot", "id", "if(id % 2 = 0, 'a', 'c') as name")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def rec(old, new, name):
        calls.add(1)
        return new if name == old else None

    out = graph.scan_all(t, i, rec)
    assert out.count() == 10 * 50 - 5 and {r.new_name for r in out.collect()} == {"b"}
    assert calls.value == 2


def test_expansion(spark):
    d = spark.createDataFrame([("sb", ["string", "builder", "size"]), ("ctx", ["context", "text"]), ("str", ["string", "strong", "structure"]), ("q", ["queue"]), ("vals", ["value"])], "a string, t array<string>")
    r = d.select("a", expand.with_plural(expand.table_side, F.col("a"), F.col("t")).alias("e")).collect()
    got = {x.a: (x.e.heuristic, x.e.expansion) if x.e else None for x in r}
    assert got == {"sb": ("H1", "string#builder"), "ctx": ("H3", "context"), "str": ("H2", "string"), "q": ("H2", "queue"), "vals": ("H2", "value")}
    last = d.select("a", expand.trigger_side(F.col("a"), F.col("t")).alias("e")).filter("a = 'str'").first().e
    assert (last.heuristic, last.expansion) == ("H2", "structure")
    known = F.array(F.lit("string"))
    assert d.filter("a = 'sb'").select(expand.acronym(F.col("a"), F.col("t"), known)).first()[0] is None


def test_vote_cascade_records(spark):
    f = spark.createDataFrame([("i", "w", "H2", "aaa"), ("i", "w", "H3", "bb"), ("i", "w", "H2", "bb"), ("i", "w", "H2", "aaa"), ("j", "w", "H2", "cc"), ("j", "w", "H2", "bb")], "id string, word string, heuristic string, expansion string")
    assert [(r.id, r.expansion, r.votes) for r in expand.vote(f, ["id", "word"]).orderBy("id").collect()] == [("i", "bb", 2), ("j", "bb", 1)]
    u = spark.createDataFrame([("i", "w"), ("k", "db"), ("k", "zz")], "id string, word string")
    out = expand.expanded(u, expand.vote(f, ["id", "word"]), spark.createDataFrame([("db", "database")], "abbr string, expansion string"))
    assert {(r.word, r.expansion, r.heuristic) for r in out.collect()} == {("w", "bb", "H2"), ("db", "database", "H3"), ("zz", "zz", "ST")}
    m = F.create_map(F.lit("cls"), F.lit("class"))
    none = F.create_map().cast("map<string,string>")
    r = spark.range(1).select(expand.cascade(F.lit("cls"), F.lit(False), F.array(F.lit("other")), m, none, none), expand.cascade(F.lit("ot"), F.lit(False), F.array(F.lit("other")), m, none, none), expand.cascade(F.lit("zz"), F.lit(False), F.array(F.lit("other")), m, none, none)).first()
    assert list(r) == ["class", "other", "zz"]
    parts = spark.range(1).select(expand.parts_of(F.lit("string#builder"), F.lit("H1"), F.lit("TITLE"))).first()[0]
    assert [(p.word, p.case) for p in parts] == [("string", "UPPER"), ("builder", "LOWER")]
    rec = spark.createDataFrame([("H2", "context", "cont", 2), ("H2", "context", "con", 1), ("H1", "x", "y", 0)], "heuristic string, expansion string, abbr string, seq int")
    assert rows(expand.record_of(rec)) == [("H2", "context", "con")]
    cr = spark.createDataFrame([("f", "c", "class"), ("f", "c", "class"), ("f", "c", "count")], "file string, abbr string, expansion string")
    assert rows(expand.class_record(cr)) == [("f", "c", "class")]
    uw = spark.createDataFrame([("i", "ab"), ("i", "a"), ("i", "cd")], "id string, word string")
    assert {r.word for r in expand.unknown_words(uw, spark.createDataFrame([("ab",), ("a",)], "word string")).collect()} == {"a", "cd"}


def test_comment_and_skips(spark):
    d = spark.createDataFrame([("ctx", "The Context, of it.", "H3", "context", ["ctx"]), ("sb", "x", "H1", "string#builder", ["sb"]), ("zz", "y", None, None, [])], "a string, c string, h string, e string, s array<string>")
    r = d.select("a", expand.from_comment(F.col("a"), F.col("c")).alias("x"), expand.unless_skipped(F.col("a"), F.col("e"), F.col("h"), F.col("s")).alias("y")).collect()
    assert {x.a: (x.x.expansion if x.x else None, x.y) for x in r} == {"ctx": ("context", "ctx"), "sb": (None, "string#builder"), "zz": (None, "zz")}


def test_related_pairs(spark):
    from namewright.operators import study

    units = spark.createDataFrame([("u", "C", "ClassName", "f"), ("u", "m", "MethodName", "f"), ("u", "v", "FieldName", "g"), ("w", "n", "MethodName", "f")], "unit string, id string, id_type string, file string")
    edges = spark.createDataFrame([("C", "methods", "m"), ("v", "type", "C"), ("C", "methods", "n"), ("C", "fields", "v")], "src string, rel string, dst string")
    pairs = graph.related_pairs(units, edges)
    assert rows(pairs) == [("u", "BelongsM", "C", "m"), ("u", "TypeV", "C", "v")]  # the field of another file does not belong
    n = study.relation_counts(pairs, spark.createDataFrame([("u", "insert"), ("u", "delete")], "unit string, op string"))
    assert {(r.relation, r.op): r.n for r in n.collect()}[("BelongsM", None)] == 1


def test_deep_ancestors(spark):
    """A chain of 70 levels and a cycle of five beside it: no level is left out, no pair comes twice."""
    chain = [(f"a{i:02}", f"a{i + 1:02}") for i in range(70)]
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)]
    got = [(r.src, r.dst) for r in graph.ancestors(spark, spark.createDataFrame(chain + ring, "child string, parent string")).filter("rel = 'ancestor'").collect()]
    want = {(f"a{i:02}", f"a{j:02}") for i in range(71) for j in range(i + 2, 71)} | {(f"r{i}", f"r{j}") for i in range(5) for j in range(5)}
    assert len(got) == len(set(got)) and set(got) == want
    assert graph.ancestors(spark, spark.createDataFrame([], "child string, parent string")).count() == 0


def test_related_pairs_of_large_units(spark):
    """Both ways of meeting units and edges give the same."""
    rng = random.Random(5)
    kinds = ["ClassName", "MethodName", "FieldName", "ParameterName", "VariableName"]
    units = spark.createDataFrame([(u, f"i{i}", rng.choice(kinds), rng.choice("fg")) for u in range(3) for i in rng.sample(range(40), 25)], "unit long, id string, id_type string, file string")
    rels = sorted({v[2] for v in graph.PAIR_RELATIONS.values()})
    edges = spark.createDataFrame([(f"i{rng.randrange(40)}", rng.choice(rels), f"i{rng.randrange(40)}") for _ in range(3000)], "src string, rel string, dst string").distinct()
    small, large = rows(graph.related_pairs(units, edges)), rows(graph.related_pairs(units, edges, most=0))
    assert small == large and len(small) > 50


def test_dictionary_in_heuristics(spark):
    """H2 and H3 take dictionary terms alone; an acronym over others gives nothing and the prefix is tried."""
    names = spark.createDataFrame([("x", ["stringent", "string", "sbuild"]), ("y", ["size", "builder"])], "id string, words array<string>")
    edges = spark.createDataFrame([("a", "siblings", "x"), ("a", "type", "y")], "src string, rel string, dst string")
    unknown = spark.createDataFrame([("a", "str"), ("a", "sb"), ("a", "szs")], "id string, word string")
    d = spark.createDataFrame([("stringent",), ("sbuild",), ("size",)], "word string")
    got = rows(expand.candidates(unknown, edges, names, d))
    assert got == [("a", "sb", "siblings", "H2", "sbuild"), ("a", "str", "siblings", "H2", "stringent"), ("a", "szs", "type", "H3", "size")]
    assert ("a", "str", "siblings", "H2", "string") in rows(expand.candidates(unknown, edges, names)) and ("a", "sb", "type", "H1", "size#builder") in rows(expand.candidates(unknown, edges, names))


def test_expansion_maps(spark):
    f = spark.createDataFrame([("i", "ctx", "context", "H3"), ("i", "sb", "string#builder", "H1"), ("i", "get", "get", "ST")], "id string, word string, expansion string, heuristic string")
    assert dict(expand.expansion_maps(f, ["id"]).first().expansions) == {"ctx": "H3:context", "sb": "H1:string#builder"}
