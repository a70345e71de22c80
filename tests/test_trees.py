"""Relations found in syntax trees: facts of small trees, and pairs of units."""

import random

import pytest
from pyspark.sql import functions as F

from namewright.operators import trees

NAME = lambda x: f"<name>{x}</name>"
ONE = (
    "<unit><class>" + NAME("Outer") + "<super_list><extends><super>" + NAME("Base") + "</super></extends><implements><super>" + NAME("Face") + "</super></implements></super_list><block>"
    "<decl_stmt><decl><type>" + NAME("Type") + "</type>" + NAME("field") + "</decl></decl_stmt>"
    "<function><type>" + NAME("Type") + "</type>" + NAME("run") + "<parameter_list><parameter><decl><type>" + NAME("Type") + "</type>" + NAME("p") + "</decl></parameter><parameter><decl><type>" + NAME("int") + "</type>" + NAME("q") + "</decl></parameter></parameter_list>"
    "<block><block_content><decl_stmt><decl><type>" + NAME("int") + "</type>" + NAME("local") + "<init>=<expr>" + NAME("q") + "</expr></init></decl></decl_stmt>"
    "<expr_stmt><expr>" + NAME("field") + "<operator>=</operator><call><name>" + NAME("this") + "<operator>.</operator>" + NAME("help") + "</name><argument_list><argument><expr>" + NAME("local") + "</expr></argument></argument_list></call></expr></expr_stmt>"
    "<decl_stmt><class><block><function>" + NAME("inner") + "<parameter_list/><block><block_content><call>" + NAME("far") + "<argument_list/></call></block_content></block></function></block></class></decl_stmt>"
    "<if><condition><expr>" + NAME("local") + "<operator>==</operator>" + NAME("p") + "</expr></condition></if></block_content></block></function>"
    "<function><type>" + NAME("void") + "</type>" + NAME("help") + "<parameter_list><parameter><decl><type>" + NAME("int") + "</type>" + NAME("only") + "</decl></parameter></parameter_list><block><block_content/></block></function>"
    "<class>" + NAME("Nested") + "<block/></class></block></class></unit>"
)


def test_facts():
    f = trees.tree_facts(ONE)
    has = lambda *x: (*x, 0) in f if len(x) == 3 else x in f
    assert has("class_in", "Outer", "Nested") and has("method_of", "Outer", "run") and has("method_of", "Outer", "help") and not has("method_of", "Outer", "inner")
    assert has("field_of", "Outer", "field") and has("extends", "Outer", "Base") and has("implements", "Outer", "Face")
    assert has("returns", "run", "Type") and has("declared", "field", "Type") and has("param_type", "p", "Type") and has("param_of", "run", "q") and has("local_of", "run", "local")
    assert has("param_at", "run", "p", 1) and has("param_at", "run", "q", 2) and has("param_at", "help", "only", 0)
    assert has("calls", "run", "help") and not has("calls", "run", "far") and has("calls", "inner", "far")
    assert has("reads", "run", "field") and has("assigns", "local", "q") and has("assigns", "field", "help") and not has("assigns", "local", "p")
    assert has("passes", "help", "local", 1) and has("passes", "help", "local", 0)
    assert trees.tree_facts("no xml") == set() and trees.tree_facts("<unit/>") == set()


@pytest.fixture
def units(spark):
    kinds = {"Outer": "ClassName", "Nested": "ClassName", "Base": "ClassName", "Type": "ClassName", "run": "MethodName", "help": "MethodName", "inner": "MethodName", "field": "FieldName", "local": "VariableName", "p": "ParameterName", "q": "ParameterName", "only": "ParameterName"}
    rows = [("u", n, k, n, "One.xml" if n not in ("Base", "Type") else "Two.xml") for n, k in kinds.items()] + [("w", "Outer", "ClassName", "Outer", "Two.xml"), ("w", "run", "MethodName", "run", "One.xml")]
    return spark.createDataFrame(rows, "unit string, id string, id_type string, name string, path string")


def test_related(spark, units):
    found = trees.facts(spark.createDataFrame([("One.xml", ONE), ("Two.xml", "<unit/>"), ("Bad.xml", "<"), ("None.xml", None)], "path string, xml string"))
    got = {(r.unit, r.kind, r.a, r.b) for r in trees.related(units, found).collect()}
    want = {
        ("BelongsC", "Nested", "Outer"), ("BelongsM", "Outer", "run"), ("BelongsM", "Outer", "help"), ("BelongsF", "Outer", "field"), ("BelongsA", "p", "run"), ("BelongsA", "q", "run"), ("BelongsA", "help", "only"), ("BelongsL", "local", "run"),
        ("CoOccursM", "help", "run"), ("Extends", "Base", "Outer"), ("TypeM", "Type", "run"), ("TypeV", "Type", "field"), ("TypeV", "Type", "p"), ("Invokes", "help", "run"), ("Accesses", "field", "run"), ("Assigns", "local", "q"), ("Assigns", "field", "help"), ("Assigns", "field", "local"), ("Passes", "local", "only"),
    }
    assert got == {("u", k, *sorted((a, b))) for k, a, b in want}


@pytest.mark.parametrize("shared_ids", [False, True])
def test_related_counts(spark, shared_ids):
    """Numbers of pairs and units are those of the list of pairs, with relations across files, ids of several files, and cases that several units hold or none."""
    two = ONE.replace("Outer", "Base").replace("<name>run</name>", "<name>go</name>").replace("<name>far</name>", "<name>run</name>")
    found = trees.facts(spark.createDataFrame([("One.xml", ONE), ("Two.xml", two), ("Three.xml", ONE)], "path string, xml string"))
    kinds = {"Outer": "ClassName", "Base": "ClassName", "Type": "ClassName", "run": "MethodName", "go": "MethodName", "help": "MethodName", "inner": "MethodName", "field": "FieldName", "local": "VariableName", "q": "ParameterName", "only": "ParameterName"}
    deal, cases, held = random.Random(7), [], []
    for path in ("One.xml", "Two.xml", "Three.xml", None):
        for n in range(6):
            cases += [(f"{path} {n}", x if shared_ids else f"{path}/{x}", kinds[x], x, path) for x in deal.sample(sorted(kinds), 6)]
        held += [(u if u else None, f"{path} {deal.randrange(5)}") for u in range(20) if u % 3 or path == "One.xml"]
    cases, held = spark.createDataFrame(cases, "case string, id string, id_type string, name string, path string"), spark.createDataFrame(held, "unit long, case string")
    want = trees.related(held.join(cases, "case").drop("case"), found)
    counted = {(r.kind, r.n, r.units) for r in want.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("unit").alias("units")).collect()}
    assert {(r.kind, r.n, r.units) for r in trees.related_counts(held, cases, found).select("kind", "n", "units").collect()} == counted and len(counted) > 8


def test_related_counts_within_files(spark):
    """No relation goes across files, and none is lost or found twice."""
    found = trees.facts(spark.createDataFrame([("One.xml", ONE)], "path string, xml string"))
    names = {"Outer": "ClassName", "run": "MethodName", "help": "MethodName"}
    cases = spark.createDataFrame([(k, n, t, n, "One.xml") for k, some in ((1, ["Outer", "run"]), (2, ["Outer", "run", "help"]), (3, ["help"])) for n, t in names.items() if n in some], "case int, id string, id_type string, name string, path string")
    held = spark.createDataFrame([("u", 1), ("v", 1), ("w", 2), ("x", 3)], "unit string, case int")
    assert {tuple(r) for r in trees.related_counts(held, cases, found).collect()} == {("BelongsM", 4, 3), ("CoOccursM", 1, 1), ("Invokes", 1, 1)}


def test_query_moves_no_pairs(spark, sf):
    """What tree_relations shuffles goes by line items and not by their renames, pairs and names: some 600 bytes a line when it did."""
    from namewright.plans.catalog import QUERIES

    def written():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        some = spark._jsc.sc().statusStore().executorList(True)
        return sum(some.apply(i).totalShuffleWrite() for i in range(some.size()))

    before = written()
    assert QUERIES["tree_relations"](spark, sf).count() == 14
    assert written() - before < 150 * spark.read.parquet(f"{sf}/lineitem.parquet").count()
