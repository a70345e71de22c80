"""Relations between renamed identifiers, found in the syntax trees of their files.

Every tree (XML without namespaces) is walked once and gives facts about names; which renames of a unit
are related is then a matter of equi-joins on file and name, so no pair of renames is formed without a
fact, and no tree is searched once for each pair. Where only numbers are wanted, pairs are worked out once
for each different set of renames that a file has in a unit.
"""

from __future__ import annotations

import functools
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.sources.shared import stored

FACTS = "path string, fact string, a string, b string, pos int"
_VARS, _CLS, _MET, _PAR = ("FieldName", "VariableName"), "ClassName", "MethodName", "ParameterName"
#: Relation kinds: the fact that shows one, the kinds of its two names, and whether both must be of one file. The fact is always looked for in the first name's file.
BY_FACT = [
    ("BelongsC", "class_in", _CLS, _CLS, True), ("BelongsM", "method_of", _CLS, _MET, True), ("BelongsF", "field_of", _CLS, "FieldName", True), ("BelongsA", "param_of", _MET, _PAR, True), ("BelongsL", "local_of", _MET, "VariableName", True),
    ("Extends", "extends", _CLS, _CLS, False), ("Implements", "implements", _CLS, _CLS, False), ("TypeM", "returns", _MET, _CLS, False), *[("TypeV", "declared", v, _CLS, False) for v in _VARS], ("TypeV", "param_type", _PAR, _CLS, False),
    ("Invokes", "calls", _MET, _MET, False), ("Accesses", "reads", _MET, "FieldName", True), *[("Assigns", "assigns", v, w, w in (_PAR, "VariableName")) for v in _VARS for w in (*_VARS, _PAR, _MET)],
]
#: All kinds of relations, by letters.
KINDS = sorted({x[0] for x in BY_FACT} | {"CoOccursM", "Passes"})


def _names(node: ET.Element) -> list[str]:
    """Text of all name elements at or below node, in order."""
    return [x.text.strip() for x in node.iter("name") if x.text and x.text.strip()]


def _own(node: ET.Element) -> list[str]:
    return [x.text.strip() for x in node.findall("name") if x.text and x.text.strip()]


def tree_facts(xml: str) -> set[tuple[str, str, str, int]]:
    """(fact, a, b, pos) of one tree; none for text that is no XML."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return set()
    out: set[tuple[str, str, str, int]] = set()
    add = lambda fact, left, right, pos=0: out.update((fact, a, b, pos) for a in left for b in right)
    up = {child: node for node in root.iter() for child in node}
    numbers = {node: i for i, node in enumerate(root.iter())}

    def above(node: ET.Element):
        while (node := up.get(node)) is not None:
            yield node

    for c in root.iter("class"):
        own = _own(c)
        for outer in above(c):
            if outer.tag == "class":
                add("class_in", _own(outer), own)
        for block in c.findall("block"):
            for f in block.findall("function"):
                add("method_of", own, _own(f))
            for d in block.findall("decl_stmt/decl"):
                add("field_of", own, _own(d))
        for fact in ("extends", "implements"):
            for s in c.findall(f"super_list/{fact}"):
                add(fact, own, _names(s))
    for f in root.iter("function"):
        own = _own(f)
        add("member", own, [str(numbers[up[f]])] if f in up else [])
        for t in f.findall("type"):
            add("returns", own, _names(t))
        for listed in f.findall("parameter_list"):
            for d in listed.iter("decl"):
                add("param_of", own, _own(d))
                add("param_type", _own(d), [x for t in d.findall("type") for x in _own(t)])
            params = listed.findall("parameter")
            for i, p in enumerate(params, 1):
                # a parameter that is alone is met by the last argument of a call, others by the one at their place
                add("param_at", ["".join(own)], [x for d in p.findall("decl") for x in _own(d)], i if len(params) > 1 else 0)
        for block in f.findall("block"):
            for content in block.findall("block_content"):
                for s in content.iter("decl_stmt"):
                    add("local_of", own, [x for d in s.findall("decl") for x in _own(d)])
            for x in block.iter("name"):
                if x.text and x.text.strip() and up[x].tag != "call":
                    add("reads", own, [x.text.strip()])
    for s in root.iter("decl_stmt"):
        for d in s.findall("decl"):
            add("declared", _own(d), [x for t in d.findall("type") for x in _own(t)])
    for d in root.iter("decl"):
        seen: list[str] = []
        for x in d:  # an initial value is given to the names before it
            if x.tag == "name" and x.text and x.text.strip():
                seen.append(x.text.strip())
            elif x.tag == "init":
                add("assigns", seen, [n for e in x.findall("expr") for n in _names(e)])
    for e in root.iter("expr"):
        if e in up and up[e].tag == "condition":
            continue
        parts = list(e)
        for i, x in enumerate(parts):
            if x.tag == "operator" and "=" in (x.text or ""):
                add("assigns", [n for y in parts[:i] for n in _names(y)], [n for y in parts[i + 1 :] for n in _names(y)])
    for c in root.iter("call"):
        called = [n for x in c.findall("name") for n in _names(x)]
        for outer in above(c):
            if outer.tag == "class":  # what a nested class calls is not called by the methods around the class
                break
            if outer.tag == "function":
                add("calls", _own(outer), called[-1:])
        for listed in c.findall("argument_list"):
            args = listed.findall("argument")
            for i, a in enumerate(args, 1):
                given = [n for e in a.findall("expr") for n in _names(e)]
                add("passes", called, given, i)
                if i == len(args):
                    add("passes", called, given, 0)
    return out


def facts(trees: DataFrame) -> DataFrame:
    """(path, fact, a, b, pos) of all trees (path, xml); each tree is walked once."""

    def run(batches):
        for t in batches:
            rows = [(p, *f) for p, x in zip(t[0].to_pylist(), t[1].to_pylist(), strict=True) if x for f in sorted(tree_facts(x))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols[:4]], pa.array(cols[4], pa.int32())], ["path", "fact", "a", "b", "pos"])

    return trees.select("path", "xml").mapInArrow(run, FACTS)


def _by_fact(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(BY_FACT, "kind string, fact string, type_a string, type_b string, same boolean"))


def _passing(units: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parameters with their method f and place pos, arguments with what they are given to) of renames, whose further columns stay."""
    rest = [c for c in units.columns if c not in ("path", "name", "id_type")]
    place = units.filter(F.col("id_type") == _PAR).join(found.filter("fact = 'param_at'").select("path", F.col("a").alias("f"), F.col("b").alias("name"), "pos"), ["path", "name"])
    there = units.filter(F.col("id_type").isin(*_VARS, _MET)).join(_given(found), ["path", "name"])
    return tuple(x.select(*rest, "path", "f", "pos") for x in (place, there))


def _given(found: DataFrame) -> DataFrame:
    return found.filter("fact = 'passes'").select("path", F.col("a").alias("f"), F.col("b").alias("name"), "pos")


def related(units: DataFrame, found: DataFrame) -> DataFrame:
    """(unit, kind, a, b): related pairs of a unit's renames, a < b. units: (unit, id, id_type, name, path), name being the old one; found: facts()."""
    table = _by_fact(units.sparkSession)
    one = units.select("unit", "path", F.col("id").alias("id_a"), F.col("id_type").alias("type_a"), F.col("name").alias("a"))
    two = units.select("unit", F.col("path").alias("path_b"), F.col("id").alias("id_b"), F.col("id_type").alias("type_b"), F.col("name").alias("b"))
    met = one.join(found.select("path", "fact", "a", "b"), ["path", "a"]).join(table, ["fact", "type_a"]).join(two, ["unit", "b", "type_b"])
    met = met.filter((~F.col("same") | (F.col("path") == F.col("path_b"))) & ((F.col("kind") != "Invokes") | (F.col("a") != F.col("b"))))
    met = met.select("unit", "kind", "id_a", "id_b")

    # methods below one node
    member = units.filter(F.col("id_type") == _MET).join(found.filter("fact = 'member'").select("path", F.col("a").alias("name"), F.col("b").alias("node")), ["path", "name"]).select("unit", "path", "node", "id")
    beside = member.withColumnRenamed("id", "id_a").join(member.withColumnRenamed("id", "id_b"), ["unit", "path", "node"])
    met = met.unionByName(beside.select("unit", F.lit("CoOccursM").alias("kind"), "id_a", "id_b"))

    # a parameter and what calls of its method pass at its place: variables in their own file, methods in either's
    place, there = (x.withColumnRenamed("id", i) for x, i in zip(_passing(units.select("unit", "path", "id", "id_type", "name"), found), ("id_a", "id_b"), strict=True))
    methods = units.filter(F.col("id_type") == _MET).select("unit", "name", F.col("id").alias("id_b"))
    here = place.join(_given(found), ["path", "f", "pos"]).select("unit", "id_a", "name").join(methods, ["unit", "name"])
    for pairs in (place.drop("path").join(there.drop("path"), ["unit", "f", "pos"]), here):
        met = met.unionByName(pairs.select("unit", F.lit("Passes").alias("kind"), "id_a", "id_b"))
    return met.filter("id_a <> id_b").select("unit", "kind", F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _across(renames: DataFrame, found: DataFrame) -> DataFrame:
    """(id) of renames (path, id, id_type, name) that may be related to one of another file: what one asks for, another file's has."""
    r, no = renames.withColumn("file", _file()), F.lit(-1).alias("pos")
    end = lambda d, asks, to, name, pos=no: d.select("id", "file", F.lit(asks).alias("asks"), to.alias("to"), F.col(name).alias("name"), pos)
    named = r.withColumnsRenamed({"name": "a", "id_type": "type_a"}).join(found.select("path", "fact", "a", "b"), ["path", "a"]).join(_by_fact(renames.sparkSession).filter("not same"), ["fact", "type_a"])
    place, there = _passing(r, found)
    ends = [
        end(named, True, F.col("type_b"), "b"), end(r, False, F.col("id_type"), "name"),
        end(place, True, F.lit(""), "f", F.col("pos")), end(there, False, F.lit(""), "f", F.col("pos")), end(place.join(_given(found), ["path", "f", "pos"]), True, F.lit(_MET), "name"),
    ]
    every = functools.reduce(DataFrame.union, ends)
    key = ["to", "name", "pos"]
    met = every.groupBy(*key).agg(F.bool_or("asks").alias("some"), F.bool_and("asks").alias("all"), (F.min("file") != F.max("file")).alias("far")).filter("far and some and not all")
    return every.join(met, key, "left_semi").select("id")


def _file():
    """The path, no path being told apart from every other."""
    return F.coalesce(F.concat(F.lit("/"), F.col("path")), F.lit(""))


def related_counts(held: DataFrame, cases: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, n, units): related pairs and units that have any, as related() finds them, without a list of all pairs.

    cases: (case, id, id_type, name, path), the different sets of renames that files have in units; held: (unit, case), each once and a
    file's at most once a unit. Pairs of one case are worked out once for all its units. Renames that may be related across files, and pairs
    with an id of several files (which several cases of a unit may show), are met unit by unit.
    """
    spark, held = held.sparkSession, held.filter("unit is not null")
    renames = cases.select("path", "id", "id_type", "name").distinct()
    loose = renames.groupBy("id").agg((F.min(_file()) != F.max(_file())).alias("loose")).filter("loose")
    inside = related(cases.withColumnRenamed("case", "unit"), found).withColumnRenamed("unit", "case")
    for end in ("a", "b"):
        inside = inside.join(loose.withColumnsRenamed({"id": end, "loose": f"loose_{end}"}), end, "left")
    inside = stored(inside.select("case", "kind", "a", "b", (F.col("loose_a").isNull() & F.col("loose_b").isNull()).alias("firm")), "inside")
    ids = _across(renames, found).union(inside.filter("not firm").select(F.explode(F.array("a", "b")))).distinct()
    far = stored(cases.join(ids, "id", "left_semi"), "far")
    firm = inside.filter("firm")

    kinds = F.broadcast(spark.createDataFrame([(k, 1 << i) for i, k in enumerate(KINDS)], "kind string, bit long"))
    counts = held.groupBy("case").agg(F.count("*").alias("w")).join(firm.groupBy("case", "kind").agg(F.count("*").alias("c")), "case").select("kind", (F.col("w") * F.col("c")).alias("n"))
    bits = held.join(firm.join(kinds, "kind").groupBy("case").agg(F.bit_or("bit").alias("bits")), "case").select("unit", "bits")
    if not far.isEmpty():
        wide = stored(held.join(far, "case").drop("case"), "wide")
        more = stored(related(wide, found).join(firm.select("kind", "a", "b").distinct(), ["kind", "a", "b"], "left_anti").select("unit", "kind"), "more")
        counts = counts.union(more.groupBy("kind").count())
        bits = bits.union(more.join(kinds, "kind").select("unit", "bit"))
    sets = bits.groupBy("unit").agg(F.bit_or("bits").alias("bits")).groupBy("bits").agg(F.count("*").alias("m"))
    units = sets.join(kinds, F.col("bits").bitwiseAND(F.col("bit")) != 0).groupBy("kind").agg(F.sum("m").alias("units"))
    return counts.groupBy("kind").agg(F.sum("n").alias("n")).join(units, "kind")
