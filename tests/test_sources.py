"""Readers and writers round trips on small files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from namewright.sources import readers, writers
from namewright.streaming.windows import operation_windows


def test_csv_tables(spark, tmp_path):
    head = ["id", "files", "line", "name", "typeOfIdentifier", *readers.RELATIONS]
    cells = {"id": "i1", "files": "A.java", "line": "3", "name": "fooBar", "typeOfIdentifier": "MethodName", "siblings": "i2:baz - i3:qux - "}
    lines = [",".join(head), ",".join(cells.get(h, "") for h in head), ",".join((cells | {"id": "i9", "line": "-1"}).get(h, "") for h in head)]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    t = readers.identifier_csv(spark, str(tmp_path / "t.csv"), "s")
    assert [(r.id, r.line) for r in t.collect()] == [("i1", 3)]
    assert sorted((r.rel, r.dst, r.dst_name) for r in readers.relation_edges(t).collect()) == [("siblings", "i2", "baz"), ("siblings", "i3", "qux")]
    names = spark.createDataFrame([("i2", "baz"), ("i3", "qux")], "id string, name string")
    assert writers.packed_relations(readers.relation_edges(t), names).first().cell == "i2:baz - i3:qux - "
    wide = [*head, "split", "delimiter", "case", "pattern", "heuristic", "expanded", "postag", "normalized"]
    more = cells | {"split": "\"['foo', 'bar']\"", "pattern": "TCAMEL;SNAKE"}
    (tmp_path / "e.csv").write_text(",".join(wide) + "\n" + ",".join(more.get(h, "") for h in wide) + "\n")
    r = readers.expanded_csv(spark, str(tmp_path / "e.csv")).first()
    assert r.split == ["foo", "bar"] and r.pattern == ["TCAMEL", "SNAKE"] and r.postag == []


def test_miner_and_gold(spark, tmp_path):
    loc = lambda code: [{"filePath": "A.java", "startLine": 5, "codeElement": code}]
    data = {"commits": [{"sha1": "c1", "refactorings": [{"type": "Rename Method", "description": "d", "leftSideLocations": loc("public foo"), "rightSideLocations": loc("public bar")}, {"type": "Move Class", "description": "", "leftSideLocations": [], "rightSideLocations": []}]}, {"sha1": "c2", "refactorings": []}]}
    (tmp_path / "m.json").write_text(json.dumps(data))
    assert [(r.commit, r.n, r.old_name, r.new_name, r.line) for r in readers.miner_v2(spark, str(tmp_path / "m.json")).collect()] == [("c1", 1, "foo", "bar", 5)]
    (tmp_path / "v1.json").write_text(json.dumps({"name": "Rename Variable", "commitId": "c", "parameters": {"originalVariable": "x : int", "renamedVariable": "y : int"}}) + "\n" + json.dumps({"name": "Extract", "commitId": "c", "parameters": {}}))
    r = readers.miner_v1(spark, str(tmp_path / "v1.json")).first()
    assert r.n == 1 and r.renames[0].old_name == "x"
    gold = [{"commit": "c", "oldname": "int foo", "newname": "int bar", "renameType": "Attribute", "location": {"old": "A.java", "new": "A.java"}, "leftSideLocations": loc("foo"), "rightSideLocations": loc("bar")}]
    (tmp_path / "g.json").write_text(json.dumps(gold))
    assert tuple(readers.gold_json(spark, str(tmp_path / "g.json")).first()) == ("c", 5, "A.java", "foo", "bar", "FieldName")
    d = spark.createDataFrame([("public getX(a int) : int",), ("Outer.inner",)], "c string")
    assert [r[0] for r in d.select(readers.element_name(F.col("c"))).collect()] == ["getX", "inner"]


def test_git_log(spark, tmp_path):
    (tmp_path / "log").write_text("commit aaa\nAuthor: X <x@y>\nDate:   Tue Mar 3 10:11:12 2020 +0900\n\n    m\n\ncommit bbb\nMerge: 1 2\nAuthor: Y\nDate:   Mon Mar 12 00:00:00 2018 -0100\n\n    n\n")
    got = [(r.commit, r.ts, r.seq) for r in readers.git_log(spark, str(tmp_path / "log")).orderBy("seq").collect()]
    assert got == [("bbb", dt.datetime(2018, 3, 12, 1), 0), ("aaa", dt.datetime(2020, 3, 3, 1, 11, 12), 1)]


def test_dictionaries_and_records(spark, tmp_path):
    (tmp_path / "w").write_text("Alpha\nbeta\n\nbeta\n")
    assert sorted(r.word for r in readers.word_list(spark, str(tmp_path / "w")).collect()) == ["alpha", "beta"]
    (tmp_path / "a").write_text("db:=database\ndb:=data base\nio:=input output unit\n")
    a = readers.abbreviation_list(spark, str(tmp_path / "a"))
    assert readers.expansion_sets(a).filter("abbr = 'db'").first().expansions == ["data base", "database"]
    short, long_ = readers.split_by_length(a)
    assert short.count() == 2 and long_.first().abbr == "io"
    (tmp_path / "r").write_text(json.dumps({"H2": {"context": "con"}, "H3": {"count": "con"}}))
    assert readers.records(spark, str(tmp_path / "r")).first().expansions == ["context", "count"]
    (tmp_path / "c").write_text(json.dumps({"A.java": {"c==class": 2, "c==count": 1}}))
    assert tuple(readers.class_records(spark, str(tmp_path / "c")).first()) == ("A.java", "c", "class")
    rec = spark.createDataFrame([("H2", "context", "con")], "heuristic string, expansion string, abbr string")
    assert json.loads(writers.record_json(rec).first().value) == {"H2": {"context": "con"}}
    (tmp_path / "t").write_text("Original identifier, pairs, split\nctxMgr,(ctx:context-mgr:manager),ctx Mgr\n")
    assert sorted((r.abbr, r.expansion) for r in readers.truth_pairs(spark, str(tmp_path / "t")).collect()) == [("ctx", "context"), ("mgr", "manager")]
    (tmp_path / "rec").write_text(json.dumps({"c1": {"0": [{"id": "i", "files": "f", "line": 1, "typeOfIdentifier": "MethodName", "name": "a", "join": "b", "rank": 2}]}}))
    assert [(r.commit, r.idx, r.new_name, r["rank"]) for r in readers.recommendations_json(spark, str(tmp_path / "rec")).collect()] == [("c1", "0", "b", 2)]


def test_java_files_and_xml(spark, tmp_path):
    (tmp_path / "src/a/b").mkdir(parents=True)
    (tmp_path / "src/a/b/C.java").write_text("package a.b;\nclass C {}\n")
    (tmp_path / "src/a/b/notes.txt").write_text("x")
    f = readers.java_files(spark, str(tmp_path))
    assert f.count() == 1 and readers.source_roots(f).first().root.endswith("/src")
    (tmp_path / "x.xml").write_text('<u:unit xmlns:u="urn:x"><u:class><u:name>C</u:name></u:class></u:unit>')
    assert readers.xml_texts(spark, str(tmp_path / "x.xml")).selectExpr("xpath_string(xml, 'unit/class/name')").first()[0] == "C"


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("s", ["a", "b"], {"k": "v"})], "snapshot string, w array<string>, m map<string,string>")
    writers.parquet(d, str(tmp_path / "p"), ["snapshot"])
    assert spark.read.parquet(str(tmp_path / "p")).first().w == ["a", "b"]
    writers.csv(d, str(tmp_path / "c"), "gzip")
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().w == "a;b"
    writers.json(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().snapshot == "s"
    assert writers.check_sheet(d, ["snapshot"], ["ok"]).columns == ["snapshot", "ok"]


def test_stream(spark, tmp_path):
    d = spark.createDataFrame([(dt.datetime(2020, 1, 1), "x"), (dt.datetime(2020, 1, 2), "x")], "ts timestamp, op_key string")
    d.write.parquet(str(tmp_path / "in"))
    q = operation_windows(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("ops").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select max(n) from ops").first()[0] == 2


def test_sibling_cells_without_pairs(spark):
    """Cells by place are those of all pairs of siblings, beside other relations; no two rows of a place are joined."""
    i = spark.createDataFrame([(1, "f,x", 3, "a,b", "M"), (2, "f,x", 3, "", "M"), (11, "f,x", 3, None, "C"), (5, "f,x", 3, "e", "C"), (6, "f,x", 4, "g", "C"), (7, None, 3, "h", "C"), (8, None, 3, "j", "C")], "id long, file string, line int, name string, id_type string")
    a, b = i.alias("a"), i.alias("b")
    pairs = a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.id") != F.col("b.id"))).select(F.col("a.id").alias("src"), F.lit("siblings").alias("rel"), F.col("b.id").alias("dst"))
    types = spark.createDataFrame([(1, "type", 6), (6, "type", 1)], "src long, rel string, dst long")
    rank = lambda d: sorted(map(repr, d.collect()))
    assert rank(writers.identifier_table(i, types, ["file", "line"])) == rank(writers.identifier_table(i, pairs.unionByName(types)))
    assert rank(writers.identifier_table(i, together=["file", "line"])) == rank(writers.identifier_table(i, pairs))
    assert "Join" not in writers.identifier_table(i, together=["file", "line"])._jdf.queryExecution().optimizedPlan().toString()


def test_cell_ends(spark, tmp_path):
    """The same ends as relation_edges() gives, worked out within the row."""
    i = spark.createDataFrame([("i1", "f", 3, "a", "M"), ("i2", "f", 3, "b", "M"), ("i3", "f", 3, "c", "C"), ("i4", "g", 4, "d", "C")], "id string, file string, line int, name string, id_type string")
    types = spark.createDataFrame([("i1", "type", "i4"), ("i1", "type", "i3")], "src string, rel string, dst string")
    writers.csv(writers.identifier_table(i, types, ["file", "line"]), str(tmp_path / "t"), "gzip")
    t = readers.identifier_csv(spark, str(tmp_path / "t"))
    got = {(r.id, tuple(sorted(r.e))) for r in t.select("id", readers.cell_ends(t).alias("e")).collect()}
    assert got == {("i1", ("i2", "i3", "i3", "i4")), ("i2", ("i1", "i3")), ("i3", ("i1", "i2")), ("i4", ())}
    assert sum(len(e) for _, e in got) == readers.relation_edges(t).count()


def test_expanded_table_lists_first(spark):
    i = spark.createDataFrame([(1, "f", 3, "aB", "M"), (2, "f", 3, "c", "M")], "id long, file string, line int, name string, id_type string")
    lists = spark.createDataFrame([(1, ["a", "b"])], "id long, x array<string>").select("id", *[F.col("x").alias(c) for c in writers.LISTS])
    got = {r.id: (r.siblings, r.split, r.normalized) for r in writers.expanded_table(i, lists, together=["file", "line"]).collect()}
    assert got == {"1": ("2:c - ", "a;b", "a;b"), "2": ("1:aB - ", "", "")}


def test_xml_lines(spark, tmp_path):
    unit = '<unit xmlns="http://www.srcML.org/srcML/src" xmlns:cpp="http://x" filename="src/{0}.java"><class>class <name>{0}</name></class></unit>'
    (tmp_path / "all.xml").write_text("\n".join(map(unit.format, "AB")) + "\n<unit><class filename='no'/></unit>\n")
    got = readers.xml_texts(spark, str(tmp_path / "all.xml"), lines=True).selectExpr("path", "xpath_string(xml, 'unit/class/name')").collect()
    assert sorted(map(tuple, got)) == [("", ""), ("src/A.java", "A"), ("src/B.java", "B")]
