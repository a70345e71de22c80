"""Readers of every input, with explicit schemas. Java parsing, git and srcML stay outside: their results are read as tables or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright import schema
from namewright.schema import RELATIONS, RENAME_KINDS


def java_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all .java files below root."""
    return spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def source_roots(files: DataFrame) -> DataFrame:
    """Distinct folders that packages start from: a file's folder without its package's folders."""
    package = F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    tail = F.concat(F.lit("/"), F.replace(package, F.lit("."), F.lit("/")))
    return files.select(F.when((package != "") & folder.endswith(tail), F.length(folder) - F.length(tail)).alias("_n"), folder.alias("_f")).select(F.coalesce(F.expr("substr(_f, 1, _n)"), "_f").alias("root")).distinct()


def listed(c: Column) -> Column:
    """A list cell, either ;-separated or a printed list with quotes, as an array; empty for a missing cell."""
    printed = F.from_json(F.translate(c, "'", '"'), "array<string>")
    return F.when(c.isNull() | (c == "") | (c == "nan"), F.array().cast("array<string>")).when(c.startswith("["), printed).otherwise(F.split(c, ";"))


def identifier_csv(spark: SparkSession, path: str, snapshot: str = "") -> DataFrame:
    """Identifier table from CSV (gzip or not): undeclared (line -1) and nameless rows are dropped."""
    d = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in ["id", "files", "line", "name", "typeOfIdentifier", *RELATIONS]), enforceSchema=True)
    return d.filter(F.col("name").isNotNull() & (F.col("name") != "") & (F.col("line") != "-1")).select(F.lit(snapshot).alias("snapshot"), "id", F.col("files").alias("file"), F.col("line").cast("int").alias("line"), "name", F.col("typeOfIdentifier").alias("id_type"), *RELATIONS)


def expanded_csv(spark: SparkSession, path: str, snapshot: str = "") -> DataFrame:
    """Expanded table: list cells as arrays."""
    lists = ["split", "delimiter", "case", "pattern", "heuristic", "expanded", "postag", "normalized"]
    d = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in ["id", "files", "line", "name", "typeOfIdentifier", *RELATIONS, *lists]), enforceSchema=True)
    return d.filter("name is not null and line <> '-1'").select(F.lit(snapshot).alias("snapshot"), "id", F.col("files").alias("file"), F.col("line").cast("int").alias("line"), "name", F.col("typeOfIdentifier").alias("id_type"), *RELATIONS, *[listed(F.col(c)).alias(c) for c in lists])


def relation_edges(table: DataFrame) -> DataFrame:
    """(snapshot, src, rel, dst, dst_name) from relation cells 'id:name - id:name - '."""
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rel"), F.col(r).alias("cell")) for r in RELATIONS]))
    one = table.select("snapshot", F.col("id").alias("src"), cells.alias("c")).filter("c.cell is not null")
    item = one.select("snapshot", "src", F.col("c.rel").alias("rel"), F.explode(F.split("c.cell", " - ")).alias("i")).filter("trim(i) <> ''")
    return item.select("snapshot", "src", "rel", F.split_part("i", F.lit(":"), F.lit(1)).alias("dst"), F.get(F.split("i", ":"), F.lit(1)).alias("dst_name")).distinct()


def cell_ends(table: DataFrame) -> Column:
    """The ids that a row's relation cells name, as one array, each different item of a cell once; worked out in the row, so that long cells are neither dealt out nor moved."""
    items = lambda r: F.filter(F.array_distinct(F.split(r, " - ")), lambda i: F.trim(i) != "")
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(table[r].isNull(), none).otherwise(F.transform(items(table[r]), lambda i: F.substring_index(i, ":", 1))) for r in RELATIONS])


def kind_of(rename_kind: Column) -> Column:
    """Identifier kind of a rename kind; null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in RENAME_KINDS.items() for x in kv]), rename_kind)


def polish(gold: DataFrame) -> DataFrame:
    """Gold records as renames: line of the left side, old file, last word of the names, identifier kind."""
    last = lambda c: F.element_at(F.split(c, " "), -1)
    left = F.get("leftSideLocations", F.lit(0))
    return gold.select("commit", left["startLine"].alias("line"), F.col("location.old").alias("file"), last("oldname").alias("old_name"), last("newname").alias("new_name"), kind_of(F.col("renameType")).alias("id_type"))


def gold_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """lines: a record a line, and not one array a file."""
    return polish(spark.read.json(path, schema=schema.GOLD, multiLine=not lines))


def element_name(code: Column) -> Column:
    """The name in a code element: without ' : type'; the last word before '(' or after the last dot or bracket."""
    return F.regexp_extract(F.get(F.split(code, " : "), F.lit(0)), r"(?<=\s)[^\s]+(?=\()|[^\s.)]+$", 0)


def flatten_miner(commits: DataFrame) -> DataFrame:
    """Renames of miner records (sha1, refactorings): others and empty commits are dropped before the explode."""
    kept = commits.withColumn("r", F.filter("refactorings", lambda x: x["type"].contains("Rename"))).filter(F.size("r") > 0)
    one = kept.select(F.col("sha1").alias("commit"), F.size("r").alias("n"), F.explode("r").alias("x"))
    left, right = F.get("x.leftSideLocations", F.lit(0)), F.get("x.rightSideLocations", F.lit(0))
    return one.select("commit", "n", "x.type", "x.description", left["filePath"].alias("file"), left["startLine"].alias("line"), F.element_at(F.split(left["codeElement"], " "), -1).alias("old_name"), F.element_at(F.split(right["codeElement"], " "), -1).alias("new_name"))


def miner_v2(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.json(path, schema=schema.MINER_V2, multiLine=True)
    return flatten_miner(d.select(F.explode("commits").alias("c")).select("c.sha1", "c.refactorings"))


def miner_v1(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines: renames by commit, with the parameters whose keys name the original and the renamed element."""
    d = spark.read.json(path, schema=schema.MINER_V1).filter(F.col("name").contains("Rename"))
    part = lambda k: F.get(F.map_values(F.map_filter("parameters", lambda n, _: n.contains(k))), F.lit(0))
    one = d.select(F.col("commitId").alias("commit"), "name", element_name(part("original")).alias("old_name"), element_name(part("renamed")).alias("new_name"))
    return one.groupBy("commit").agg(F.collect_list(F.struct("name", "old_name", "new_name")).alias("renames"), F.count("*").alias("n"))


def recommendations_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Recommendations from {commit: {trigger: [row, ...]}}; lines: such a text a line, and not one a file."""
    row = "struct<id:string,files:string,line:int,typeOfIdentifier:string,name:string,join:string,rank:int>"
    text = spark.read.format("text").option("wholetext", not lines).load(path)
    m = text.select(F.explode(F.from_json("value", f"map<string,map<string,array<{row}>>>")).alias("commit", "t")).select("commit", F.explode("t").alias("idx", "rows"))
    return m.select("commit", "idx", F.explode("rows").alias("r")).select("commit", "idx", "r.id", F.col("r.files").alias("file"), "r.line", F.col("r.typeOfIdentifier").alias("id_type"), "r.name", F.col("r.join").alias("new_name"), "r.rank")


def operations_json(spark: SparkSession, path: str) -> DataFrame:
    """(mode, commit, key, ops) from lines {mode: {commit: {trigger: [operation, ...]}}}."""
    op = "struct<op:string,kind:string,old_words:array<string>,new_words:array<string>>"
    m = spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,map<string,map<string,array<{op}>>>>")).alias("mode", "c"))
    return m.select("mode", F.explode("c").alias("commit", "k")).select("mode", "commit", F.explode("k").alias("key", "ops"))


def snapshot_paths(root: str, commit: Column, file: Column) -> tuple[Column, Column]:
    """What names a file in the version before a commit, and the folder of that version's tables."""
    return F.concat(commit, F.lit("^:"), file), F.concat(F.lit(root.rstrip("/") + "/archives/"), commit)


def kept_commits(renames: DataFrame, keep: Column) -> DataFrame:
    """The renames of commits of which one rename at least is to be kept."""
    return renames.join(renames.filter(keep).select("commit").distinct(), "commit", "left_semi")


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, author, ts, seq) from a git log's text; seq counts from the oldest."""
    text = spark.read.format("text").option("wholetext", True).load(path)
    entry = r"(?m)^commit ([0-9a-f]+)[^\n]*\n(?:Merge:[^\n]*\n)?Author:\s*([^\n]*)\nDate:\s*([^\n]*)"
    part = lambda k: F.regexp_extract_all("value", F.lit(entry), F.lit(k))
    d = text.select(F.arrays_zip(part(1).alias("commit"), part(2).alias("author"), part(3).alias("date")).alias("e"))
    d = d.select(F.size("e").alias("n"), F.posexplode("e").alias("pos", "e"))
    # the weekday is dropped, as there is no pattern letter for parsing it
    return d.select("e.commit", "e.author", F.to_timestamp(F.expr("substr(trim(e.date), 5)"), "MMM d HH:mm:ss yyyy Z").alias("ts"), (F.col("n") - 1 - F.col("pos")).cast("long").alias("seq"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def abbreviation_list(spark: SparkSession, path: str) -> DataFrame:
    """(abbr, expansion) from lines abbr:=expansion, as all expansions of each."""
    p = F.split("value", ":=")
    return spark.read.text(path).filter(F.col("value").contains(":=")).select(F.lower(F.trim(F.get(p, F.lit(0)))).alias("abbr"), F.lower(F.trim(F.get(p, F.lit(1)))).alias("expansion")).distinct()


def expansion_sets(abbreviations: DataFrame) -> DataFrame:
    return abbreviations.groupBy("abbr").agg(F.array_sort(F.collect_set("expansion")).alias("expansions"))


def split_by_length(abbreviations: DataFrame, words: int = 3) -> tuple[DataFrame, DataFrame]:
    """(shorter expansions, those of words words or more, which are to be skipped)."""
    n = F.size(F.split("expansion", " "))
    return abbreviations.filter(n < words), abbreviations.filter(n >= words)


def records(spark: SparkSession, path: str) -> DataFrame:
    """abbr -> expansions from {"H2": {expansion: abbr}, "H3": {…}}."""
    text = spark.read.format("text").option("wholetext", True).load(path)
    d = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("heuristic", "m")).select("heuristic", F.explode("m").alias("expansion", "abbr"))
    return d.groupBy("abbr").agg(F.array_sort(F.collect_list("expansion")).alias("expansions"))


def project_records(abbreviations: DataFrame) -> DataFrame:
    """(abbr, expansion) from abbr -> expansions: the last expansion by letters."""
    return abbreviations.select("abbr", F.array_max("expansions").alias("expansion"))


def class_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, abbr, expansion): the most frequent one, from {file: {"abbr==expansion": n}}; lines: such a text a line, and not one a file."""
    text = spark.read.format("text").option("wholetext", not lines).load(path)
    d = text.select(F.explode(F.from_json("value", "map<string,map<string,bigint>>")).alias("file", "m")).select("file", F.explode("m").alias("k", "n"))
    d = d.select("file", F.split_part("k", F.lit("=="), F.lit(1)).alias("abbr"), F.split_part("k", F.lit("=="), F.lit(2)).alias("expansion"), "n")
    return d.groupBy("file", "abbr").agg(F.max_by("expansion", F.struct("n", "expansion")).alias("expansion"))


def counts_by_repository(spark: SparkSession, glob: str, columns: str) -> DataFrame:
    """CSV tables of many repositories, with the repository taken from the folder name."""
    d = spark.read.csv(glob, header=True, schema=columns)
    return d.withColumn("repo", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))


def truth_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, abbr, expansion, split) from 'identifier, (abbr:expansion - abbr:expansion), split' lines."""
    d = spark.read.csv(path, header=True, schema="identifier string, pairs string, split string", ignoreLeadingWhiteSpace=True)
    p = d.select("identifier", "split", F.explode(F.split(F.translate("pairs", "()", ""), r"\s*-\s*")).alias("p"))
    return p.select("identifier", F.trim(F.split_part("p", F.lit(":"), F.lit(1))).alias("abbr"), F.trim(F.split_part("p", F.lit(":"), F.lit(2))).alias("expansion"), "split").filter("abbr <> ''")


def xml_texts(spark: SparkSession, glob: str, lines: bool = False) -> DataFrame:
    """(path, xml) without namespaces, for xpath functions; lines: such a text a line, its path in the root's filename, and not one a file."""
    d = spark.read.format("text").option("wholetext", not lines).load(glob)
    path = F.regexp_extract("value", r'^[^>]*\sfilename="([^"]*)"', 1) if lines else F.col("_metadata.file_path")
    return d.select(path.alias("path"), F.regexp_replace(F.regexp_replace("value", r'\sxmlns(:\w+)?="[^"]*"', ""), r"(</?)\w+:", "$1").alias("xml"))
