"""The identifier tables that the queries run on, derived from the driver's tables.

Parts stand for identifiers (two-word names in four styles), line items for renames, orders for
commits. Each view has its SQL twin, as a list of common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.functions import names

IDS_SQL = """ids AS (
  SELECT p_partkey AS id, p_brand AS file, CAST(p_size AS INTEGER) AS line, p_type AS type_name, p_partkey % 4 AS style, w1, w2,
    CASE p_partkey % 5 WHEN 0 THEN 'ClassName' WHEN 1 THEN 'MethodName' WHEN 2 THEN 'FieldName' WHEN 3 THEN 'ParameterName' ELSE 'VariableName' END AS id_type,
    CASE p_partkey % 4
      WHEN 0 THEN concat(w1, upper(substr(w2, 1, 1)), substr(w2, 2))
      WHEN 1 THEN concat(upper(substr(w1, 1, 1)), substr(w1, 2), upper(substr(w2, 1, 1)), substr(w2, 2))
      WHEN 2 THEN concat(w1, '_', w2) ELSE upper(concat(w1, '_', w2)) END AS name
  FROM (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part) p)"""


def styled_sql(style: str, words: str) -> str:
    """SQL for a name of the words (a list) in the style."""
    cap = "upper(substr(x, 1, 1)) || substr(x, 2)"
    return (
        f"CASE {style} WHEN 0 THEN {words}[1] || array_to_string(list_transform({words}[2:], lambda x: {cap}), '') "
        f"WHEN 1 THEN array_to_string(list_transform({words}, lambda x: {cap}), '') WHEN 2 THEN array_to_string({words}, '_') ELSE upper(array_to_string({words}, '_')) END"
    )


RENAMES_SQL = f"""renames AS (
  SELECT l_orderkey AS "commit", l_linenumber AS idx, id, file, line, id_type, name AS old_name, style, w1, w2, l_quantity, o_orderdate AS ts,
    CASE l_linenumber % 3 WHEN 0 THEN 'replace' WHEN 1 THEN 'insert' ELSE 'delete' END AS op,
    CASE l_linenumber % 3 WHEN 0 THEN 'replace:' || w1 || '>new' WHEN 1 THEN 'insert:base' ELSE 'delete:' || w1 END AS op_key,
    {styled_sql("style", "CASE l_linenumber % 3 WHEN 0 THEN ['new', w2] WHEN 1 THEN [w1, 'base', w2] ELSE [w2] END").replace("CASE l_linenumber % 3 WHEN 0 THEN ['new', w2] WHEN 1 THEN [w1, 'base', w2] ELSE [w2] END[", "(CASE l_linenumber % 3 WHEN 0 THEN ['new', w2] WHEN 1 THEN [w1, 'base', w2] ELSE [w2] END)[")} AS new_name
  FROM lineitem JOIN ids ON l_partkey = id JOIN orders ON l_orderkey = o_orderkey)"""

#: Gold renames are all; recommended are those of quantity above 20 and, with a wrong new name, of odd idx.
GOLD_SQL = """gold AS (SELECT DISTINCT "commit", line, id_type, old_name AS name, file, min(new_name) AS gold_name FROM renames GROUP BY "commit", line, id_type, old_name, file),
found AS (SELECT "commit", line, id_type, old_name AS name, file, min(CASE WHEN idx % 2 = 1 THEN new_name ELSE new_name || 'X' END) AS new_name, min(idx) AS rank FROM
  (SELECT * FROM renames WHERE l_quantity > 20 UNION ALL SELECT "commit" + 1, idx, id, file, line, id_type, old_name, style, w1, w2, l_quantity, ts, op, op_key, new_name FROM renames WHERE l_quantity > 45) r
  GROUP BY "commit", line, id_type, old_name, file)"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file, line, type_name, style, w1, w2, id_type, name."""
    p = load(spark, sf_dir, "part").withColumns({"w1": F.split_part("p_name", F.lit(" "), F.lit(1)), "w2": F.split_part("p_name", F.lit(" "), F.lit(2))})
    style = F.col("p_partkey") % 4
    kind = F.col("p_partkey") % 5
    id_type = F.when(kind == 0, "ClassName").when(kind == 1, "MethodName").when(kind == 2, "FieldName").when(kind == 3, "ParameterName").otherwise("VariableName")
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1000))
    name = F.when(style == 0, F.concat("w1", cap("w2"))).when(style == 1, F.concat(cap("w1"), cap("w2"))).when(style == 2, F.concat("w1", F.lit("_"), "w2")).otherwise(F.upper(F.concat("w1", F.lit("_"), "w2")))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_size").cast("int").alias("line"), F.col("p_type").alias("type_name"), style.alias("style"), "w1", "w2", id_type.alias("id_type"), name.alias("name"))


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, idx, id, file, line, id_type, old_name, style, w1, w2, l_quantity, ts, op, op_key, new_name."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    ids = identifiers(spark, sf_dir).drop("type_name")
    r = li.join(ids, li["l_partkey"] == ids["id"]).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("l_linenumber") % 3
    op = F.when(k == 0, "replace").when(k == 1, "insert").otherwise("delete")
    key = F.when(k == 0, F.concat(F.lit("replace:"), "w1", F.lit(">new"))).when(k == 1, "insert:base").otherwise(F.concat(F.lit("delete:"), "w1"))
    new_words = F.when(k == 0, F.array(F.lit("new"), "w2")).when(k == 1, F.array("w1", F.lit("base"), "w2")).otherwise(F.array("w2"))
    r = r.withColumn("_new", new_words).withColumn("_pattern", F.when(F.col("style") == 0, F.array(F.lit("LCAMEL"))).when(F.col("style") == 1, F.array(F.lit("TCAMEL"))).otherwise(F.array(F.lit("SNAKE"))))
    cases = F.transform("_new", lambda _: F.when(F.col("style") == 3, "UPPER").otherwise("LOWER"))
    delims = F.array_repeat(F.lit(""), F.size("_new") + 1)
    new_name = names.join(names.recase("_new", "_pattern", cases), "_pattern", delims)
    return r.select(F.col("l_orderkey").alias("commit"), F.col("l_linenumber").alias("idx"), "id", "file", "line", "id_type", F.col("name").alias("old_name"), "style", "w1", "w2", "l_quantity", F.col("o_orderdate").alias("ts"), op.alias("op"), key.alias("op_key"), new_name.alias("new_name"))


def gold_and_found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = renames(spark, sf_dir)
    key = ["commit", "line", "id_type", F.col("old_name").alias("name"), "file"]
    gold = r.groupBy(*key).agg(F.min("new_name").alias("gold_name"))
    guess = F.when(F.col("idx") % 2 == 1, F.col("new_name")).otherwise(F.concat("new_name", F.lit("X")))
    more = r.filter("l_quantity > 20").unionByName(r.filter("l_quantity > 45").withColumn("commit", F.col("commit") + 1))
    return gold, more.groupBy(*key).agg(F.min(guess).alias("new_name"), F.min("idx").alias("rank"))
