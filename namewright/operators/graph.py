"""Relation edges between identifiers, transitive relations and best-first recommendation.

Edges are one long table (src, rel, dst); a relation and its converse are two rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namewright.schema import ALLOWED_RELATIONS, ID_TYPES
from namewright.sources.shared import drop, stored

MOST_SCORE, MOST_FOUND = 11, 50


def edge(df: DataFrame, src: str, rel: str, dst: str) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.lit(rel).alias("rel"), F.col(dst).alias("dst"))


def both_ways(df: DataFrame, a: str, rel_a: str, b: str, rel_b: str) -> DataFrame:
    """a's relation rel_a to b, and b's relation rel_b to a."""
    return edge(df, a, rel_a, b).unionByName(edge(df, b, rel_b, a))


def hierarchy(extends: DataFrame) -> DataFrame:
    """(child, parent) as parents and subclass edges."""
    return both_ways(extends, "child", "parents", "parent", "subclass")


def ancestors(spark: SparkSession, extends: DataFrame) -> DataFrame:
    """Ancestor and subsubclass edges: everything two levels up or more, however many levels there are. No pair comes twice, so cycles end.

    Each round squares the reach: pairs of up to twice as many levels come from one join, so a chain of n
    levels takes log n rounds.
    """
    first: list[str] = []
    direct = stored(extends.select("child", "parent").distinct(), "ancestors", first)
    far = direct.alias("a").join(direct.alias("b"), F.col("a.parent") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.parent").alias("parent")).distinct()
    scratch: list[str] = []
    far, n = stored(far, "ancestors", scratch), -1
    while (now := far.count()) != n:
        n = now
        reach = direct.union(far).distinct()
        more = far.alias("a").join(reach.alias("b"), F.col("a.parent") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.parent").alias("parent"))
        before = scratch[:]
        scratch.clear()
        far = stored(far.union(more).distinct(), "ancestors", scratch)
        drop(spark, before)
    drop(spark, first)
    return both_ways(far, "child", "ancestor", "parent", "subsubclass")


def members(owned: DataFrame, rel: str) -> DataFrame:
    """(cls, member): the class's methods or fields, and each member's enclosing class."""
    return both_ways(owned, "cls", rel, "member", "enclosingClass")


def siblings(owned: DataFrame, cls: tuple[str, ...] = ("cls",), sources: DataFrame | None = None) -> DataFrame:
    """All pairs of different members of one class (the columns cls), both ways; with sources (a table with a column id), pairs from these alone. Each pair comes once: only two members that both are in several classes can meet again, so only their pairs are compared."""
    o = owned.select(*cls, "member").distinct()
    several = o.groupBy("member").agg((F.count("*") > 1).alias("_several"))
    o = o.join(several, "member")
    a, b = (o.select(*cls, F.col("member").alias(x), F.col("_several").alias(f"_{x}")) for x in ("src", "dst"))
    if sources is not None:
        a = a.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    once = a.join(b, list(cls)).filter((F.col("src") != F.col("dst")) & ~(F.col("_src") & F.col("_dst"))).select("src", "dst")
    again = a.filter("_src").join(b.filter("_dst"), list(cls)).filter("src <> dst").select("src", "dst").distinct()
    return once.unionByName(again).select("src", F.lit("siblings").alias("rel"), "dst")


def parameters(params: DataFrame) -> DataFrame:
    """(method, param) both ways."""
    return both_ways(params, "method", "parameter", "param", "enclosingMethod")


def assignments(assigned: DataFrame) -> DataFrame:
    """(left array, right array): every left identifier with every right one, both ways."""
    flat = assigned.select(F.explode("left").alias("l"), "right").select("l", F.explode("right").alias("r"))
    return both_ways(flat, "l", "assignment", "r", "assignment").distinct()


def types(typed: DataFrame) -> DataFrame:
    """(id, type_id) both ways."""
    return both_ways(typed, "id", "type", "type_id", "type")


def invocations(calls: DataFrame, params: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Arguments met with parameters of methods of the same arity.

    calls: (call, method, invoker, args array of id arrays); params: (method, param, pos). Gives argument and
    parameterArgument edges by position, and methodInvocated edges of invokers; ids of classes are left out.
    """
    arity = params.groupBy("method").agg(F.count("*").alias("n_params"))
    met = calls.join(arity, "method").filter(F.size("args") == F.col("n_params"))
    placed = met.select("method", F.posexplode("args").alias("pos", "ids")).select("method", "pos", F.explode("ids").alias("arg"))
    pairs = placed.join(params, ["method", "pos"]).select("arg", "param")
    out = both_ways(pairs, "arg", "parameterArgument", "param", "argument").unionByName(edge(calls.filter("invoker is not null"), "invoker", "methodInvocated", "method"))
    if classes is not None:
        c = classes.select(F.col("id").alias("_c")).distinct()
        out = out.join(c, F.col("src") == F.col("_c"), "left_anti").join(c, F.col("dst") == F.col("_c"), "left_anti")
    return out.distinct()


def attach_comments(comments: DataFrame, code: DataFrame) -> DataFrame:
    """(file, comment, id): code that starts on the comment's first line, else on the line after its last.

    comments: (file, start, stop, comment); code: (file, line, id).
    """
    same = comments.join(code, (comments["file"] == code["file"]) & (comments["start"] == code["line"])).select(comments["file"], "start", "stop", "comment", "id")
    rest = comments.join(same.select("file", "start", "stop").distinct(), ["file", "start", "stop"], "left_anti")
    nxt = rest.join(code, (rest["file"] == code["file"]) & (rest["stop"] + 1 == code["line"])).select(rest["file"], "start", "stop", "comment", "id")
    return same.unionByName(nxt)


def carriers(identifiers: DataFrame, rel: str) -> DataFrame:
    """Identifiers whose kind may be the source of rel."""
    return identifiers.filter(F.col("id_type").isin([t for t, rs in ALLOWED_RELATIONS.items() if rel in rs]))


def allowed(edges: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Edges whose label the source's kind may carry. The label table is a fixed list of some forty rows."""
    spark = edges.sparkSession
    labels = spark.createDataFrame([(t, r) for t, rs in ALLOWED_RELATIONS.items() for r in rs], "id_type string, rel string")
    typed = edges.join(identifiers.select(F.col("id").alias("src"), "id_type"), "src")
    return typed.join(F.broadcast(labels), ["id_type", "rel"], "left_semi").select("src", "rel", "dst")


def one_kind(listed: DataFrame) -> DataFrame:
    """One row for each id: of the kinds it is listed under, the last by precedence."""
    order = F.array_position(F.array(*map(F.lit, ID_TYPES)), F.col("id_type"))
    return listed.groupBy("id").agg(F.max_by("id_type", order).alias("id_type"))


def located(identifiers: DataFrame, declared: DataFrame) -> DataFrame:
    """identifiers with the line of their declaration (id, line), or -1."""
    return identifiers.join(declared.groupBy("id").agg(F.min("line").alias("_line")), "id", "left").withColumn("line", F.coalesce("_line", F.lit(-1))).drop("_line")


def unlisted(edges: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Ids that edges name but the identifier table does not have."""
    return edges.select(F.col("dst").alias("id")).union(edges.select("src")).distinct().join(identifiers.select("id"), "id", "left_anti")


def best_first(triggers: DataFrame, identifiers: DataFrame, edges: DataFrame, recommend, most_score: int = MOST_SCORE, most_found: int = MOST_FOUND) -> DataFrame:
    """Best-first recommendation from all triggers at once.

    triggers: (trigger_id, id, old_name, new_name); identifiers: (id, file, name, ...); edges: (src, dst).
    From a visited identifier of score s each neighbour gets s + 1, and 5 more where the visited one is
    neither the trigger nor recommendable, and 1 more where it is in another file; scores stay below
    most_score. Steps are positive integers, so the levels are done in order with one join each and a
    visited score is final. recommend(old, new, name) gives the new name column or null.
    Returns (trigger_id, id, new_name, rank), the most_found best of each trigger by (rank, id).
    Each level is stored, so lineage stays short; nothing is collected but the next level's number.
    """
    ids = identifiers.select("id", "file", "name")
    levels: list[str] = []
    # edges with what a step costs besides, worked out once
    ends = edges.select("src", "dst").distinct().join(ids.select(F.col("id").alias("src"), F.col("file").alias("_a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("file").alias("_b")), "dst")
    steps = stored(ends.select(F.col("src").alias("id"), F.col("dst").alias("to"), (~F.col("_a").eqNullSafe(F.col("_b"))).cast("int").alias("away")), "search-steps", levels)
    names = triggers.select("trigger_id", F.col("id").alias("own"), "old_name", "new_name")
    # pending holds a row for each (trigger, identifier) met so far: score falls until it is visited, and visited rows stay to shut out later ones
    pending = triggers.join(ids, "id", "left_semi").select("trigger_id", "id", F.lit(0).alias("score"), F.lit(False).alias("visited"))
    found, scratch = None, []
    level = 0
    while level is not None and level < most_score:
        current = pending.filter((F.col("score") == level) & ~F.col("visited")).select("trigger_id", "id").distinct()
        at = current.join(ids.select("id", "name"), "id").join(names, "trigger_id")
        at = at.withColumn("recommended", F.when(F.col("id") != F.col("own"), recommend(F.col("old_name"), F.col("new_name"), F.col("name"))))
        at = stored(at.select("trigger_id", "id", (F.col("id") == F.col("own")).alias("is_trigger"), "recommended"), "search-level", levels)
        hits = at.filter("recommended is not null").select("trigger_id", "id", F.col("recommended").alias("new_name"), F.lit(level).alias("rank"))
        found = hits if found is None else found.unionByName(hits)
        step = at.join(steps, "id")
        score = level + 1 + F.when(F.col("is_trigger") | F.col("recommended").isNotNull(), 0).otherwise(5) + F.col("away")
        step = step.select("trigger_id", F.col("to").alias("id"), score.alias("score")).filter(F.col("score") < most_score)
        met = pending.select("trigger_id", "id", "score", (F.col("visited") | (F.col("score") == level)).alias("visited")).unionByName(step.withColumn("visited", F.lit(False)))
        before = scratch[:]
        scratch.clear()
        pending = stored(met.groupBy("trigger_id", "id").agg(F.min("score").alias("score"), F.bool_or("visited").alias("visited")), "search-pending", scratch)
        drop(pending.sparkSession, before)
        level = pending.filter("not visited").agg(F.min("score")).first()[0]  # levels without candidates are passed over
    w = Window.partitionBy("trigger_id").orderBy("rank", "id")
    out = stored(found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most_found).drop("_n"), "search-found")
    drop(out.sparkSession, levels + scratch)
    return out


def scan_all(triggers: DataFrame, identifiers: DataFrame, recommend) -> DataFrame:
    """Mode none: every identifier of the trigger's snapshot is a candidate of rank 0. Both sides have a column snapshot.

    What a rename does to a name is worked out once for each different case; ids meet only the names that it changes.
    """
    ids = identifiers.select("snapshot", F.col("id").alias("to"), "name")
    cases = triggers.select("snapshot", "old_name", "new_name").distinct().join(ids.select("snapshot", "name").distinct(), "snapshot").select("old_name", "new_name", "name").distinct()
    # exploded, as a filter would be pushed below the distinct and work repeated cases out again
    once = stored(cases.select("*", F.explode(F.array_compact(F.array(recommend(F.col("old_name"), F.col("new_name"), F.col("name"))))).alias("recommended")), "scan-cases")
    hits = triggers.select("snapshot", "trigger_id", "id", "old_name", "new_name").join(once, ["old_name", "new_name"])
    met = hits.select("snapshot", "trigger_id", "id", "name", "recommended").join(ids, ["snapshot", "name"]).filter(F.col("to") != F.col("id"))
    return met.select("trigger_id", F.col("to").alias("id"), F.col("recommended").alias("new_name"), F.lit(0).alias("rank"))


#: Kinds of related pairs within a rename unit: the two kinds, the edge that relates them, and whether they share a file.
PAIR_RELATIONS = {
    "BelongsC": ("ClassName", "ClassName", "enclosingClass", True), "BelongsM": ("ClassName", "MethodName", "methods", True), "BelongsF": ("ClassName", "FieldName", "fields", True),
    "BelongsA": ("MethodName", "ParameterName", "parameter", True), "BelongsL": ("VariableName", "MethodName", "enclosingMethod", True), "CoOccursM": ("MethodName", "MethodName", "siblings", True),
    "Extends": ("ClassName", "ClassName", "parents", False), "Implements": ("ClassName", "ClassName", "implements", False), "TypeM": ("MethodName", "ClassName", "type", False),
    "TypeV": ("VariableName", "ClassName", "type", False), "Invokes": ("MethodName", "MethodName", "methodInvocated", False), "Accesses": ("MethodName", "FieldName", "accesses", True),
    "Assigns": ("VariableName", "VariableName", "assignment", False), "Passes": ("VariableName", "ParameterName", "parameterArgument", False),
}


def related_pairs(units: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """(unit, kind, a, b): pairs of a unit's identifiers that an edge relates, by PAIR_RELATIONS; fields count as variables for TypeV, Assigns and Passes.

    units: (unit, id, id_type, file). In units of up to ``most`` identifiers the pairs are formed first and met with
    edges by both ends, so that a popular identifier's edges are no burden; larger units are met with the edges of
    their identifiers, so that no unit's pairs are.
    """
    kinds = []
    for kind, (a, b, rel, same) in PAIR_RELATIONS.items():
        wide = {"VariableName": ["VariableName", "FieldName"]} if kind in ("TypeV", "Assigns", "Passes") else {}
        kinds += [(kind, x, y, rel, same) for x, y in itertools.product(wide.get(a, [a]), wide.get(b, [b]))]
    table = units.sparkSession.createDataFrame(kinds, "kind string, type_a string, type_b string, rel string, same boolean")
    sized = units.join(units.groupBy("unit").agg((F.count("*") > most).alias("_large")), "unit")
    left = sized.select("unit", "_large", F.col("id").alias("src"), F.col("id_type").alias("type_a"), F.col("file").alias("file_a"))
    right = sized.select("unit", F.col("id").alias("dst"), F.col("id_type").alias("type_b"), F.col("file").alias("file_b"))
    small = left.filter("not _large").join(right, "unit").filter("src <> dst").join(F.broadcast(table.select("type_a", "type_b").distinct()), ["type_a", "type_b"], "left_semi").join(edges, ["src", "dst"])
    large = left.filter("_large").join(edges, "src").join(right, ["unit", "dst"])
    met = small.select("unit", "src", "dst", "rel", "type_a", "type_b", "file_a", "file_b").unionByName(large.select("unit", "src", "dst", "rel", "type_a", "type_b", "file_a", "file_b"))
    met = met.join(F.broadcast(table), ["type_a", "type_b", "rel"])
    met = met.filter((F.col("src") != F.col("dst")) & (~F.col("same") | (F.col("file_a") == F.col("file_b"))))
    return met.select("unit", "kind", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
