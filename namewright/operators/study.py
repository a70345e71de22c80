"""Empirical statistics of rename units: sizes, kinds, shares and cumulative distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Operation kinds, in the order of the tables.
KINDS = ["insert", "delete", "replace", "other", "inflect"]


def commit_counts(renames: DataFrame) -> DataFrame:
    return renames.groupBy("commit").agg(F.count("*").alias("n"))


def by_commit(renames: DataFrame) -> DataFrame:
    """Renames collected by commit, with their number."""
    return renames.groupBy("commit").agg(F.collect_list(F.struct(*[c for c in renames.columns if c != "commit"])).alias("renames"), F.count("*").alias("n"))


def units(renames: DataFrame, kinds: list[str]) -> DataFrame:
    """(commit, op_key, op, size, n_<kind>): renames of one commit with one operation; size counts repeats, the kinds' numbers do not."""
    one = F.struct("file", "line", "old_name", "new_name")
    return renames.groupBy("commit", "op_key", "op").agg(F.count("*").alias("size"), *[F.count_distinct(F.when(F.col("id_type") == k, one)).alias(f"n_{k}") for k in kinds])


def size_by_kind(unit: DataFrame) -> DataFrame:
    """Units by size and operation kind (a pivot with known columns)."""
    out = unit.groupBy("size").pivot("op", KINDS).agg(F.count(F.lit(1))).fillna(0)
    return out.orderBy("size")


def renames_by_kind(unit: DataFrame) -> DataFrame:
    return unit.groupBy("op").agg(F.sum("size").alias("renames"))


def co_rename_rate(unit: DataFrame, keys: list[str]) -> DataFrame:
    """1 - renames alone in their unit / all renames."""
    alone = F.sum(F.when(F.col("size") == 1, F.col("size")).otherwise(0))
    return unit.groupBy(*keys).agg((1 - alone / F.sum("size")).alias("rate"), F.sum("size").alias("renames"), alone.alias("alone"))


def size_cdf(unit: DataFrame, most: int | None = None) -> DataFrame:
    """Renames by unit size with running sum and share; most: so many smallest sizes. Sizes are few, so the single ordered window is over a small aggregate."""
    s = unit.groupBy("size").agg(F.sum("size").alias("renames"))
    w = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    out = s.withColumn("running", F.sum("renames").over(w)).withColumn("share", F.col("running") / F.sum("renames").over(Window.partitionBy()))
    return out.orderBy("size").limit(most) if most else out


def unique_cdf(sized: DataFrame, top: int = 6) -> DataFrame:
    """From (size, uniq): units by size and number of unique files (1 .. top - 1, top or more), running over all sizes within each bucket."""
    n = sized.withColumn("bucket", F.least("uniq", F.lit(top))).groupBy("size", "bucket").agg(F.count("*").alias("n"))
    grid = n.select("size").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(1), F.lit(top)))).withColumn("bucket", F.col("bucket").cast(n.schema["bucket"].dataType))
    w = Window.partitionBy("bucket").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(n, ["size", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("running", F.sum("n").over(w))


def shares(counts: DataFrame, within: str, n: str = "n") -> DataFrame:
    """Each count's share of its group's sum, 0 where that is nothing."""
    return counts.withColumn("share", F.coalesce(F.try_divide(F.col(n).cast("double"), F.sum(n).over(Window.partitionBy(within))), F.lit(0.0)))


def describe(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles and maximum."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("_q"), F.max(value).alias("max")).select(
        *keys, "count", "mean", "std", "min", F.get("_q", F.lit(0)).alias("q1"), F.get("_q", F.lit(1)).alias("median"), F.get("_q", F.lit(2)).alias("q3"), "max"
    )


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.median(c).alias(c) for c in columns])


def affected(after: DataFrame, before: DataFrame) -> DataFrame:
    """Units that only the second way of counting (lemmas) has: set difference."""
    return after.select(*before.columns).distinct().exceptAll(before.distinct())


def touched_relations(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs (a, b, …) of which either end is among ids (id): two semi joins, once each."""
    i = ids.select("id").distinct()
    left = pairs.join(i, pairs["a"] == i["id"], "left_semi")
    right = pairs.join(i, pairs["b"] == i["id"], "left_semi")
    return left.union(right).distinct()


def relation_counts(pairs: DataFrame, unit_kinds: DataFrame) -> DataFrame:
    """Distinct related pairs overall (kind NULL) and for every operation kind of their unit. pairs: (unit, kind, a, b); unit_kinds: (unit, op)."""
    met = pairs.select("unit", F.col("kind").alias("relation"), "a", "b").join(unit_kinds, "unit")
    return met.rollup("relation", "op").agg(F.count_distinct("a", "b").alias("n")).filter("relation is not null")


def relation_details(pairs: DataFrame, unit_kinds: DataFrame) -> DataFrame:
    """(kind, relation, a, b): each related pair once for every kind of identifier that its unit holds. pairs: (unit, kind, a, b); unit_kinds: (unit, id_type)."""
    met = pairs.select("unit", F.col("kind").alias("relation"), "a", "b").join(unit_kinds.select("unit", F.col("id_type").alias("kind")).distinct(), "unit")
    return met.select("kind", "relation", "a", "b").distinct()


def counted_details(details: DataFrame) -> DataFrame:
    """Pairs by kind and relation, and by relation over all kinds (kind NULL, a pair once)."""
    each = details.groupBy("kind", "relation").agg(F.count("*").alias("n"))
    whole = details.select("relation", "a", "b").distinct().groupBy("relation").agg(F.count("*").alias("n"))
    return each.unionByName(whole.select(F.lit(None).cast("string").alias("kind"), "relation", "n"))


def affected_details(details: DataFrame, ids: DataFrame) -> DataFrame:
    """The details of which either end is among ids (id); counted_details() counts them."""
    return touched_relations(details.select("a", "b", "kind", "relation"), ids).select("kind", "relation", "a", "b")


def shared_units(unit: DataFrame, keys: list[str]) -> DataFrame:
    """Units of more than one rename, and all renames in them, for each key and for all (keys NULL)."""
    big = F.col("size") > 1
    return unit.rollup(*keys).agg(F.count_if(big).alias("units"), F.sum(F.when(big, F.col("size")).otherwise(0)).alias("renames"))


def project_folds(projects: DataFrame, folds: int = 9) -> DataFrame:
    """(project, fold): projects by name, dealt to the folds in turn. Projects are few, so the single ordered window is over a small table."""
    w = Window.orderBy("project")
    return projects.select("project").distinct().withColumn("fold", ((F.row_number().over(w) - 1) % folds).cast("int"))


def paired_projects(normal: DataFrame, lemmatised: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The counts of two analyses of the same projects side by side, by name and not by place; what one of them lacks is 0."""
    both = normal.select(*keys, F.col(n).alias("normal")).join(lemmatised.select(*keys, F.col(n).alias("lemmatised")), keys, "full")
    return both.na.fill(0, ["normal", "lemmatised"])


def analysed_project(renames: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """All tables of one project's analysis, from its renames (commit, op_key, op, id, id_type, file, line, old_name, new_name, path) and the facts of its trees."""
    from namewright.operators import trees
    from namewright.schema import ID_TYPES

    unit = units(renames, ID_TYPES)
    named = renames.select(F.struct("commit", "op_key").alias("unit"), "id", "id_type", F.col("old_name").alias("name"), "path").distinct()
    pairs = trees.related(named, found)
    details = relation_details(pairs, named)
    return {"units": unit, "sizes": size_by_kind(unit), "renames": renames_by_kind(unit), "rate": co_rename_rate(unit, []), "cdf": size_cdf(unit), "details": details, "relations": counted_details(details)}


def merge_projects(frames: list[DataFrame]) -> DataFrame:
    """All projects' rows, columns by name, missing ones NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
