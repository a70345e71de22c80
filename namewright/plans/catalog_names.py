"""Queries over word lists and abbreviation expansion, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from namewright.functions import names
from namewright.operators import expand
from namewright.plans.identifiers import identifiers, load
from namewright.plans.registry import IDS, query, rounded

_J = "array_to_string({}, ' ')"


@query(IDS + """, l AS (SELECT id, line, [w1, w2, 'x', w1, w2] AS a, [w1, w2] AS p FROM ids) SELECT id, array_to_string(CASE WHEN line % 8 <= 5 THEN a[1:line % 8] ELSE list_concat(a, list_transform(range(line % 8 - 5), lambda k: a[5])) END, ' ') AS padded,
    CAST(CASE WHEN line % 3 = 0 THEN 0 WHEN line % 3 = 1 THEN 2 ELSE -1 END AS BIGINT) AS place, array_to_string(list_concat(a[1:1], ['new', 'words'], a[4:5]), ' ') AS replaced,
    CAST(CASE WHEN line % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS letters FROM l""")
def word_lists(spark, sf):
    """Lists cut or padded to a length, sub-lists found, slices replaced, letters told from digits."""
    i = identifiers(spark, sf)
    a = F.array("w1", "w2", F.lit("x"), "w1", "w2")
    part = F.when(F.col("line") % 3 == 0, F.array("w1", "w2")).when(F.col("line") % 3 == 1, F.array(F.lit("x"), "w1")).otherwise(F.array("w2", "w2"))
    d = i.withColumns({"a": a, "p": part, "t": F.when(F.col("line") % 2 == 0, F.col("w1")).otherwise(F.lit("_12$"))})
    return d.select(
        "id", F.array_join(names.padded("a", F.col("line") % 8), " ").alias("padded"), names.find_slice("a", "p").cast("long").alias("place"),
        F.array_join(names.replace_slice("a", F.lit(1), F.lit(3), F.array(F.lit("new"), F.lit("words"))), " ").alias("replaced"), F.size(names.words("t")).cast("long").alias("letters"),
    )


@query(IDS + """SELECT id, CASE WHEN style < 2 THEN '' ELSE '_' END AS separators, w1 || ' ' || w2 AS words, CAST(2 + CASE WHEN style < 2 THEN 0 ELSE 1 END AS BIGINT) AS n_tokens FROM ids""")
def divided_tokens(spark, sf):
    """the tokens of each name divided into words and separators."""
    i = identifiers(spark, sf)
    t = names.tokens("name")
    return i.select("id", F.array_join(F.filter(t, lambda x: x.rlike(r"^[_$\d]+$")), "").alias("separators"), F.array_join(names.words("name"), " ").alias("words"), F.size(t).cast("long").alias("n_tokens"))


@query(IDS + """SELECT id, id % 4 <> 3 AS same, id % 3 <> 2 AS listed FROM ids""")
def word_equality(spark, sf):
    """words equal but for case, spaces and a plural s; an expansion found in a list."""
    i = identifiers(spark, sf)
    other = F.when(F.col("id") % 4 == 0, F.upper("w1")).when(F.col("id") % 4 == 1, F.concat(F.lit(" "), "w1", F.lit("s "))).when(F.col("id") % 4 == 2, F.col("w1")).otherwise(F.concat("w1", F.lit("x")))
    listed = F.when(F.col("id") % 3 == 0, F.concat(F.lit("other;"), "w1", F.lit(" "), "w2")).when(F.col("id") % 3 == 1, F.concat(F.upper("w1"), F.lit("#"), "w2", F.lit("s;y"))).otherwise(F.concat("w1", F.lit(";"), "w2"))
    return i.select("id", names.same_word(F.col("w1"), other).alias("same"), names.same_expansion(listed, F.concat("w1", F.lit("#"), "w2")).alias("listed"))


@query(IDS + """SELECT id, CASE id % 4 WHEN 0 THEN substr(w1, 1, 1) WHEN 1 THEN substr(w1, 1, 3) WHEN 2 THEN w1 ELSE w1 END || ' ' || w2 AS short FROM ids""")
def abbreviated_words(spark, sf):
    """words shortened by the way they were expanded: initials, the record's abbreviations, or not at all."""
    i = identifiers(spark, sf)
    how = F.when(F.col("id") % 4 == 0, "H1").when(F.col("id") % 4 == 1, "H2").when(F.col("id") % 4 == 2, "H3").otherwise("ST")
    record = F.when(F.col("id") % 4 == 1, F.create_map("w1", F.substring("w1", 1, 3))).otherwise(F.create_map(F.lit("other"), F.lit("o")))
    return i.select("id", F.array_join(names.abbreviated(F.array("w1", "w2"), F.array(how, F.lit("ST")), record), " ").alias("short"))


def _dictionary(spark, sf):
    """Every second one of the words that names have, by length."""
    return identifiers(spark, sf).select(F.explode(F.array("w1", "w2")).alias("word")).distinct().filter(F.length("word") % 2 == 0)


_DICT = "dict AS (SELECT DISTINCT word FROM (SELECT w1 AS word FROM ids UNION ALL SELECT w2 FROM ids) WHERE length(word) % 2 = 0), dl AS (SELECT list(word) AS words FROM dict)"


@query(IDS + f""", {_DICT}, each AS (SELECT id, w1 AS word FROM ids UNION ALL SELECT id, substr(w2, 1, 1) FROM ids) SELECT id, word FROM each WHERE length(word) = 1 OR word NOT IN (SELECT word FROM dict)""")
def unknown_words(spark, sf):
    """Words that the dictionary does not have, single letters always."""
    each = identifiers(spark, sf).select("id", F.explode(F.array("w1", F.substring("w2", 1, 1))).alias("word"))
    return expand.unknown_words(each, _dictionary(spark, sf))


#: Each identifier's unknown word and its related names: those of the next two ids.
_CAND = f""", {_DICT}, un AS (SELECT id, CASE id % 4 WHEN 0 THEN substr(w1, 1, 2) WHEN 1 THEN substr(w1, 1, 1) || substr(w1, 3, 1) WHEN 2 THEN substr(w1, 1, 1) || substr(w2, 1, 1) ELSE substr(w1, 1, 2) || 's' END AS word FROM ids),
    rel AS (SELECT u.id, u.word, i.id AS dst, 'next' || (i.id - u.id) AS rel, [i.w1, i.w2] AS terms FROM un u JOIN ids i ON i.id - u.id IN (1, 2)),
    f AS (SELECT *, unnest([word, CASE WHEN length(word) > 1 AND word LIKE '%s' THEN substr(word, 1, length(word) - 1) END]) AS try, unnest([0, 1]) AS round FROM rel),
    k AS (SELECT f.*, list_filter(terms, lambda x: list_contains(dl.words, x)) AS known FROM f, dl WHERE try IS NOT NULL),
    h AS (SELECT *, CASE WHEN length(try) = 2 AND substr(terms[1], 1, 1) || substr(terms[2], 1, 1) = try AND len(known) = 2 THEN terms[1] || '#' || terms[2] END AS h1,
      list_filter(known, lambda x: starts_with(x, try) AND x <> try) AS l2, list_filter(known, lambda x: length(try) >= 2 AND regexp_matches(x, '^' || array_to_string(string_split(try, ''), '.*')) AND x <> try) AS l3 FROM k),
    g AS (SELECT id, word, rel, round, CASE WHEN h1 IS NOT NULL THEN 'H1' WHEN len(l2) > 0 THEN 'H2' WHEN len(l3) > 0 THEN 'H3' END AS heuristic,
      CASE WHEN h1 IS NOT NULL THEN h1 WHEN len(l2) > 0 THEN CASE WHEN len(l2) = 1 OR length(l2[1]) < length(l2[2]) OR (length(l2[1]) = length(l2[2]) AND l2[1] <= l2[2]) THEN l2[1] ELSE l2[2] END
        WHEN len(l3) > 0 THEN CASE WHEN len(l3) = 1 OR length(l3[1]) < length(l3[2]) OR (length(l3[1]) = length(l3[2]) AND l3[1] <= l3[2]) THEN l3[1] ELSE l3[2] END END AS expansion FROM h),
    cand AS (SELECT id, word, rel, heuristic, expansion FROM (SELECT *, row_number() OVER (PARTITION BY id, word, rel ORDER BY round) AS n FROM g WHERE heuristic IS NOT NULL) WHERE n = 1) """


def _unknown(spark, sf):
    i = identifiers(spark, sf)
    k = F.col("id") % 4
    word = F.when(k == 0, F.substring("w1", 1, 2)).when(k == 1, F.concat(F.substring("w1", 1, 1), F.substring("w1", 3, 1))).when(k == 2, F.concat(F.substring("w1", 1, 1), F.substring("w2", 1, 1))).otherwise(F.concat(F.substring("w1", 1, 2), F.lit("s")))
    return i.select("id", word.alias("word"))


def _related(spark, sf):
    i = identifiers(spark, sf)
    step = F.explode(F.array(F.lit(1), F.lit(2)))
    edges = i.select(F.col("id").alias("src"), step.alias("k")).select("src", F.concat(F.lit("next"), F.col("k").cast("string")).alias("rel"), (F.col("src") + F.col("k")).alias("dst"))
    return edges, i.select("id", F.array("w1", "w2").alias("words"))


@query(IDS + _CAND + "SELECT id, word, rel, heuristic, expansion FROM cand")
def dictionary_candidates(spark, sf):
    """Expansions among the words of related names that the dictionary has, with another try without a plural s."""
    edges, listed = _related(spark, sf)
    return expand.candidates(_unknown(spark, sf), edges, listed, _dictionary(spark, sf))


@query(IDS + _CAND + """, v AS (SELECT id, word, expansion, count(*) AS votes, min(heuristic) AS heuristic FROM cand GROUP BY 1, 2, 3), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, word ORDER BY votes DESC, length(expansion), expansion) AS k FROM v) WHERE k = 1),
    ab AS (SELECT abbr, min(expansion) AS expansion FROM (SELECT DISTINCT substr(w2, 1, 2) AS abbr, w2 AS expansion FROM ids) GROUP BY 1)
    SELECT u.id, u.word, coalesce(b.expansion, ab.expansion, u.word) AS expansion, CASE WHEN b.expansion IS NOT NULL THEN b.heuristic WHEN ab.expansion IS NOT NULL THEN 'H3' ELSE 'ST' END AS heuristic FROM un u LEFT JOIN best b ON u.id = b.id AND u.word = b.word LEFT JOIN ab ON u.word = ab.abbr""")
def voted_expansions(spark, sf):
    """The expansion with most votes, or else the list of abbreviations, or else the word itself."""
    edges, listed = _related(spark, sf)
    unknown = _unknown(spark, sf)
    voted = expand.vote(expand.candidates(unknown, edges, listed, _dictionary(spark, sf)), ["id", "word"])
    return expand.expanded(unknown, voted, identifiers(spark, sf).select(F.substring("w2", 1, 2).alias("abbr"), F.col("w2").alias("expansion")).distinct())


@query(IDS + f""", {_DICT}, c AS (SELECT id, CASE id % 3 WHEN 0 THEN substr(w2, 1, 2) WHEN 1 THEN substr(w1, 1, 1) || substr(w1, 3, 1) ELSE substr(w1, 1, 1) || substr(w2, 1, 1) END AS word, list_filter([w1, w2], lambda x: list_contains(dl.words, x)) AS known FROM ids, dl),
    h AS (SELECT *, CASE WHEN len(known) = 2 AND substr(known[1], 1, 1) || substr(known[2], 1, 1) = word THEN known[1] || '#' || known[2] END AS h1, list_filter(known, lambda x: starts_with(x, word)) AS l2, list_filter(known, lambda x: regexp_matches(x, '^' || substr(word, 1, 1) || '.*' || substr(word, 2, 1))) AS l3 FROM c)
    SELECT id, word, CASE WHEN h1 IS NOT NULL THEN 'H1' WHEN len(l2) > 0 THEN 'H2' ELSE 'H3' END AS heuristic, CASE WHEN h1 IS NOT NULL THEN h1
      WHEN len(l2) > 0 THEN CASE WHEN len(l2) = 1 OR (length(l2[1]), l2[1]) <= (length(l2[2]), l2[2]) THEN l2[1] ELSE l2[2] END ELSE CASE WHEN len(l3) = 1 OR (length(l3[1]), l3[1]) <= (length(l3[2]), l3[2]) THEN l3[1] ELSE l3[2] END END AS expansion
    FROM h WHERE h1 IS NOT NULL OR len(l2) > 0 OR len(l3) > 0""")
def comment_expansion(spark, sf):
    """E5: expansions among the dictionary words of comments, acronyms over these words alone."""
    i = identifiers(spark, sf)
    k = F.col("id") % 3
    word = F.when(k == 0, F.substring("w2", 1, 2)).when(k == 1, F.concat(F.substring("w1", 1, 1), F.substring("w1", 3, 1))).otherwise(F.concat(F.substring("w1", 1, 1), F.substring("w2", 1, 1)))
    c = i.select("id", word.alias("word"), F.concat(F.upper("w1"), F.lit(" -- of (12) "), "w2", F.lit(".")).alias("comment"))
    c = expand.known_terms(c.withColumn("terms", expand.comment_words(F.col("comment"))), ["id"], "terms", _dictionary(spark, sf))
    return c.withColumn("c", expand.from_comment(F.col("word"), F.col("comment"), F.col("known"))).filter("c is not null").select("id", "word", "c.heuristic", "c.expansion")


@query(IDS + """, p AS (SELECT id, unnest([w1, w2]) AS word, unnest([0, 1]) AS pos, CASE style WHEN 1 THEN 'TITLE' WHEN 3 THEN 'UPPER' ELSE 'LOWER' END AS name_case, CASE WHEN id % 2 = 0 THEN 'H1' ELSE 'H2' END AS h FROM ids)
    SELECT id, word, CASE WHEN h = 'H1' AND name_case = 'TITLE' THEN CASE WHEN pos = 0 THEN 'UPPER' ELSE 'LOWER' END ELSE name_case END AS word_case FROM p""")
def expansion_parts(spark, sf):
    """An expansion's words with their cases; an acronym in title case is upper, then lower."""
    i = identifiers(spark, sf)
    case = F.when(F.col("style") == 1, "TITLE").when(F.col("style") == 3, "UPPER").otherwise("LOWER")
    parts = expand.parts_of(F.concat_ws("#", "w1", "w2"), F.when(F.col("id") % 2 == 0, "H1").otherwise("H2"), case)
    return i.select("id", F.explode(parts).alias("p")).select("id", "p.word", F.col("p.case").alias("word_case"))


@query(IDS + """, t AS (SELECT id, file, w1, w2, unnest([w1, substr(w2, 1, 2), substr(w1, 1, 1) || substr(w2, 1, 1), 'cr' || id % 2, 'pr', 'ab', 'sk', 'zz']) AS word FROM ids)
    SELECT id, word, CASE WHEN word = w1 THEN 'ST' WHEN word = substr(w1, 1, 1) || substr(w2, 1, 1) THEN 'H1' WHEN word = substr(w2, 1, 2) THEN 'H2'
      WHEN word IN ('cr0', 'zz') THEN 'ST' WHEN word = 'cr1' THEN 'H3' WHEN word = 'pr' THEN 'H2' WHEN word = 'ab' THEN 'H1' WHEN word = 'sk' THEN 'ST' END AS heuristic,
    CASE WHEN word = w1 THEN word WHEN word = substr(w1, 1, 1) || substr(w2, 1, 1) THEN w1 || '#' || w2 WHEN word = substr(w2, 1, 2) THEN w2
      WHEN word = 'cr1' THEN 'cover1' WHEN word = 'pr' THEN 'probe' WHEN word = 'ab' THEN 'apple#bread' ELSE word END AS expansion FROM t""")
def trigger_expansion(spark, sf):
    """The words of new names, expanded by the old expansion, else the class's, the project's or the general record; listed words stay as they are."""
    i = identifiers(spark, sf)
    w = F.array("w1", F.substring("w2", 1, 2), F.concat(F.substring("w1", 1, 1), F.substring("w2", 1, 1)), F.concat(F.lit("cr"), (F.col("id") % 2).cast("string")), *map(F.lit, ("pr", "ab", "sk", "zz")))
    table = lambda rows, cols: spark.createDataFrame(rows, cols)
    classes = i.select("file").distinct().select("file", F.lit("cr1").alias("abbr"), F.lit("cover1").alias("expansion"))
    return expand.trigger_expansions(
        i.select("id", "file", w.alias("words"), F.array("w1", "w2").alias("old_expansion")), "id", table([("unseen",)], "word string"), classes,
        table([("pr", "press"), ("pr", "probe"), ("sk", "skill")], "abbr string, expansion string"), table([("ab", "apple bread"), ("ab", "a b"), ("pr", "prune")], "abbr string, expansion string"), table([("sk",), ("ab",)], "abbr string"),
    ).select("id", "word", "heuristic", "expansion")


@query(IDS + """SELECT id_type, CASE WHEN id % 2 = 0 THEN 'LinsenAbbr' ELSE 'ComputerAbbr' END AS source, CAST(count(*) AS BIGINT) AS n_total, CAST(count(CASE WHEN line % 3 <> 0 THEN 1 END) AS BIGINT) AS n_got, CAST(count(CASE WHEN line % 3 = 1 THEN 1 END) AS BIGINT) AS n_right,
    round(CAST(count(CASE WHEN line % 3 = 1 THEN 1 END) AS DOUBLE) / count(CASE WHEN line % 3 <> 0 THEN 1 END), 9) AS "precision", round(CAST(count(CASE WHEN line % 3 = 1 THEN 1 END) AS DOUBLE) / count(CASE WHEN line % 3 <> 0 THEN 1 END) / (1 + exp(-CAST(count(CASE WHEN line % 3 = 1 THEN 1 END) AS DOUBLE))), 9) AS metric
    FROM ids GROUP BY 1, 2 HAVING count(CASE WHEN line % 3 <> 0 THEN 1 END) > 0""")
def dictionary_priority(spark, sf):
    """Precision and metric of lists of abbreviations as sources."""
    i = identifiers(spark, sf)
    d = i.select("id_type", F.when(F.col("id") % 2 == 0, "LinsenAbbr").otherwise("ComputerAbbr").alias("source"), (F.col("line") % 3 == 1).alias("right"), (F.col("line") % 3 != 0).alias("got"))
    out = expand.dictionary_priority(d).filter("n_got > 0").select("id_type", F.col("rel").alias("source"), "n_total", "n_got", "n_right", "precision", "metric")
    return rounded(out, ["precision", "metric"])


@query(IDS + """, r AS (SELECT id_type, rel, heuristic, metric, row_number() OVER (PARTITION BY id_type ORDER BY metric DESC, rel, heuristic) AS k FROM (SELECT id_type, 'r' || (line % 4) AS rel, 'H' || (line % 3 + 1) AS heuristic, CAST(count(*) AS DOUBLE) AS metric FROM ids GROUP BY 1, 2, 3))
    SELECT id_type, '{' || string_agg('"' || id_type || '#' || rel || '_' || heuristic || '"', ', ' ORDER BY k) || '}' AS literal FROM r GROUP BY 1""")
def rank_literals(spark, sf):
    """Each kind's labels by rank, as the text of an array."""
    from namewright.sources import writers

    m = identifiers(spark, sf).groupBy("id_type", F.concat(F.lit("r"), (F.col("line") % 4).cast("string")).alias("rel"), F.concat(F.lit("H"), (F.col("line") % 3 + 1).cast("string")).alias("heuristic")).agg(F.count("*").cast("double").alias("metric"))
    return writers.rank_arrays(expand.rank_labels(m))


@query("""SELECT conv_id, turn, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS letters FROM conversations""")
def comment_letters(spark, sf):
    """Texts cut down to letters and single spaces, whole."""
    return load(spark, sf, "conversations").select("conv_id", "turn", names.comment_letters("text").alias("letters"))
