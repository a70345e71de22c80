"""Abbreviation expansion: candidate expansions of words from related names, votes, and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namewright.functions.names import sigmoid, subsequence


def acronym(abbr: Column, terms: Column, known: Column | None = None) -> Column:
    """The first window of terms whose initials spell abbr (two letters or more), joined by #; null if that window has a word that is not known."""
    k = F.length(abbr)
    starts = F.when(F.size(terms) >= k, F.sequence(F.lit(1), F.size(terms) - k + 1)).otherwise(F.array().cast("array<int>"))
    spelled = F.filter(starts, lambda i: F.array_join(F.transform(F.slice(terms, i, k), lambda x: F.substring(x, 1, 1)), "") == abbr)
    window = F.slice(terms, F.get(spelled, F.lit(0)), k)
    ok = (F.size(spelled) > 0) & (k >= 2)
    if known is not None:
        ok = ok & F.forall(window, lambda x: F.array_contains(known, x))
    return F.when(ok, F.array_join(window, "#"))


def _shortest(terms: Column, fits) -> Column:
    best = F.array_sort(F.transform(F.filter(terms, fits), lambda x: F.struct(F.length(x).alias("n"), x.alias("term"))))
    return F.get(best, F.lit(0))["term"]


def prefix(abbr: Column, terms: Column, known: Column | None = None) -> Column:
    """The shortest (then first by letters) longer term that abbr begins; of known terms only, where known (an array) is given."""
    return _shortest(terms, lambda x: x.startswith(abbr) & (x != abbr) & _in(known, x))


def dropped(abbr: Column, terms: Column, known: Column | None = None) -> Column:
    """The shortest longer term of which abbr (two letters or more) is a subsequence with the same first letter; known as in prefix()."""
    return F.when(F.length(abbr) >= 2, _shortest(terms, lambda x: subsequence(x, abbr) & (x != abbr) & _in(known, x)))


def _in(known: Column | None, x: Column) -> Column:
    return F.lit(True) if known is None else F.array_contains(known, x)


def _picked(h: str, e: Column) -> Column:
    return F.struct(F.lit(h).alias("heuristic"), e.alias("expansion"))


def table_side(abbr: Column, terms: Column, known: Column | None = None) -> Column:
    """H1, else H2, else H3 over terms, as a struct (heuristic, expansion); null if none applies. known: the dictionary words among terms, as an array."""
    h1, h2, h3 = acronym(abbr, terms, known), prefix(abbr, terms, known), dropped(abbr, terms, known)
    return F.when(h1.isNotNull(), _picked("H1", h1)).when(h2.isNotNull(), _picked("H2", h2)).when(h3.isNotNull(), _picked("H3", h3))


def trigger_side(abbr: Column, terms: Column) -> Column:
    """As table_side, but the last prefix by letters and the first subsequence by place win, and no dictionary is asked."""
    h1, h2 = acronym(abbr, terms), F.array_max(F.filter(terms, lambda x: x.startswith(abbr)))
    h3 = F.get(F.filter(terms, lambda x: subsequence(x, abbr)), F.lit(0))
    return F.when(h1.isNotNull(), _picked("H1", h1)).when(h2.isNotNull(), _picked("H2", h2)).when(h3.isNotNull(), _picked("H3", h3))


def with_plural(candidates, abbr: Column, terms: Column, known: Column | None = None) -> Column:
    """candidates(abbr, terms, known), and where that is null and abbr ends in s, the same without it."""
    bare = F.regexp_replace(abbr, "(?<=.)s$", "")
    more = () if known is None else (known,)
    return F.coalesce(candidates(abbr, terms, *more), F.when(bare != abbr, candidates(bare, terms, *more)))


def known_terms(df: DataFrame, keys: list[str], terms: str, dictionary: DataFrame) -> DataFrame:
    """df with a column known: those of its terms (an array) that are dictionary words (word) of two letters or more. keys tell the rows apart."""
    each = df.select(*keys, F.explode(F.array_distinct(terms)).alias("word")).filter(F.length("word") > 1)
    found = each.join(dictionary.select("word").distinct(), "word", "left_semi").groupBy(*keys).agg(F.collect_set("word").alias("known"))
    return df.join(found, keys, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def comment_words(comment: Column) -> Column:
    """The words of a comment: letters only, lower case."""
    return F.split(F.lower(F.trim(F.regexp_replace(comment, "[^A-Za-z]+", " "))), " ")


def from_comment(abbr: Column, comment: Column, known: Column | None = None) -> Column:
    """table_side over the words of a comment; with known (an array) an acronym is looked for among the dictionary words alone."""
    w = comment_words(comment)
    return table_side(abbr, w if known is None else F.filter(w, lambda x: F.array_contains(known, x)), known)


def unless_skipped(word: Column, expansion: Column, heuristic: Column, skip: Column) -> Column:
    """The expansion, or the word itself where it is on the skip list (array) and no acronym."""
    return F.when(F.array_contains(skip, word) & (F.coalesce(heuristic, F.lit("")) != "H1"), word).otherwise(F.coalesce(expansion, word))


def unknown_words(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Words that need expansion: single letters, and those the dictionary does not have."""
    d = dictionary.select(F.col("word").alias("_known")).distinct()
    return words.join(d, (F.col(word) == F.col("_known")) & (F.length(word) > 1), "left_anti")


def candidates(unknown: DataFrame, edges: DataFrame, names: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(id, word, rel, heuristic, expansion): expansions of each unknown word (id, word) from the words of related names (id, words); from their dictionary words alone, where one is given."""
    n = names.select("id", "words") if dictionary is None else known_terms(names.select("id", "words"), ["id"], "words", dictionary)
    related = edges.join(n.withColumnRenamed("id", "dst"), "dst")
    met = unknown.join(related, unknown["id"] == related["src"])
    c = with_plural(table_side, F.col("word"), F.col("words"), None if dictionary is None else F.col("known"))
    return met.withColumn("c", c).filter("c is not null").select("id", "word", "rel", "c.heuristic", "c.expansion")


def vote(found: DataFrame, keys: list[str]) -> DataFrame:
    """The expansion with most votes for each key; ties go to the shorter, then the first by letters. Its heuristic is the least name among its votes'."""
    counted = found.groupBy(*keys, "expansion").agg(F.count("*").alias("votes"), F.min("heuristic").alias("heuristic"))
    best = F.min_by(F.struct("expansion", "heuristic", "votes"), F.struct(-F.col("votes"), F.length("expansion"), "expansion"))
    return counted.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.expansion", "b.heuristic", "b.votes")


def expanded(unknown: DataFrame, voted: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """(id, word, expansion, heuristic): the vote, else the dictionary of abbreviations (first by letters), else the word itself as ST."""
    d = abbreviations.groupBy(F.col("abbr").alias("word")).agg(F.min("expansion").alias("_dict"))
    out = unknown.join(voted, ["id", "word"], "left").join(d, "word", "left")
    return out.select("id", "word", F.coalesce("expansion", "_dict", "word").alias("expansion"), F.when(F.col("expansion").isNotNull(), F.col("heuristic")).when(F.col("_dict").isNotNull(), "H3").otherwise("ST").alias("heuristic"))


def parts_of(expansion: Column, heuristic: Column, case: Column) -> Column:
    """Array of (word, case): the words of an expansion; a TITLE acronym gets UPPER and then LOWER, others keep the case."""
    return F.transform(F.split(expansion, "#"), lambda w, i: F.struct(w.alias("word"), F.when((heuristic == "H1") & (case == "TITLE"), F.when(i == 0, "UPPER").otherwise("LOWER")).otherwise(case).alias("case")))


def record_of(found: DataFrame) -> DataFrame:
    """First abbreviation for each (heuristic, expansion), by row order column seq."""
    return found.filter(F.col("heuristic").isin("H2", "H3")).groupBy("heuristic", "expansion").agg(F.min_by("abbr", "seq").alias("abbr"))


def class_record(found: DataFrame) -> DataFrame:
    """(file, abbr, expansion): the most frequent expansion of each abbreviation in each file."""
    counted = found.groupBy("file", "abbr", "expansion").agg(F.count("*").alias("n"))
    return counted.groupBy("file", "abbr").agg(F.max_by("expansion", F.struct("n", "expansion")).alias("expansion"))


def cascade(word: Column, in_dictionary: Column, old_expansion: Column, class_map: Column, project_map: Column, abbr_map: Column) -> Column:
    """Trigger-side expansion: a known word; a word of the old expansion; heuristics on it; class, project and abbreviation records; the word."""
    guess = trigger_side(word, old_expansion)["expansion"]
    return F.when(in_dictionary | F.array_contains(old_expansion, word), word).otherwise(F.coalesce(guess, F.try_element_at(class_map, word), F.try_element_at(project_map, word), F.try_element_at(abbr_map, word), word))


def coded(heuristic: Column, expansion: Column) -> Column:
    """heuristic:words, the words joined by #: an expansion as expansion_maps() holds it."""
    return F.concat(heuristic, F.lit(":"), expansion)


def expansion_maps(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expansions): a name's expansions as a map from word to heuristic:words, from (keys, word, expansion, heuristic). Words that stand for themselves are left out."""
    one = found.filter((F.col("heuristic") != "ST") & F.col("expansion").isNotNull()).groupBy(*keys, "word").agg(F.min(coded(F.col("heuristic"), F.col("expansion"))).alias("e"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "e"))).alias("expansions"))


def trigger_expansions(
    triggers: DataFrame, key: str, dictionary: DataFrame, class_records: DataFrame, records: DataFrame, abbreviations: DataFrame, skip: DataFrame,
) -> DataFrame:
    """(key, word, heuristic, expansion) of the words of triggers' new names.

    triggers: (key, file, words array, old_expansion array). A dictionary word or one of the old expansion stands
    for itself; else the heuristics look in the old expansion, or else in the words of the class's record, of the project's
    record (the last by letters) or of the list of abbreviations (the last), whichever comes first. An abbreviation
    of the skip list stands for itself unless it is an acronym. dictionary: (word); class_records: (file, abbr,
    expansion); records, abbreviations: (abbr, expansion); skip: (abbr). All are joined; none is broadcast by force.
    """
    w = triggers.select(key, "file", "old_expansion", F.explode(F.array_distinct("words")).alias("word"))
    last = lambda d, c, *by: d.groupBy(*by, F.col("abbr").alias("word")).agg(F.max("expansion").alias(c))
    w = w.join(dictionary.select("word").distinct().withColumn("_known", F.lit(True)), "word", "left").join(last(class_records, "_class", "file"), ["file", "word"], "left")
    w = w.join(last(records, "_project"), "word", "left").join(last(abbreviations, "_list"), "word", "left").join(skip.select(F.col("abbr").alias("word")).distinct().withColumn("_skip", F.lit(True)), "word", "left")
    word, parts = F.col("word"), lambda c: F.split(c, "[ #]")
    own = F.coalesce("_known", F.lit(False)) | F.array_contains("old_expansion", word)
    from_old = trigger_side(word, F.col("old_expansion"))
    from_record = F.when(F.col("_class").isNotNull(), trigger_side(word, parts("_class"))).when(F.col("_project").isNotNull(), trigger_side(word, F.array("_project"))).when(F.col("_list").isNotNull(), trigger_side(word, parts("_list")))
    got = F.when(~own, F.coalesce(from_old, from_record))
    w = w.withColumn("g", got)
    keeps = F.col("g").isNull() | (F.coalesce("_skip", F.lit(False)) & (F.col("g.heuristic") != "H1"))
    return w.select(key, "word", F.when(keeps, "ST").otherwise(F.col("g.heuristic")).alias("heuristic"), F.when(keeps, word).otherwise(F.col("g.expansion")).alias("expansion"))


def priority(scored: DataFrame) -> DataFrame:
    """From (id_type, rel, heuristic, right, got): counts for each kind, precision = right / got and metric = precision * sigmoid(right)."""
    got, right = F.count_if("got"), F.count_if(F.col("right") & F.col("got"))
    out = scored.groupBy("id_type", "rel", "heuristic").agg(F.count("*").alias("n_total"), got.alias("n_got"), right.alias("n_right"))
    out = out.withColumn("precision", F.coalesce(F.try_divide(F.col("n_right").cast("double"), F.col("n_got")), F.lit(0.0)))
    return out.withColumn("metric", F.col("precision") * sigmoid(F.col("n_right").cast("double")))


def dictionary_priority(scored: DataFrame) -> DataFrame:
    """The same for sources that are lists of abbreviations: (id_type, source, right, got) to rows whose rel is the source and whose heuristic is empty."""
    return priority(scored.select("id_type", F.col("source").alias("rel"), F.lit("").alias("heuristic"), "right", "got"))


def rank_labels(prioritised: DataFrame) -> DataFrame:
    """Rank of each label type#relation_heuristic by falling metric within its type; metric 0 is left out."""
    w = Window.partitionBy("id_type").orderBy(F.desc("metric"), "rel", "heuristic")
    return prioritised.filter("metric > 0").select("id_type", F.concat("id_type", F.lit("#"), "rel", F.lit("_"), "heuristic").alias("label"), "metric", F.row_number().over(w).alias("rank"))
