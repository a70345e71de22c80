"""Quality rules by distribution divergence (DataFrame functions only).

Each document's histogram of character classes and of its language's commonest function words (as written in lower case or with a capital) is
compared with that language's histogram over the whole corpus by the Jensen-Shannon distance.
Counting rules (length, repeated windows of eight words) stand before it.

Defined results: a null text counts as empty, has no words and fails; a null or unlisted language has
no reference, so only the counting rules and the minimum-length guards decide; repeated rows are
judged each on its own; an empty table gives an empty result; further columns are not read and not
returned. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import WORD_RE, stored, words

#: Common words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "das", "ist", "in", "ein", "zu", "nicht", "von", "sich", "auf"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "a", "it", "for", "was", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "un", "por"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est"],
}
#: Character classes, as regular expressions. They are disjoint and taken out of the text one after the other, the commonest first.
CHAR_CLASSES = {
    "lower": r"[a-z]+",
    "space": r"[\x20\x09-\x0D]+",
    "letter": r"[^\x00-\x7F]+",
    "upper": r"[A-Z]+",
    "stop": r"[.,;:!?'\"()-]+",
    "digit": r"[0-9]+",
    "symbol": r"[#*$%&|<>]+",
}
WINDOW = 8


def _covered(window: int) -> Column:
    """Words in windows that occur twice or more: starts of equal windows, each covering what the next does not."""
    at = "sort_array(transform(filter(srt, (x, k) -> coalesce(get(srt, k - 1).h = x.h, false) or coalesce(get(srt, k + 1).h = x.h, false)), x -> x.i))"
    return F.expr(f"aggregate(transform(pos, (p, k) -> cast(least({window}, coalesce(get(pos, k + 1) - p, {window})) as bigint)), 0L, (a, x) -> a + x)"), F.expr(at)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", window: int = WINDOW) -> DataFrame:
    """Counts and histograms of each document: one pass over the texts, no shuffle."""
    lists = F.create_map(*[x for k, v in sorted(COMMON_WORDS.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({x for v in COMMON_WORDS.values() for w in v for x in (w, w.capitalize())})
    text = F.coalesce(F.col("t"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang") if lang_col in docs.columns else F.lit(None).cast("string").alias("lang"), F.col(text_col).alias("t"))
    d = d.select("doc_id", "lang", F.xxhash64("t").alias("text_hash"), text.alias("t"), words(F.col("t")).alias("w"))
    d = d.select(
        "doc_id", "lang", "text_hash", "t", "w", F.size("w").cast("long").alias("n_words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD_RE)).alias("lines"),
        F.when(F.size("w") >= window, F.expr(f"transform(sequence(1, size(w) - {window - 1}), i -> xxhash64(slice(w, i, {window})))")).otherwise(F.array().cast("array<bigint>")).alias("win"),
    )
    d = d.withColumn("srt", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.expr("transform(win, (h, i) -> struct(h as h, i as i))"))).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)")))
    total, at = _covered(window)
    d = d.withColumn("pos", at)
    # each class is counted by what its removal leaves; later classes see only that
    d = d.withColumn("n_chars", F.length("t").cast("long")).withColumn("left", F.col("n_chars"))
    for k, r in CHAR_CLASSES.items():
        d = d.withColumn("t", F.regexp_replace("t", r, "")).withColumn(k, F.col("left") - F.length("t")).withColumn("left", F.length("t").cast("long"))
    d = d.select(
        "doc_id", "lang", "text_hash", "n_words", total.alias("n_repeat_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_chars", *CHAR_CLASSES, "left",
        F.when(F.element_at(lists, F.col("lang")).isNotNull(), F.element_at(lists, F.col("lang"))).otherwise(F.array().cast("array<string>")).alias("list"),
        F.transform(F.filter("w", lambda x: x.isin(every)), F.lower).alias("common"),
    )
    d = d.withColumn("word_hist", F.expr("transform(list, c -> cast(size(filter(common, x -> x = c)) as bigint))"))
    return d.select(
        "doc_id", "lang", "text_hash", "n_words", (F.col("n_chars") - F.col("space")).alias("word_chars"), F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.array(*CHAR_CLASSES, "left").alias("char_hist"),
        F.expr("concat(word_hist, array(greatest(0L, n_words - aggregate(word_hist, 0L, (a, x) -> a + x))))").alias("word_hist"),
    )


def jensen_shannon(p: str, q: str) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two arrays of counts; null where either is empty."""
    share = lambda a: f"transform({a}, x -> x / aggregate({a}, 0D, (s, y) -> s + y))"
    half = "aggregate(zip_with(p, q, (x, y) -> if(x > 0, x * log2(2 * x / (x + y)), 0D) + if(y > 0, y * log2(2 * y / (x + y)), 0D)), 0D, (s, z) -> s + z) / 2"
    one = f"transform(array(struct({share(p)} as p, {share(q)} as q)), s -> sqrt(greatest(0D, {half.replace('zip_with(p, q', 'zip_with(s.p, s.q').replace('(s, z) -> s + z', '(u, z) -> u + z')})))[0]"
    total = lambda a: f"coalesce(aggregate({a}, 0D, (s, y) -> s + y), 0D)"
    return F.expr(f"case when {total(p)} > 0 and {total(q)} > 0 then {one} end")


def references(feats: DataFrame) -> DataFrame:
    """Histograms of each listed language over all documents that pass the counting rules; at most one row for each listed language."""
    n_char, widest = len(CHAR_CLASSES) + 1, max(map(len, COMMON_WORDS.values())) + 1
    # the median of the documents' shares: neither huge documents nor a part of junk moves it
    share = lambda a, i: F.try_divide(F.get(a, F.lit(i)).cast("double"), F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    return (
        feats.filter(F.col("lang").isin(sorted(COMMON_WORDS)) & ~F.col("base_failed"))
        .groupBy(F.col("lang").alias("ref_lang"))
        .agg(
            F.array(*[F.coalesce(F.percentile_approx(share("char_hist", i), 0.5), F.lit(0.0)) for i in range(n_char)]).alias("char_ref"),
            F.array(*[F.coalesce(F.percentile_approx(share("word_hist", i), 0.5), F.lit(0.0)) for i in range(widest)]).alias("word_ref"),
        )
    )


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    min_words: int = 20, max_repeat_percent: int = 30, min_chars_for_js: int = 200, min_words_for_js: int = 60, max_char_js: float = 0.33, max_word_js: float = 0.33, max_sum_js: float = 0.46,
) -> DataFrame:
    """Verdicts: doc_id, counts, base_failed, kept, char_js, word_js, text_hash (xxhash64 of the text, to tell rows of one id apart).

    The distance is judged only from min_chars_for_js characters (char classes) or min_words_for_js
    words (common words) on, and their sum where both are there: text that is somewhat off in both ways
    is rejected before text that is off in one. Features are stored once (a few numbers a document), as the references
    need all of them first; the references are at most one row for each listed language, so they are broadcast.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    feats = stored(features(docs, id_col, text_col, lang_col).withColumn("base_failed", failed), "quality-features")
    judged = feats.join(F.broadcast(references(feats)), F.col("lang") == F.col("ref_lang"), "left")
    n_chars = F.aggregate("char_hist", F.lit(0).cast("long"), lambda a, x: a + x)
    judged = judged.withColumns({
        "char_js": F.when(n_chars >= min_chars_for_js, jensen_shannon("char_hist", "char_ref")),
        "word_js": F.when(F.col("n_words") >= min_words_for_js, jensen_shannon("word_hist", "word_ref")),
    })
    diverges = (F.coalesce("char_js", F.lit(0.0)) > max_char_js) | (F.coalesce("word_js", F.lit(0.0)) > max_word_js) | (F.coalesce(F.col("char_js") + F.col("word_js"), F.lit(0.0)) > max_sum_js)
    return judged.withColumn("kept", ~F.col("base_failed") & ~diverges).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_js", "word_js", "text_hash")
