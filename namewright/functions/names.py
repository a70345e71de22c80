"""Identifier names as columns: splitting, delimiters, cases, patterns and putting names together again.

All are built-in expressions, so they stay inside generated code; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Delimiters; words; what lies between them (upper-case runs and other letters).
_TOKEN = r"[_$\d]+|[A-Z]?[a-z]+|(?:(?![_$\d]|[A-Z]?[a-z]).)+"
_DELIM = r"^[_$\d]+$"
_CUT = "\x01"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain(name: Column | str) -> Column:
    """The name without type arguments (first < to last >) and array brackets."""
    return F.regexp_replace(F.regexp_replace(_c(name), r"<.*>", ""), r"\[.*\]", "")


def tokens(name: Column | str) -> Column:
    """Words and delimiter runs, in order, as written."""
    return F.regexp_extract_all(plain(name), F.lit(f"({_TOKEN})"), F.lit(1))


def raw_words(name: Column | str) -> Column:
    """Words as written."""
    return F.filter(tokens(name), lambda t: ~t.rlike(_DELIM))


def words(name: Column | str) -> Column:
    """Words in lower case."""
    return F.transform(raw_words(name), F.lower)


def delimiters(name: Column | str) -> Column:
    """One more delimiter than words: before the first, between, and after the last ('' inside camel case)."""
    return F.split(F.array_join(F.transform(tokens(name), lambda t: F.when(t.rlike(_DELIM), t).otherwise(_CUT)), ""), _CUT)


def case_of(word: Column) -> Column:
    """UPPER before TITLE, so a single capital is UPPER."""
    return F.when(word.rlike("^[A-Z]+$"), "UPPER").when(word.rlike("^[A-Z][a-z]+$"), "TITLE").when(word.rlike("^[a-z]+$"), "LOWER").otherwise("UNKNOWN")


def cases(name: Column | str) -> Column:
    return F.transform(raw_words(name), case_of)


def patterns(case_list: Column | str, delims: Column | str) -> Column:
    """LCAMEL or TCAMEL where all later words are TITLE; SNAKE where every inner delimiter of several words has an underscore. Both may hold."""
    c, d = _c(case_list), _c(delims)
    later = F.forall(F.slice(c, 2, F.greatest(F.lit(0), F.size(c))), lambda x: x == "TITLE")
    first = F.get(c, F.lit(0))
    snake = (F.size(c) > 1) & F.forall(F.slice(d, 2, F.greatest(F.lit(0), F.size(c) - 1)), lambda x: x.contains("_"))
    return F.array_compact(F.array(F.when(later & (first == "LOWER"), "LCAMEL").when(later & (first == "TITLE"), "TCAMEL"), F.when(snake, "SNAKE")))


def capital(word: Column) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def recase(word_list: Column | str, pattern_list: Column | str, case_list: Column | str) -> Column:
    """Words in the cases of a camel pattern, or else each in its own case."""
    w, p, c = _c(word_list), _c(pattern_list), _c(case_list)
    own = F.zip_with(w, c, lambda x, k: F.when(k == "UPPER", F.upper(x)).when(k == "TITLE", capital(x)).when(k == "LOWER", F.lower(x)).otherwise(x))
    camel = F.transform(w, lambda x, i: F.when((i == 0) & F.array_contains(p, "LCAMEL"), F.lower(x)).otherwise(capital(x)))
    return F.when(F.array_contains(p, "LCAMEL") | F.array_contains(p, "TCAMEL"), camel).otherwise(own)


def join(word_list: Column | str, pattern_list: Column | str, delims: Column | str) -> Column:
    """The name of these words: underscores for SNAKE, otherwise delimiters and words in turn."""
    w, p, d = _c(word_list), _c(pattern_list), _c(delims)
    turns = F.array_join(F.flatten(F.zip_with(d, w, lambda x, y: F.array(x, F.coalesce(y, F.lit(""))))), "")
    return F.when(F.array_contains(p, "SNAKE"), F.array_join(w, "_")).otherwise(turns)


def padded(a: Column | str, n: Column) -> Column:
    """Cut or filled with its last element to length n; an empty array stays empty."""
    a = _c(a)
    return F.when(F.size(a) == 0, a).otherwise(F.concat(F.slice(a, F.lit(1), n), F.array_repeat(F.element_at(a, -1), F.greatest(F.lit(0), n - F.size(a)))))


def find_slice(a: Column | str, part: Column | str) -> Column:
    """0-based first place of part in a, or -1."""
    a, part = _c(a), _c(part)
    last = F.size(a) - F.size(part)
    places = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(a, i + 1, F.size(part)) == part)
    return F.coalesce(F.get(places, F.lit(0)), F.lit(-1))


def replace_slice(a: Column | str, start: Column, end: Column, value: Column | str) -> Column:
    """a with places start .. end - 1 replaced by value."""
    a = _c(a)
    return F.concat(F.slice(a, F.lit(1), start), _c(value), F.slice(a, end + 1, F.greatest(F.lit(0), F.size(a) - end)))


def subsequence(term: Column, abbr: Column) -> Column:
    """The letters of abbr occur in term in order, the first one first."""
    return F.rlike(term, F.concat(F.lit("^"), F.array_join(F.split(abbr, ""), ".*")))


def same_word(a: Column, b: Column) -> Column:
    """Equal but for case, outer spaces and one plural s."""
    base = lambda x: F.regexp_replace(F.lower(F.trim(x)), r"(?<=.)s$", "")
    return base(a) == base(b)


def same_expansion(listed: Column, expansion: Column) -> Column:
    """Some item of a ;-separated list is the same word sequence as expansion (separated by # or ;, spaces aside)."""
    base = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"\s", ""), r"(?<=.)s$", "")
    return F.exists(F.split(listed, ";"), lambda x: base(F.replace(x, F.lit("#"), F.lit(""))) == base(F.replace(F.replace(expansion, F.lit("#"), F.lit("")), F.lit(";"), F.lit(""))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def comment_letters(text: Column | str) -> Column:
    """Letters only, single spaces."""
    return F.trim(F.regexp_replace(_c(text), "[^A-Za-z]+", " "))


def no_commas(text: Column | str) -> Column:
    return F.translate(_c(text), ",", "_")


def op_key(op: Column | str) -> Column:
    """The grouping key of an operation struct."""
    return F.to_json(_c(op))


def abbreviated(word_list: Column | str, heuristics: Column | str, record: Column) -> Column:
    """H1: first letter; H2 and H3: the record's abbreviation of the word, or the word; others: the word. record: map<string, string>."""
    return F.zip_with(_c(word_list), _c(heuristics), lambda w, h: F.when(h == "H1", F.substring(w, 1, 1)).when(h.isin("H2", "H3"), F.coalesce(F.try_element_at(record, w), w)).otherwise(w))
