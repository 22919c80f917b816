"""Operator 7, quality rules: a threshold table compiled into one Spark projection.

Everything is a built-in expression over a row's text: no user function, no shuffle. ``measures``
gives the counts of a text, ``RULES`` the allowed range of each ratio of them, and ``verdict``
the conjunction of all rules. Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at ``\\n``.

Defined results: a null, empty or blank text has all counts 0 and fails the base rule (fewer than
20 words); repeated rows are judged each for itself; an empty table gives no rows; input columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30

#: Frequent function words of the languages of the corpus.
STOP_WORDS = ("the of and to in a is that it for on was be with by as an this "
              "de la le les et des en que une du "
              "der die und das ein eine zu den von ist nicht mit "
              "el los las y un por con del se su para").split()

#: (name, numerator, denominator, least, most): a text passes where least <= ratio <= most.
RULES = [
    ("mean word length", "word_chars", "n_words", 2.0, 15.0),
    ("symbols per word", "n_symbols", "n_words", 0.0, 0.1),
    ("stop words per word", "n_stop_words", "n_words", 0.02, 1.0),
    ("repeated lines per line", "n_dup_lines", "n_lines", 0.0, 0.5),
    ("distinct words per word, short texts", "n_distinct_scaled", "n_words", 0.3, 1.0e9),
    ("words per line", "n_words", "n_lines", 2.0, 100000.0),
]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \t-\r]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    A text whose window hashes are all distinct has none; only others have their hashes sorted.
    """
    def covered(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts) - 1), F.array(F.lit(2 ** 30)))
        return F.aggregate(F.zip_with(starts, ends, lambda a, b: F.least(b - a, F.lit(window))), F.lit(0),
                           lambda total, n: total + n)

    def starts(pairs: Column) -> Column:
        n = F.size(pairs)
        same = (lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"])
        found = F.filter(F.sequence(F.lit(0), n - 1),
                         lambda i: ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False)))
                         | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.array_sort(F.transform(found, lambda i: F.get(pairs, i)["i"]))

    def of_hashes(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            _let(_let(pairs, starts), covered))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)),
                             lambda i: F.xxhash64(F.slice(w, i, F.lit(window))))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(_let(hashes, of_hashes))

    return _let(words, of_words)


def measures(documents: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """doc_id and the counts of every text that the rules read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \t-\r]"))
    stop = stop_words or STOP_WORDS

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"))

    def line_counts(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"),
                        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), _let(words_of(text), counts).alias("w"),
        _let(lines, line_counts).alias("l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    return docs.select("doc_id", "w.*", "l.*", "n_symbols").withColumn(
        "n_distinct_scaled", F.col("n_distinct_words") * F.greatest(F.lit(1.0), F.col("n_words") / 500))


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 percent of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def verdict(rules: list[tuple] | None = None) -> Column:
    """All rules of the table hold (a ratio over 0 counts as 0)."""
    passed = F.lit(True)
    for _, top, bottom, least, most in rules or RULES:
        ratio = F.coalesce(F.col(top) / F.nullif(F.col(bottom).cast("double"), F.lit(0.0)), F.lit(0.0))
        passed = passed & (ratio >= least) & (ratio <= most)
    return passed


def judge(documents: DataFrame, rules: list[tuple] | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """Counts and verdict of every document."""
    return measures(documents, stop_words).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
