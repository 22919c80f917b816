"""Column expressions over versions and texts (P1-P9 and the tokenizers).

Names, guards and tokenizers are built-in Spark expressions; the cleaning and counting of P5-P8, which
look at every word, run in Arrow batches (``words.py``). Regexes use explicit character classes so that they mean the same in Java (Spark)
and RE2 (the DuckDB oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textdrift.constants import FAMILIES, ORIGINAL, STOPWORDS_EN
from textdrift.functions import words as wd

# ---------------------------------------------------------------------------------------------
# Fixed regex classes
# ---------------------------------------------------------------------------------------------

# the characters Python's str.split() treats as whitespace
WS_CHARS = (r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD_RE = f"[^{WS_CHARS}]+"                                   # whitespace-separated word
BLEU_TOKEN_RE = rf"[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{WS_CHARS}]"  # letter/digit runs, single marks
ROUGE_TOKEN_RE = "[a-z0-9]+"                                  # after lower()
ALPHA_RE = r"\p{L}+"                                          # alphabetic tokens (type-token ratio)
PUNCT_CLASS_RE = r"[!-/:-@\[-`{-~]"                           # the 32 ASCII punctuation characters
SENTENCE_SPLIT_RE = rf"[.!?]+[{WS_CHARS}]+"                   # sentence boundary
HAS_ALNUM_RE = r"[\p{L}\p{N}]"                               # a word holds a letter or digit


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(col, pattern: str) -> Column:
    """All matches of ``pattern`` (whole match, group 0)."""
    return F.regexp_extract_all(_c(col), F.lit(pattern), 0)


# ---------------------------------------------------------------------------------------------
# Version name -> stage, paraphraser, family; source group
# ---------------------------------------------------------------------------------------------

def stage_of(version_name="version_name") -> Column:
    """Original -> T0; no underscore -> T1; one -> T2; two or more -> T3; NULL -> NULL."""
    v = _c(version_name)
    underscores = F.length(v) - F.length(F.replace(v, F.lit("_"), F.lit("")))
    return (F.when(v == ORIGINAL, "T0")
            .when(underscores == 0, "T1")
            .when(underscores == 1, "T2")
            .when(underscores > 1, "T3"))


def paraphraser_of(version_name="version_name") -> Column:
    """First underscore-separated segment (``original`` stays ``original``)."""
    return F.substring_index(_c(version_name), "_", 1)


def family_of(paraphraser="paraphraser") -> Column:
    """Rewriter -> family; ``original`` -> ``none``; anything else -> ``unknown``."""
    p = _c(paraphraser)
    expr = F.when(p == ORIGINAL, "none")
    for fam, members in FAMILIES.items():
        expr = expr.when(p.isin(*members), fam)
    return expr.otherwise("unknown")


def source_group(source="source", ai_label: str = "AI") -> Column:
    """``Human`` stays, everything else becomes ``ai_label`` (``AI`` or ``LLM``)."""
    return F.when(_c(source) == "Human", "Human").otherwise(ai_label)


# ---------------------------------------------------------------------------------------------
# Cleaning, stopwords, counts, guards
# ---------------------------------------------------------------------------------------------

def clean_text(text="text") -> Column:
    """P5: lower, keep [a-z0-9] inside each space-separated token, drop empty tokens.

    Characters between two spaces are fused, so a newline inside a token disappears
    ("a\\nb" -> "ab") and non-ASCII letters are removed ("cafe\\u0301" -> "cafe").
    """
    return wd.cleaned(_c(text))


def remove_stopwords(cleaned="cleaned_text", words=None) -> Column:
    """Drop tokens that are in ``words`` (repeated words are kept, order is kept)."""
    words = list(STOPWORDS_EN if words is None else words)
    return wd.without(_c(cleaned), words)


def word_count(col) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    return wd.word_count(_c(col))


def spaced_word_count(cleaned) -> Column:
    """Words of a text that has exactly one space between words."""
    c = _c(cleaned)
    spaces = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(c == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def unique_word_count(cleaned) -> Column:
    return wd.distinct_count(_c(cleaned))


def is_blank(text="text") -> Column:
    """NULL, or nothing but white space (every character of ``WS_CHARS``)."""
    t = _c(text)
    return t.isNull() | ~t.rlike(WORD_RE)


def guard_text(text="text", max_chars: int | None = None) -> Column:
    """Null or blank -> empty string; optional cut to ``max_chars`` characters.

    ``max_chars=None`` keeps the whole text (the default of every registered query).
    """
    t = _c(text)
    guarded = F.when(is_blank(t), F.lit("")).otherwise(t)
    if max_chars is not None:
        guarded = F.substring(guarded, 1, int(max_chars))
    return guarded


# ---------------------------------------------------------------------------------------------
# tokenizers of the overlap metrics
# ---------------------------------------------------------------------------------------------

def bleu_tokens(text) -> Column:
    return tokens(F.lower(_c(text)), BLEU_TOKEN_RE)


def rouge_tokens(text) -> Column:
    return tokens(F.lower(_c(text)), ROUGE_TOKEN_RE)


def bigrams(tok: Column) -> Column:
    """Adjacent token pairs joined by one space (tokens never hold a space)."""
    nxt = F.slice(tok, 2, F.greatest(F.size(tok) - 1, F.lit(0)))
    return F.filter(F.zip_with(tok, nxt, lambda a, b: F.concat(a, F.lit(" "), b)),
                    lambda g: g.isNotNull())
