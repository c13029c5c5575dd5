"""Scalar text functions as Column expressions (no UDFs).

All functions accept a column name or Column and return a Column.
Null policy: null in, null out, unless stated.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

# Portable forms (Java regex and RE2 give the same matches); the SQL oracle uses these.
URL_RE_PORTABLE = f"http{P.NOT_WS}+|www{P.NOT_WS}+|https{P.NOT_WS}+"
WS_RUN_RE_PORTABLE = f"{P.WS}+"
# Spark forms: the same character set written as the Unicode White_Space
# property plus U+001C..U+001F (exactly Python's str.isspace set, checked over
# the whole BMP); Java matches a property about twice as fast as a long list
# of ranges.
JAVA_WS = r"[\p{IsWhite_Space}\x{1C}-\x{1F}]"
JAVA_NOT_WS = r"[^\p{IsWhite_Space}\x{1C}-\x{1F}]"
URL_RE = f"http{JAVA_NOT_WS}+|www{JAVA_NOT_WS}+|https{JAVA_NOT_WS}+"
MENTION_RE = f"@{P.WORD}+"
WS_RUN_RE = f"{JAVA_WS}+"
TOKEN_RE = f"{P.WORD}+"
VECTOR_TOKEN_RE = f"{P.WORD}{{2,}}"
# a maximal word run made only of ASCII lowercase letters, >= 3 long: the
# same tokens as "word runs, then keep ^[a-z]{3,}$", in one regex pass
EDA_TOKEN_RE = f"(?<!{P.WORD})[a-z]{{3,}}(?!{P.WORD})"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """Drop URLs, then @mentions, collapse whitespace runs to one space, strip.

    The order matters and is kept: ``www\\S+`` is unanchored and ``@\\w+``
    also eats e-mail domains, exactly like the original rule.
    """
    c = _c(col)
    no_url = F.regexp_replace(c, URL_RE, "")
    no_mention = F.regexp_replace(no_url, MENTION_RE, "")
    return F.trim(F.regexp_replace(no_mention, WS_RUN_RE, " "))


def normalize_id(col) -> Column:
    """Id as trimmed text; ``''`` and ``'nan'`` become null.  Never via double."""
    s = F.trim(_c(col).cast("string"))
    return F.when((s == "") | (s == "nan"), F.lit(None).cast("string")).otherwise(s)


def char_length(col) -> Column:
    """Length in code points (same as Python ``len``)."""
    return F.length(_c(col)).cast("long")


def truncate(col, n: int) -> Column:
    return F.substring(_c(col), 1, n)


def is_blank(col) -> Column:
    """True for null or whitespace-only text."""
    c = _c(col)
    return c.isNull() | (F.trim(c) == "")


def blank_to_null(col) -> Column:
    c = _c(col)
    return F.when(F.trim(c) == "", F.lit(None).cast("string")).otherwise(c)


def word_runs(col) -> Column:
    """Maximal runs of word characters of the lowercased text."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_RE), F.lit(0))


def eda_tokens(col) -> Column:
    """Lowercase ASCII words of >= 3 letters, delimited like ``\\b`` does.

    A word run containing any non-ASCII letter, digit or ``_`` yields nothing
    (``éclair`` gives no token), as the original ``\\b[a-z]{3,}\\b`` does.
    """
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(EDA_TOKEN_RE), F.lit(0))


def adjacent_pairs(tokens) -> Column:
    """Array of ``struct(w1, w2)`` for adjacent tokens; fewer than 2 -> empty.

    ``tokens`` should be a materialised array column: the pairs are built by
    zipping two slices, so the array expression is referenced a few times.
    """
    t = _c(tokens)
    m = F.greatest(F.size(t) - 1, F.lit(0))
    # arrays_zip is a native expression (no interpreted lambda)
    return F.arrays_zip(F.slice(t, 1, m).alias("w1"), F.slice(t, 2, m).alias("w2"))


def vector_unigrams(col) -> Column:
    """Tokens of >= 2 word characters on the lowercased text."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(VECTOR_TOKEN_RE), F.lit(0))


def joined_bigrams(tokens) -> Column:
    """Space-joined adjacent pairs of a materialised token array column."""
    t = _c(tokens)
    m = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, m), F.slice(t, 2, m), lambda a, b: F.concat(a, F.lit(" "), b))


def vector_terms(unigrams, ngram_max: int = 2) -> Column:
    """Unigrams followed by space-joined bigrams (when ``ngram_max`` is 2);
    ``unigrams`` is a materialised column of :func:`vector_unigrams`."""
    uni = _c(unigrams)
    if ngram_max == 1:
        return uni
    return F.concat(uni, joined_bigrams(uni))


def has_non_ascii(col) -> Column:
    return _c(col).rlike(P.NON_ASCII)


def looks_non_english(col, require_letter: bool = True) -> Column:
    """Contains non-ASCII; with ``require_letter`` also a Latin/CJK letter
    (drops pure emoji/punctuation).  Null -> false."""
    c = _c(col)
    cond = F.coalesce(c.rlike(P.NON_ASCII), F.lit(False))
    if require_letter:
        cond = cond & F.coalesce(c.rlike(P.LATIN_OR_CJK_LETTER), F.lit(False))
    return cond


def hint_coalesce(v2, v1) -> Column:
    """v2 if it is non-blank, else v1 if non-blank, else ''."""
    a, b = _c(v2), _c(v1)
    return (F.when(F.trim(a) != "", a)
            .when(F.trim(b) != "", b)
            .otherwise(F.lit("")))


_LITERAL = re.compile(r"^[a-z0-9 '%!,-]+$")


def contains_words(col, alternation: str) -> Column:
    """Case-insensitive ``\\b(alternation)\\b`` test on the text; null -> false.

    The text is lowercased and the alternation must be lowercase.  When every
    alternative is a plain word or phrase, a literal substring test runs
    first and the boundary regex only on texts that contain one of them (a
    regex match implies the substring, so the result is unchanged).
    """
    lo = F.lower(_c(col))
    match = lo.rlike(P.words(alternation))
    alts = alternation.split("|")
    if all(_LITERAL.match(a) for a in alts):
        match = F.when(contains_any(lo, alts), match).otherwise(F.lit(False))
    return F.coalesce(match, F.lit(False))


def contains_any(col, needles: list[str]) -> Column:
    """Plain substring test for any of ``needles`` (already lowercase)."""
    c = _c(col)
    cond = F.lit(False)
    for s in needles:
        cond = cond | c.contains(s)
    return cond


def count_contained(col, needles: list[str]) -> Column:
    """How many of ``needles`` occur as substrings."""
    c = _c(col)
    total = F.lit(0)
    for s in needles:
        total = total + F.when(c.contains(s), 1).otherwise(0)
    return total


def hash_order(key, seed: int | str) -> Column:
    """Replayable pseudo-random order key: ``md5('<seed>:' || key)``.

    Same value in Spark and DuckDB, independent of partitioning.
    """
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def fill_template(template: str, **fields) -> Column:
    """A message template with {placeholders} filled from Columns."""
    return F.concat(*[F.lit(v) if kind == "text" else _c(fields[v]).cast("string")
                      for kind, v in P.template_parts(template)])
