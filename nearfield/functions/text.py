"""Token and string expressions shared by the corpus, lexical and analysis jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Unicode, plus the four ASCII separators that
# Python splits at as well, and what counts as a word.
SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITESPACE = f"[{SPACE}]+"
WORD = r"[\p{L}\p{N}]+"


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, WHITESPACE), lambda t: t != "")


def more_tokens_than(text: Column, n: int) -> Column:
    """Whether a text has more than ``n`` white-space tokens; the matcher stops once that is settled."""
    if n == 0:
        return text.rlike(f"[^{SPACE}]")
    return text.rlike(f"^[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{{n}}}[^{SPACE}]")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def keyword(value: Column, ignore_above: int = 256) -> Column:
    """Exact value, or null when it is longer than the limit."""
    return F.when(F.length(value) <= ignore_above, value)


def possessive(token: Column) -> Column:
    return F.regexp_replace(token, "['’\\x{FF07}][sS]$", "")


def minimal_stem(token: Column) -> Column:
    """English plural stemmer: ies to y, s dropped, us/ss and vowel+es kept."""
    return (
        F.when((F.length(token) < 3) | ~token.endswith("s"), token)
        .when(token.rlike("[us]s$"), token)
        .when(token.rlike("[^ae]ies$"), F.concat(token.substr(F.lit(1), F.length(token) - 3), F.lit("y")))
        .when(token.rlike("[iaoe]es$"), token)
        .otherwise(token.substr(F.lit(1), F.length(token) - 1))
    )
