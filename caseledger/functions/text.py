"""Text expressions. All stay inside the JVM but for the one Unicode fold."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from caseledger import rules

# Python's notion of white space; Spark's trim() takes blanks only.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_VISIBLE = r"(?U)[^\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def has_content(text: Column) -> Column:
    """True when some character is not white space; null counts as empty."""
    return F.coalesce(text.rlike(_VISIBLE), F.lit(False))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def default_if_missing(value: Column, default: str) -> Column:
    """Null and the empty string both count as missing."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def null_if_spelled(value: Column) -> Column:
    """The opposite direction: any spelling of "missing" becomes null."""
    return F.when(~value.isin(*rules.NULL_SPELLINGS), value)


def drop_control_chars(text: Column) -> Column:
    return F.regexp_replace(text, rules.CONTROL_CHARACTERS, "")


def cut(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def cut_with_dots(text: Column, size: int = 80) -> Column:
    shortened = F.concat(F.substring(text, 1, size - 3), F.lit("..."))
    return F.when(F.length(text) > size, shortened).otherwise(text)


def join_non_empty(parts: Column, separator: str) -> Column:
    """Join an array of strings; an empty or null array gives null."""
    return F.when(F.size(parts) > 0, F.array_join(parts, separator))


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, then everything outside ASCII is dropped."""
    folded = text.str.normalize("NFKD").str.encode("ascii", "ignore")
    return folded.str.decode("ascii")


def fold_to_ascii(text: Column) -> Column:
    """ASCII texts stay as they are, without a way through Python; see ``_decomposed``."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _decomposed(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def words(text: Column) -> Column:
    """Lower-case ASCII words of three or more letters, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(rules.PLAIN_WORD), F.lit(0))


def word_tokens(text: Column) -> Column:
    """All words in lower case: runs of letters, digits and underscores."""
    pieces = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.filter(pieces, lambda p: p != "")


def long_enough(terms: Column) -> Column:
    """Terms of more than two characters, spaces around them not counted."""
    return F.filter(terms, lambda t: F.length(F.trim(t)) > 2)


def keyword_occurrences(text: Column) -> Column:
    """Capitalised phrases (case kept) and plain words, as often as they occur.

    Finds of two letters (``At``) are left out.
    """
    phrases = F.regexp_extract_all(text, F.lit(rules.CAPITALISED_PHRASE), F.lit(0))
    return F.concat(long_enough(phrases), words(text))


def keyword_candidates(text: Column) -> Column:
    """The same, each once."""
    return F.array_distinct(keyword_occurrences(text))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
