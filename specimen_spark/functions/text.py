"""Column helpers for text: trimming, emptiness, null-safe matching, name predicates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from specimen_spark import rules

WHITESPACE = " \t\r\n"


def trimws(c) -> Column:
    """Trim spaces, tabs and line ends (plain ``trim`` drops spaces only)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def blank_to_null(c) -> Column:
    trimmed = trimws(c)
    return F.when(trimmed != "", trimmed)


def is_blank(c) -> Column:
    """Null or the empty string; never null itself."""
    c = _col(c)
    return c.isNull() | (c == "")


def not_blank(c) -> Column:
    c = _col(c)
    return c.isNotNull() & (c != "")


def is_empty(c) -> Column:
    """Empty for scoring: null, blank after trimming, or the words None / NA in any case."""
    c = _col(c)
    return c.isNull() | F.upper(trimws(c)).isin("", "NONE", "NA")


def matches(c, pattern: str, ignore_case: bool = False) -> Column:
    """Regex search that is false, not null, on null. Nothing else calls ``rlike``."""
    return F.coalesce(_col(c).rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def title_first(c) -> Column:
    """Trim and upper-case the first letter."""
    t = trimws(c)
    return F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))


def is_binomial(c="species") -> Column:
    return not_blank(c) & matches(c, rules.BINOMIAL)


def has_valid_name(c="species") -> Column:
    """Validator name test: unanchored ``sp.``, case matters."""
    return not_blank(c) & ~matches(c, rules.VALID_NAME_REJECT)


def import_name(c="species") -> Column:
    """Import cleaning: trimmed, null when blank or not a full name; case matters."""
    t = trimws(c)
    return F.when((t != "") & ~matches(t, rules.IMPORT_NAME_REJECT), t)


def strip_html(c) -> Column:
    """Drop tags. The cheap ``contains`` test keeps the regex off the usual value."""
    c = _col(c)
    return F.when(c.contains("<"), F.regexp_replace(c, "<[^>]+>", "")).otherwise(c)


def count_distinct_null_as_value(c) -> Column:
    """Aggregate: distinct values where null counts as one more value."""
    c = _col(c)
    return F.count_distinct(c) + F.coalesce(F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0))


def count_true(c) -> Column:
    return F.count_if(_col(c))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
