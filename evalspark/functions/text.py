"""String column functions (T1, T2, L1, L10, L14 helpers).

All are built-in Catalyst expressions (whole-stage codegen, no Python).
Regexes use ``\\s`` = ASCII whitespace, the class Spark (Java) and DuckDB (RE2)
share.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the header-tag pattern of the clean-prompt variant (a bracketed
# tag and the whitespace after it), and the characters stripped after an
# activity prefix.
HEADER_TAG = r"\[[^\]]+\]\s*"
ACTIVITY_SEPARATORS = " :-"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Both-side whitespace trim (Spark's ``trim`` removes spaces only)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def lstrip_ws(c) -> Column:
    return F.regexp_replace(_c(c), r"^\s+", "")


def strip_artifacts(ctx, activity) -> Column:
    """Drop every ``[...]`` tag (and following whitespace), trim; then if the
    text starts case-insensitively with a non-empty activity, drop that prefix and
    the ``' :-'`` characters after it."""
    cleaned = strip_ws(F.regexp_replace(_c(ctx), HEADER_TAG, ""))
    act = F.coalesce(_c(activity), F.lit(""))
    rest = F.regexp_replace(F.substring(cleaned, F.length(act) + 1, F.lit(1 << 30)), r"^[ :\-]+", "")
    return F.when((F.length(act) > 0) & F.startswith(F.lower(cleaned), F.lower(act)), rest).otherwise(cleaned)


def as_continuation(ending) -> Column:
    """Exactly one leading space, then the left-trimmed ending."""
    return F.concat(F.lit(" "), lstrip_ws(ending))


def words(text) -> Column:
    """Whitespace tokens of a string (empty string → empty array)."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"\s+"), lambda x: x != "")


def word_count(text) -> Column:
    """L1: number of whitespace tokens."""
    return F.size(words(text))


def truncate_at_stops(text, stops) -> Column:
    """Cut ``text`` at each stop string in list order, each on the already-cut text.

    An empty stop string cuts everything (the text before position 0).
    """
    return F.aggregate(
        F.coalesce(_c(stops), F.array().cast("array<string>")),
        _c(text),
        lambda t, s: F.when(s == "", F.lit("")).otherwise(F.call_function("substring_index", t, s, F.lit(1))),
    )


# Fixed value: ASCII punctuation (Python's string.punctuation).
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normalise_answer(c) -> Column:
    """L14 normaliser: lower-case, drop leading whitespace, drop ASCII punctuation."""
    no_punct = F.regexp_replace(F.lower(_c(c)), r"[!-/:-@\[-`{-~]", "")
    return lstrip_ws(no_punct)
