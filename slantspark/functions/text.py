"""String scalar functions T1-T14 as native Column expressions (no UDFs).

All of these are single-row, codegen'd expressions: they run inside the scan
stage, need no shuffle and scale linearly with the text volume.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slantspark.functions import patterns as P


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- feature-path cleaning (T1-T6) ----------------------------------------------

def collapse_whitespace(col) -> Column:
    """Every run of Unicode whitespace becomes one space."""
    return F.regexp_replace(_c(col), P.WS_RUN, " ")


def strip_urls(col) -> Column:
    """Remove http(s) URLs (reference character set, see patterns.URL)."""
    return F.regexp_replace(_c(col), P.URL, "")


def trim_spaces(col) -> Column:
    """After T1 only U+0020 can be left at the edges."""
    return F.trim(_c(col))


def strip_tags_or_urls(col) -> Column:
    """T4: remove ``<...>`` (non-greedy, single line) or a URL."""
    return F.regexp_replace(_c(col), P.TAG_OR_URL_JAVA, "$1")


def lowercase(col) -> Column:
    """T5."""
    return F.lower(_c(col))


def preprocess_features(col) -> Column:
    """T1 -> T2 -> T3 -> T4 -> T5 (order matters: trim runs before tag removal)."""
    return lowercase(strip_tags_or_urls(trim_spaces(strip_urls(collapse_whitespace(col)))))


# --- text-classifier cleaning (T7-T13) ----------------------------------------

def dl_strip_urls(col) -> Column:
    """``http`` followed by any non-space run."""
    return F.regexp_replace(_c(col), P.DL_URL, "")


def dl_strip_tags(col) -> Column:
    """T8."""
    return F.regexp_replace(_c(col), P.DL_TAG_JAVA, "$1")


def dl_strip_punctuation(col) -> Column:
    """Drop everything that is neither a word character nor whitespace."""
    return F.regexp_replace(_c(col), P.DL_PUNCT, "")


def dl_lower_strip(col) -> Column:
    """Lowercase, then strip Unicode whitespace at both ends (newlines survive inside)."""
    return F.btrim(F.lower(_c(col)), F.lit(P.WS_CHARS))


def dl_strip_brackets(col) -> Column:
    """``[...]`` removal.  A no-op after T9 (brackets are gone); kept for callers
    that use it on other text."""
    return F.regexp_replace(_c(col), P.BRACKETS, "")


def dl_strip_dots(col) -> Column:
    """Dot removal; also a no-op after T9."""
    return F.replace(_c(col), F.lit("."), F.lit(""))


def preprocess_text_classifier(col) -> Column:
    """T7 -> T8 -> T9 -> T10.  T11/T12 cannot change T9 output and are skipped."""
    return dl_lower_strip(dl_strip_punctuation(dl_strip_tags(dl_strip_urls(col))))


# --- prediction string (T14) -------------------------------------------------

def format_prediction(label: Column | str, probability: Column | str) -> Column:
    """``label,p0,p1,...`` with probabilities (an array of doubles) in class order."""
    probs = F.transform(_c(probability), lambda p: p.cast("string"))
    return F.concat_ws(",", _c(label), F.array_join(probs, ","))
