"""Text columns: numeric tokens, manifest lines, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of an ordinary number. Spark's own cast also takes ``1d`` and ``0x1p3``.
_DIGITS = r"^[-+.0-9eE]+$"
_SPECIAL = ("inf", "infinity", "nan")

#: What counts as white space at the ends of a line, the same set as the pattern ``\\s``.
WHITE_SPACE = " \t\n\r\x0b\x0c"
_LARGEST = float(2**63)


def strip(text: Column) -> Column:
    """Cut white space of any kind off both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def uncomment(line: Column) -> Column:
    """The part of a line before ``#``, without surrounding white space."""
    return strip(F.substring_index(line, "#", 1))


def split_words(text: Column) -> Column:
    """Split stripped text on white space.

    Most lines have single blanks only, which plain substring searches show; those are split
    without a pattern, several times faster.
    """
    odd = F.contains(text, F.lit("  "))
    for mark in WHITE_SPACE.replace(" ", ""):
        odd = odd | F.contains(text, F.lit(mark))
    return F.when(odd, F.split(text, r"\s+")).otherwise(F.split(text, " "))


def to_number(token: Column) -> Column:
    """Parse one token; NULL when it is not a number."""
    word = F.lower(token)
    named = F.when(word.isin(*_SPECIAL, *[sign + w for w in _SPECIAL for sign in "+-"]), word)
    special = F.when(F.endswith(named, F.lit("nan")), F.lit(float("nan"))).otherwise(
        named.try_cast("double")
    )
    return F.when(token.rlike(_DIGITS), token.try_cast("double")).otherwise(special)


def is_whole(value: Column) -> Column:
    """True for finite doubles without a fraction that fit a 64-bit integer."""
    return (~F.isnan(value)) & (F.abs(value) < F.lit(_LARGEST)) & (value == F.rint(value))


def as_label(value: Column) -> Column:
    """Truncate a finite double to a label; NULL for NaN, infinities and huge values."""
    usable = (~F.isnan(value)) & (F.abs(value) < F.lit(_LARGEST))
    return F.when(usable, value.cast("bigint"))


def without_scheme(path: Column) -> Column:
    """Drop ``scheme://host`` from a path."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")
