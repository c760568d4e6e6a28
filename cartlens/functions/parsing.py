"""Catalogue text parsing as column expressions.

ANSI mode is on by default in Spark 4, so every cast of untrusted text is a
``try_cast`` and array access is guarded by the array size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the catalogue cleaner.
UNKNOWN_NAME = "Unknown Product"
UNKNOWN_BRAND = "Unknown"
DEFAULT_PRICE = 999.0
DEFAULT_RATING = 3.5
RATING_MIN, RATING_MAX = 1.0, 5.0
PRICE_PATTERN = r"(\d+\.?\d*)"
NO_BRAND = ("Unknown", "nan")


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` only removes spaces)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def price_number(text: Column) -> Column:
    """Drop thousands separators, take the first number; no number -> null."""
    raw = F.regexp_extract(F.replace(F.coalesce(text, F.lit("nan")), F.lit(","), F.lit("")), PRICE_PATTERN, 1)
    return F.when(raw == "", F.lit(None).cast("double")).otherwise(raw.try_cast("double"))


def rating_number(text: Column) -> Column:
    """C4: parse, default 3.5, clip to [1, 5]."""
    parsed = F.coalesce(text.try_cast("double"), F.lit(DEFAULT_RATING))
    return F.least(F.greatest(parsed, F.lit(RATING_MIN)), F.lit(RATING_MAX))


def tree_parts(tree: Column) -> Column:
    """``["A >> B"]`` -> ["A ", " B"]; a missing tree is the text ``nan``."""
    return F.split(F.translate(F.coalesce(tree, F.lit("nan")), '"[]', ""), ">>")


def main_category(tree: Column) -> Column:
    """First part of the tree, stripped."""
    return strip(F.element_at(tree_parts(tree), 1))


def sub_category(tree: Column) -> Column:
    """Second part of the tree, else the first (index guarded: ANSI array access raises)."""
    parts = tree_parts(tree)
    return strip(F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.element_at(parts, 1)))
