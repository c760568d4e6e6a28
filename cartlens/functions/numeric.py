"""Rounding and safe arithmetic.

Rounding a double to 4 places is not portable across engines at exact
half-way points, so blends of already-rounded scores run in DECIMAL(18,4) /
DECIMAL(18,8) arithmetic and are cast back to double only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC4 = "decimal(18,4)"
DEC8 = "decimal(20,8)"

# Scores are compared after rounding to this many places so that float noise
# from a different summation order cannot reorder genuinely tied candidates.
TIE_DIGITS = 10


def round4(col: Column) -> Column:
    return F.round(col, 4)


def as_dec4(col: Column) -> Column:
    return col.cast(DEC4)


def weighted_sum_dec4(a: Column, wa: float, b: Column, wb: float, input_type: str = DEC4) -> Column:
    """round(wa*a + wb*b, 4) computed exactly in decimal (inputs cast to ``input_type``), returned as double."""
    lit_a = F.lit(str(wa)).cast("decimal(10,4)")
    lit_b = F.lit(str(wb)).cast("decimal(10,4)")
    return F.round(lit_a * a.cast(input_type) + lit_b * b.cast(input_type), 4).cast("double")


def tie_key(score: Column) -> Column:
    """Score on a 1e-10 grid, for ordering only.

    ``rint(x * 1e10)`` is plain double arithmetic (``round`` on a double goes
    through BigDecimal per row) and gives the same order as rounding to 10
    places except at exact half-way points.
    """
    return F.rint(score * F.lit(10.0 ** TIE_DIGITS))


PAIR_BITS = 20


def pair_id(key: Column, place: Column) -> Column:
    """One id for (key, place): key * 2**20 + place.  A place outside 0 to 2**20 - 1 raises, so ids never collide."""
    inside = (place >= 0) & (place < (1 << PAIR_BITS))
    return F.when(inside, key * F.lit(1 << PAIR_BITS) + place).otherwise(
        F.raise_error(F.concat(F.lit("place does not fit an id: "), place.cast("string"))).cast("bigint")).cast("bigint")
