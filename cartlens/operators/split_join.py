"""Degree-split equi-join: a join whose largest unit of work is bounded in rows, whatever the keys' degrees.

In an equi-join all rows of a key meet in one task, and a key with l rows on one side and r on the other gives l * r
results there.  ``split_join`` deals the rows of a key that is above a bound to a grid: the left rows to ceil(l / bound)
strips, the right ones to ceil(r / bound), and each cell of the grid is a join key of its own.  A left row is copied once
for each right strip and the other way round, so l * r results cost about 2 * l * r / bound further rows; keys
below the bound, the bulk, are not copied at all.  Degrees are one partial aggregate on each side, and only the keys
above the bound are joined back to the rows.

It stays a plain sort-merge or hash join for Catalyst, and aggregates on top of it sum partially before their exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_BOUND = 4_096
_ROW, _COL = "_strip_row", "_strip_col"


def heavy_keys(left: DataFrame, right: DataFrame, key: str, bound: int = ROW_BOUND) -> DataFrame:
    """(key, _rows, _cols): strips of the keys that have more than ``bound`` rows on a side and any on the other."""
    n_left = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l"))
    n_right = right.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    both = n_left.join(n_right, key).where((F.col("_l") > bound) | (F.col("_r") > bound))
    strips = lambda c: F.ceil(F.col(c) / F.lit(float(bound))).cast("int")
    return both.select(key, strips("_l").alias("_rows"), strips("_r").alias("_cols"))


def _strip(df: DataFrame, key: str, n: str) -> Column:
    others = [c for c in df.columns if c not in (key, "_rows", "_cols")]
    return F.pmod(F.xxhash64(*others), F.coalesce(n, F.lit(1))).cast("int")


def dealt(left: DataFrame, right: DataFrame, key: str, bound: int = ROW_BOUND) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell (_strip_row, _strip_col) of each row; rows of heavy keys once per strip of the other side."""
    heavy = heavy_keys(left, right, key, bound)

    def side(df: DataFrame, own: str, n: str, other: str, m: str) -> DataFrame:
        got = df.join(heavy, key, "left")
        copies = F.sequence(F.lit(0), F.coalesce(m, F.lit(1)) - 1)
        return got.withColumn(own, _strip(got, key, n)).withColumn(other, F.explode(copies)).drop("_rows", "_cols")

    return side(left, _ROW, "_rows", _COL, "_cols"), side(right, _COL, "_cols", _ROW, "_rows")


def split_join(left: DataFrame, right: DataFrame, key: str, bound: int = ROW_BOUND) -> DataFrame:
    """Inner join of ``left`` and ``right`` on ``key``, no cell of which has more than about ``bound`` rows a side.

    Null keys meet nothing, as in any equi-join.  Rows equal in all columns fall into one strip.
    """
    a, b = dealt(left, right, key, bound)
    return a.join(b, [key, _ROW, _COL]).drop(_ROW, _COL)
