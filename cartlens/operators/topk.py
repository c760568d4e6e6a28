"""Per-key and global top-k with one tie rule for the whole engine.

Ties: ``round(score, 10) desc, id asc``.  ``row_number() <= k`` over a
partitioned window compiles to a partial ``WindowGroupLimit`` before the
shuffle and a final one after it, so whole groups are never shipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartlens.functions.numeric import tie_key


def top_k_per_key(df: DataFrame, key_cols, score_col: str, id_col: str, k: int,
                  rank_col: str = "rank") -> DataFrame:
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    w = Window.partitionBy(*keys).orderBy(tie_key(F.col(score_col)).desc(), F.col(id_col).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def top_k(df: DataFrame, score_col: str, id_col: str, k: int, rank_col: str = "rank") -> DataFrame:
    """Global top-k: a bounded ``TakeOrderedAndProject`` (each task keeps k rows)."""
    ordered = df.orderBy(tie_key(F.col(score_col)).desc(), F.col(id_col).asc()).limit(k)
    # k rows only: numbering them in one partition is free
    w = Window.orderBy(tie_key(F.col(score_col)).desc(), F.col(id_col).asc())
    return ordered.withColumn(rank_col, F.row_number().over(w))
