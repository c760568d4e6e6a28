"""Operator 4: jump consistent hashing.

A stable 64-bit key is mapped to one of n shards by a pseudo-random walk over the shard counts at which the key moves
(Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm", 2014).  No ring table is kept; going from n to
n + 1 shards moves a row only into the new shard, with chance 1 / (n + 1).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import free_name, running, stored, table

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; vectorised over the keys that still jump."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    nxt = np.zeros(len(state), np.int64)
    while len(live):
        shard[live] = nxt[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        nxt[live] = ((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[nxt[live] < shards]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """Column of shards for a 64-bit key column."""

    @F.pandas_udf("int")
    def shard_of(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return shard_of(key)


def assign_shards(df: DataFrame, key: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (with one shard more).

    The key columns are hashed to 64 bits first, since plain ids are no random keys.  Rows with equal keys share a
    shard; a null key is a key like any other.  All columns and rows of ``df`` stay; a column already called ``shard``
    or ``grown_shard`` is replaced.  An empty table gives an empty table.
    """
    k = free_name(df, "jump_key")
    keyed = df.withColumn(k, F.xxhash64(*[F.col(c) for c in key]))
    return (keyed.withColumn("shard", jump_shard(F.col(k), shards))
            .withColumn("grown_shard", jump_shard(F.col(k), shards + 1)).drop(k))


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards by its doc_id (law ``key``), with its place there.

    Null text counts as empty: size 1, CRC 0.  ``slot`` is gapless in each shard; its order is a hash order.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    dealt = stored(assign_shards(sized, ["doc_id"]), "shards")
    out = running(dealt, ["shard"], ["doc_id"], F.lit(1), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), "grown_shard")
