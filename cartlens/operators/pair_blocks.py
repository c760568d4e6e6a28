"""Blocked co-occurrence sums: the cosine / Gram pair tables without shuffling the self-join fan-out.

``similarity.cosine_pairs`` / ``item_pairs`` self-join the score triples on
the shared key and aggregate; the join materialises every (pair, shared key)
row and shuffles it for the aggregate.  Here entities are hashed into ``nb``
blocks; a triple of block x is copied to the groups (x, b >= x) as the left
side and (a < x, x) as the right side, so every block pair meets once.  In a
group, NumPy joins the two sides on the shared key (sorted + ``searchsorted``),
accumulates the sums in a dense block x block array with ``bincount`` and
emits only the non-zero pairs.  The rows shipped are ``nnz * nb`` instead of
the fan-out; ``pairs_plan_costs`` compares the two so the cheaper plan runs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY_BLOCK = 2500
EXPANSION_CHUNK = 8_000_000  # (left row, right row) matches handled per NumPy step


def _empty(with_gram: bool) -> pd.DataFrame:
    cols = {"_a": pd.Series(dtype="int64"), "_b": pd.Series(dtype="int64"), "cos": pd.Series(dtype="float64")}
    if with_gram:
        cols["gram"] = pd.Series(dtype="float64")
    return pd.DataFrame(cols)


def _kernel(with_gram: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        left = pdf[pdf["side"] == 0]
        right = left if same else pdf[pdf["side"] == 1]
        if left.empty or right.empty:
            return _empty(with_gram)
        ro = np.argsort(right["k"].to_numpy(np.int64), kind="stable")
        rk = right["k"].to_numpy(np.int64)[ro]
        re_ = right["e"].to_numpy(np.int64)[ro]
        rh = right["h"].to_numpy(np.float64)[ro]
        rr = right["r"].to_numpy(np.float64)[ro]
        lents, lcol = np.unique(left["e"].to_numpy(np.int64), return_inverse=True)
        rents, rcol = np.unique(re_, return_inverse=True)
        size = lents.size * rents.size
        cos = np.zeros(size)
        gram = np.zeros(size) if with_gram else None
        lk = left["k"].to_numpy(np.int64)
        lh = left["h"].to_numpy(np.float64)
        lr = left["r"].to_numpy(np.float64)
        lw = left["w"].to_numpy(np.float64)
        start_all = np.searchsorted(rk, lk, "left")
        cnt_all = np.searchsorted(rk, lk, "right") - start_all
        # chunk boundaries by cumulative matches, so a hot shared key cannot blow up one step
        # (a left row matches at most the block's entity count)
        cum = np.cumsum(cnt_all)
        cuts = np.searchsorted(cum, np.arange(EXPANSION_CHUNK, int(cum[-1]) + EXPANSION_CHUNK, EXPANSION_CHUNK),
                               "right") if cum.size and cum[-1] else np.array([], dtype=np.int64)
        bounds = np.unique(np.concatenate([[0], np.minimum(cuts, lk.size), [lk.size]]))
        for c0, c1 in zip(bounds[:-1], bounds[1:]):
            start, cnt = start_all[c0:c1], cnt_all[c0:c1]
            total = int(cnt.sum())
            if not total:
                continue
            rep = np.repeat(np.arange(c1 - c0), cnt)
            pidx = np.repeat(start - (np.cumsum(cnt) - cnt), cnt) + np.arange(total)
            flat = lcol[c0:c1][rep] * rents.size + rcol[pidx]
            cos += np.bincount(flat, weights=lh[c0:c1][rep] * rh[pidx], minlength=size)
            if with_gram:
                gram += np.bincount(flat, weights=lr[c0:c1][rep] * rr[pidx] * lw[c0:c1][rep], minlength=size)
        nz = np.nonzero(cos)[0]
        a = lents[nz // rents.size]
        b = rents[nz % rents.size]
        keep = a < b if same else a != b
        out = {"_a": a[keep], "_b": b[keep], "cos": cos[nz][keep]}
        if with_gram:
            out["gram"] = gram[nz][keep]
        res = pd.DataFrame(out)
        # a pair from different blocks is emitted in the orientation (smaller id, larger id)
        if not same and len(res):
            swap = res["_a"] > res["_b"]
            res.loc[swap, ["_a", "_b"]] = res.loc[swap, ["_b", "_a"]].to_numpy()
        return res
    return run


def block_count(n_entities: int, slots: int, entity_block: int = ENTITY_BLOCK) -> int:
    return max(1, math.ceil(n_entities / entity_block), int(math.isqrt(max(slots, 1) * 2)))


def blocked_pair_sums(rows: DataFrame, n_blocks: int, with_gram: bool) -> DataFrame:
    """rows: (e entity, k shared key, h, r, w) -> (_a, _b, cos = sum h*h, gram = sum r*r*w) with _a < _b."""
    blk = F.pmod(F.xxhash64("e"), F.lit(n_blocks)).cast("int")
    base = rows.withColumn("_x", blk)
    as_left = base.select(F.col("_x").alias("a"), F.explode(F.sequence(F.col("_x"), F.lit(n_blocks - 1))).alias("b"),
                          F.lit(0).alias("side"), "e", "k", "h", "r", "w")
    as_right = base.filter(F.col("_x") > 0).select(
        F.explode(F.sequence(F.lit(0), F.col("_x") - 1)).alias("a"), F.col("_x").alias("b"),
        F.lit(1).alias("side"), "e", "k", "h", "r", "w")
    schema = "_a long, _b long, cos double" + (", gram double" if with_gram else "")
    return as_left.unionByName(as_right).groupBy("a", "b").applyInPandas(_kernel(with_gram), schema=schema)


def pairs_plan_costs(train: DataFrame, entity: str, through: str, slots: int) -> dict:
    """Rows moved: the self-join fan-out (sum over shared keys of deg^2) vs triples x blocks."""
    deg = train.groupBy(through).agg(F.count(F.lit(1)).alias("_d"))
    got = deg.agg(F.sum(F.col("_d") * F.col("_d")).alias("fan"), F.sum("_d").alias("nnz")).first()
    n_ent = train.select(entity).distinct().count()
    nb = block_count(n_ent, slots)
    return {"join_rows": int(got["fan"] or 0), "blocked_rows": int((got["nnz"] or 0) * nb), "blocks": nb}
