"""Blocked evaluation of the CF scorers for many users at once (R5, R6, R10b lists).

Same scores as ``cf.cf_scores`` + ``cf.ranked_lists``, without shuffling the
(history row x neighbour) fan-out.  The work is cut into (user block, item
block) groups:

- a group receives the histories of its users (``h = r/|u|`` and ``r``) and
  the pair rows ``(j, i, cos, gram)`` whose target item ``i`` lies in its
  item block and whose source item ``j`` occurs in its user block;
- inside the group, NumPy expands history rows against the pair rows of
  their item (sorted by ``j``, found with ``searchsorted``) and accumulates
  the user x item scores with ``bincount``, a few hundred users at a time;
- seen items are zeroed before the per-row top-k, so no candidate is lost;
- the per-item-block top-k lists are merged with ``row_number() <= k``.

Block counts follow the data size (``hist_per_group``, ``pairs_per_group``),
so a group's input stays bounded however large the tables grow; a pair row is
copied once per user block that needs it (at most the user-block count).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartlens.functions.numeric import tie_key
from cartlens.operators.blocks import topk_positive
from cartlens.operators.similarity import with_norm

OUT_SCHEMA = "list string, user_id long, product_id long, score double"
USER_CHUNK = 1024
EXPANSION_CHUNK = 16_000_000


def _empty():
    return pd.DataFrame({"list": pd.Series(dtype="object"), "user_id": pd.Series(dtype="int64"),
                         "product_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})


def _top(name, s, users, items, k, out):
    if k <= 0 or s.size == 0:
        return
    r, c = topk_positive(s, k)  # items are sorted ascending: ties go to the lower id
    if r.size:
        out.append(pd.DataFrame({"list": name, "user_id": users[r], "product_id": items[c], "score": s[r, c]}))


def _kernel(k_user: int, k_item: int, k_blend: int, uw: float, iw: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hist = pdf[pdf["kind"] == 0]
        pairs = pdf[pdf["kind"] == 1]
        if hist.empty or pairs.empty:
            return _empty()
        order = np.argsort(pairs["j"].to_numpy(np.int64), kind="stable")
        pj = pairs["j"].to_numpy(np.int64)[order]
        pi = pairs["i"].to_numpy(np.int64)[order]
        pc = pairs["cos"].to_numpy(np.float64)[order]
        pg = pairs["gram"].to_numpy(np.float64)[order]
        items = np.unique(pi)
        col = np.searchsorted(items, pi)
        n_items = items.size

        hu = hist["u"].to_numpy(np.int64)
        horder = np.argsort(hu, kind="stable")
        hu, hj = hu[horder], hist["j"].to_numpy(np.int64)[horder]
        hr, hh = hist["r"].to_numpy(np.float64)[horder], hist["h"].to_numpy(np.float64)[horder]
        users, ustart = np.unique(hu, return_index=True)
        uend = np.append(ustart[1:], hu.size)
        out: list = []
        # per-user match counts decide the chunks: at most USER_CHUNK users and about
        # EXPANSION_CHUNK (history row x pair row) matches per NumPy step
        start_all = np.searchsorted(pj, hj, "left")
        cnt_all = np.searchsorted(pj, hj, "right") - start_all
        per_user = np.add.reduceat(cnt_all, ustart) if ustart.size else np.array([], dtype=np.int64)
        chunks, c0, acc = [], 0, 0
        for u_i, m in enumerate(per_user):
            if u_i > c0 and (u_i - c0 >= USER_CHUNK or acc + m > EXPANSION_CHUNK):
                chunks.append((c0, u_i))
                c0, acc = u_i, 0
            acc += m
        if users.size:
            chunks.append((c0, users.size))
        for c0, c1 in chunks:
            cu = users[c0:c1]
            lo, hi = ustart[c0], uend[c1 - 1]
            row_user = np.searchsorted(cu, hu[lo:hi])
            j, r, h = hj[lo:hi], hr[lo:hi], hh[lo:hi]
            start, cnt = start_all[lo:hi], cnt_all[lo:hi]
            total = int(cnt.sum())
            nu = cu.size
            su = np.zeros(nu * n_items)
            si = np.zeros(nu * n_items)
            if total:
                rep = np.repeat(np.arange(j.size), cnt)
                first = np.cumsum(cnt) - cnt
                pidx = np.repeat(start - first, cnt) + np.arange(total)
                flat = row_user[rep] * n_items + col[pidx]
                su = np.bincount(flat, weights=h[rep] * pg[pidx], minlength=nu * n_items)
                si = np.bincount(flat, weights=r[rep] * pc[pidx], minlength=nu * n_items)
            su = su.reshape(nu, n_items)
            si = si.reshape(nu, n_items)
            # zero the user's own items (seen) that fall in this item block
            sc = np.searchsorted(items, j)
            ok = sc < n_items
            ok[ok] = items[sc[ok]] == j[ok]
            su[row_user[ok], sc[ok]] = 0.0
            si[row_user[ok], sc[ok]] = 0.0
            _top("user", su, cu, items, k_user, out)
            _top("item", si, cu, items, k_item, out)
            if k_blend > 0:
                _top("blend", uw * su + iw * si, cu, items, k_blend, out)
        return pd.concat(out, ignore_index=True) if out else _empty()
    return run


def blocked_lists(train: DataFrame, pairs: DataFrame, k_user: int, k_item: int, k_blend: int = 0,
                  user_weight: float = 0.5, item_weight: float = 0.5, users: DataFrame | None = None,
                  hist_per_group: int = 2_000_000, pairs_per_group: int = 2_000_000,
                  min_item_blocks: int | None = None) -> DataFrame:
    """(list, user_id, product_id, score, rank) with the same content as ``cf.ranked_lists``."""
    spark = train.sparkSession
    hist = train.select("user_id", "product_id", "score")
    if users is not None:
        hist = hist.join(users.select("user_id").distinct(), "user_id", "left_semi")
    hist = with_norm(hist, "user_id", "_un").select(
        F.col("user_id").alias("u"), F.col("product_id").alias("j"), F.col("score").alias("r"),
        (F.col("score") / F.col("_un")).alias("h"))
    n_hist = hist.count()
    n_pairs = pairs.count()
    nb_a = max(1, math.ceil(n_hist / hist_per_group))
    floor_b = min_item_blocks or spark.sparkContext.defaultParallelism
    nb_b = max(floor_b, math.ceil(n_pairs / pairs_per_group))

    ublk = F.pmod(F.xxhash64("u"), F.lit(nb_a)).cast("int")
    hist_rows = hist.select(ublk.alias("a"), F.explode(F.sequence(F.lit(0), F.lit(nb_b - 1))).alias("b"),
                            F.lit(0).alias("kind"), "u", "j", "r", "h",
                            F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("cos"),
                            F.lit(None).cast("double").alias("gram"))
    p = pairs.select(F.col("product_id").alias("j"), F.col("other_product_id").alias("i"), "cos", "gram")
    if nb_a == 1:
        p = p.withColumn("a", F.lit(0))
    else:
        # only the user blocks that hold a history row of j need j's pairs
        need = hist.select(ublk.alias("a"), "j").distinct()
        p = p.join(need, "j", "inner")
    pair_rows = p.select("a", F.pmod(F.xxhash64("i"), F.lit(nb_b)).cast("int").alias("b"), F.lit(1).alias("kind"),
                         F.lit(None).cast("bigint").alias("u"), "j", F.lit(None).cast("double").alias("r"),
                         F.lit(None).cast("double").alias("h"), "i", "cos", "gram")
    cand = hist_rows.unionByName(pair_rows).groupBy("a", "b").applyInPandas(
        _kernel(k_user, k_item, k_blend, user_weight, item_weight), schema=OUT_SCHEMA)
    w = Window.partitionBy("list", "user_id").orderBy(tie_key(F.col("score")).desc(), F.col("product_id").asc())
    k_max = max(k_user, k_item, k_blend)
    ranked = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k_max)
    limit = (F.when(F.col("list") == "user", F.lit(k_user))
             .when(F.col("list") == "item", F.lit(k_item)).otherwise(F.lit(k_blend)))
    return ranked.filter(F.col("rank") <= limit)


def plan_costs(train: DataFrame, pairs: DataFrame, hist_per_group: int = 2_000_000,
               pairs_per_group: int = 2_000_000, min_item_blocks: int | None = None) -> dict:
    """Rows each CF plan moves, from small aggregates (one row per item).

    join plan: the (history row x neighbour) fan-out = sum over items j of deg(j) * nbrs(j).
    blocked plan: history rows copied once per item block plus pair rows copied
    once per user block.
    """
    deg = train.groupBy("product_id").agg(F.count(F.lit(1)).alias("_d"))
    nbr = pairs.groupBy("product_id").agg(F.count(F.lit(1)).alias("_p"))
    fan = deg.join(nbr, "product_id", "inner").agg(F.sum(F.col("_d") * F.col("_p")).alias("f")).first()["f"] or 0
    n_hist = train.count()
    n_pairs = pairs.count()
    nb_a = max(1, math.ceil(n_hist / hist_per_group))
    nb_b = max(min_item_blocks or train.sparkSession.sparkContext.defaultParallelism,
               math.ceil(n_pairs / pairs_per_group))
    return {"join_rows": int(fan), "blocked_rows": int(n_hist * nb_b + n_pairs * nb_a)}


def cf_lists(train: DataFrame, pairs: DataFrame, k_user: int, k_item: int, k_blend: int = 0,
             user_weight: float = 0.5, item_weight: float = 0.5, hot_user_rows: int = 200_000,
             blocked_advantage: float = 3.0, users: DataFrame | None = None, **block_args) -> DataFrame:
    """Ranked CF lists for every train user, choosing the plan by the rows it moves.

    The blocked plan copies history rows once per item block, so at very large
    pair tables the all-join plan (whose cost is the fan-out) is cheaper; the
    blocked rows are processed vectorised, hence ``blocked_advantage``.  In
    the blocked plan a user whose history alone exceeds ``hot_user_rows``
    would make one group arbitrarily large, so such users go through the
    all-join plan, whose fan-out is spread by item and aggregated by (user,
    item).  Both plans are exact, so any mix equals either plan alone.
    ``users`` scores a cohort only (its histories are semi-joined before any fan-out).
    """
    from cartlens.operators.cf import cf_scores, ranked_lists
    costs = plan_costs(train, pairs, **{k: v for k, v in block_args.items()
                                        if k in ("hist_per_group", "pairs_per_group", "min_item_blocks")})
    if costs["blocked_rows"] * blocked_advantage > costs["join_rows"]:
        return ranked_lists(cf_scores(train, pairs, users=users), k_user, k_item, k_blend, user_weight, item_weight)
    scored = train if users is None else train.join(users.select("user_id").distinct(), "user_id", "left_semi")
    sizes = scored.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.filter(F.col("_n") > hot_user_rows).select("user_id")
    if hot.limit(1).count() == 0:
        return blocked_lists(train, pairs, k_user, k_item, k_blend, user_weight, item_weight, users=users,
                             **block_args)
    light = sizes.filter(F.col("_n") <= hot_user_rows).select("user_id")
    a = blocked_lists(train, pairs, k_user, k_item, k_blend, user_weight, item_weight, users=light, **block_args)
    b = ranked_lists(cf_scores(train, pairs, users=hot), k_user, k_item, k_blend, user_weight, item_weight)
    return a.unionByName(b.select(*a.columns))
