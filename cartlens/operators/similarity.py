"""Cosine similarity over the sparse score matrix (R1-R4) and the shared item-pair table.

Rows are L2-normalised *before* the self-join (as the reference's cosine
routine does), so each similarity is a plain ``sum(a*b)`` with no norm joins
on the pair table afterwards.  Only pairs with ``a < b`` are aggregated and
the result is mirrored, which halves the aggregation work.  The self-join
fan-out is ``sum over keys of deg^2``; it is never shuffled as rows of pairs.
By default nothing is sent at all: the sparse rows are written once, and groups
of entities read all rows past their own (``streamed``), where a row gives the
complete sums of its pairs.  In the join plan each entry meets its key's other
entries as arrays (``fan_out``), is sent once to the task of its entity, and is
spread and summed there; the rows of a hot key are dealt to a grid of cells
(``split_join``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.operators import streamed as st
from cartlens.operators.split_join import split_join
from cartlens.operators.topk import top_k_per_key
from cartlens.session import materialised


def with_norm(train: DataFrame, by: str, out: str) -> DataFrame:
    """Attach the L2 norm of ``by``'s score vector (one aggregate, joined back on ``by``)."""
    norms = train.groupBy(by).agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias(out))
    return train.join(norms, by, "inner")


PIECE_ENTRIES = 1_024  # entries of one piece of a key's list
CELL_ROWS = 256  # rows, and pieces, of a hot key in one cell of the grid
SUMS_PER_TASK = 2_000_000  # products summed in one task, so that its sums stay in memory


def pieces(t: DataFrame, key: str, columns: list[str], entries: int = PIECE_ENTRIES) -> DataFrame:
    """(key, one array per column): the rows of each key, in pieces of about ``entries``; parallel arrays, first column rising."""
    heavy = (t.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > entries)
             .select(key, F.ceil(F.col("_n") / F.lit(float(entries))).cast("int").alias("_parts")))
    place = F.pmod(F.xxhash64(columns[0]), F.coalesce("_parts", F.lit(1))).cast("int")
    lists = (t.select(key, *columns).join(heavy, key, "left").groupBy(key, place.alias("_piece"))
             .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_e")))
    return lists.select(key, *[F.col(f"_e.{c}").alias(c) for c in columns])


def fan_out(rows: DataFrame, lists: DataFrame, key: str, to: str, columns: list[str], n_sums: int,
            after: str | None = None, more: DataFrame | None = None) -> DataFrame:
    """Every row of ``rows`` with every entry of its key's ``lists``, one row each, already partitioned by ``to``.

    The exchange by ``to`` carries arrays, not pairs, and an aggregate or window by ``to`` (and more) on top needs no
    further one.  ``after``: only entries whose first column is greater than this column.  ``more``: rows of the shipped
    form (other columns null) that join the exchange.  ``n_sums`` is about the number of result rows; it sets the tasks.
    """
    met = split_join(rows, lists, key, CELL_ROWS).drop(key)
    if after is not None:
        n = F.size(F.filter(columns[0], lambda x: x > F.col(after)))
        met = met.withColumn("_n", n).where("_n > 0")
        met = met.select(*[F.slice(c, F.size(c) - F.col("_n") + 1, F.col("_n")).alias(c) if c in columns else F.col(c)
                           for c in met.columns if c != "_n"])
    if more is not None:
        met = met.unionByName(more, allowMissingColumns=True)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n_sums / SUMS_PER_TASK))
    own = [c for c in met.columns if c not in columns]
    return met.repartition(tasks, to).select(*own, F.inline(F.arrays_zip(*columns)))


def _mirror(pairs: DataFrame, a: str, b: str, value_cols) -> DataFrame:
    way = lambda x, y: F.struct(F.col(x).alias(a), F.col(y).alias(b), *value_cols)
    return pairs.select(F.inline(F.array(way("_a", "_b"), way("_b", "_a"))))


OWN_ENTRIES = 4_000_000  # entries of the entities of one group
STEP = 1_000_000  # products in one NumPy step
SUMS = ["_a", "_b", "cos", "gram"]
SUMS_SCHEMA = "_a long, _b long, cos double, gram double"


def _pairs_kernel(both: bool, top: int | None):
    """Sums of the pairs of a group's own entities: both orders or only a < b; with ``top`` the best of each by ``cos``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, own, best = [], None, None
        for kind, rows in st.runs(batches):
            if kind == st.OWN:
                parts.append(rows)
                continue
            if own is None:
                if not parts:
                    continue  # no entity fell into this group
                own, parts = st.Own(parts), []
                best = None if top is None else st.Best(own.ids.size, top)
            for other, at, cos, gram in own.meet(rows, STEP, above=not both):
                if best is None:
                    yield pd.DataFrame({"_a": own.ids[at], "_b": other, "cos": cos, "gram": gram})
                else:
                    best.offer(at, other, cos, gram)
        if best is not None:
            at, other, cos, *gram, _ = best.lists()
            yield pd.DataFrame({"_a": own.ids[at], "_b": other, "cos": cos, "gram": gram[0] if gram else np.zeros(0)})
    return run


def _streamed_pairs(rows: DataFrame, w: str, both: bool, top: int | None) -> DataFrame:
    """(_a, _b, cos, gram) of written rows (id, norm, keys, r, ...): cos = sum r * r' / norm / norm', gram = sum w * r'."""
    slots = rows.sparkSession.sparkContext.defaultParallelism
    n = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    return st.each_group(rows, ("r", w), [(rows, "r", "r")], max(slots, math.ceil(n / OWN_ENTRIES)), _pairs_kernel(both, top),
                         SUMS_SCHEMA, SUMS, unit=((st.OWN, "p"), (st.NEAR, "p")))


def _join_size(train: DataFrame, entity: str, through: str, plan: str) -> tuple[int | None, int]:
    """(blocks or None for the join, products of the join)."""
    from cartlens.operators.pair_blocks import pairs_plan_costs
    slots = train.sparkSession.sparkContext.defaultParallelism
    costs = pairs_plan_costs(train, entity, through, slots)
    return costs["blocks"] if plan == "blocked" else None, costs["join_rows"]


def cosine_pairs(train: DataFrame, entity: str, through: str, other: str, plan: str = "auto",
                 by_entity: bool = False, top: int | None = None) -> DataFrame:
    """Cosine between ``entity`` vectors over ``through``; non-zero pairs, both orders, no self pairs.

    ``plan``: ``auto`` (rows read past each other, nothing sent), ``join`` (self-join + aggregate) or ``blocked``
    (``pair_blocks``).  ``by_entity``: both orders are computed, and the join leaves them partitioned by ``entity``, for a
    cut per entity.  ``top``: ``auto`` returns only what can be among an entity's best so many.
    """
    if plan == "auto":
        t = train.select(entity, through, "score").where(F.col(entity).isNotNull())
        rows = materialised(st.known_rows(st.keyed_rows(t, entity, through)), "vector_rows")
        both = by_entity or top is not None
        pairs = _streamed_pairs(rows, "r", both, top).select("_a", "_b", F.col("cos").alias("similarity"))
        return pairs.toDF(entity, other, "similarity") if both else _mirror(pairs, entity, other, ["similarity"])
    t = with_norm(train.select(entity, through, "score"), entity, "_norm") \
        .select(entity, through, (F.col("score") / F.col("_norm")).alias("_h"))
    nb, n_sums = _join_size(train, entity, through, plan)
    if nb is not None:
        from cartlens.operators.pair_blocks import blocked_pair_sums
        rows = t.select(F.col(entity).alias("e"), F.col(through).alias("k"), F.col("_h").alias("h"),
                        F.lit(0.0).alias("r"), F.lit(0.0).alias("w"))
        pairs = blocked_pair_sums(rows, nb, with_gram=False).withColumnRenamed("cos", "similarity")
        return _mirror(pairs, entity, other, ["similarity"])
    a = t.select(F.col(entity).alias("_a"), through, F.col("_h").alias("_ha"))
    b = pieces(t.select(F.col(entity).alias("_b"), through, F.col("_h").alias("_hb")), through, ["_b", "_hb"])
    met = fan_out(a, b, through, "_a", ["_b", "_hb"], n_sums, after=None if by_entity else "_a")
    pairs = met.where(F.col("_a") != F.col("_b")).groupBy("_a", "_b").agg(F.sum(F.col("_ha") * F.col("_hb")).alias("similarity"))
    if by_entity:
        return pairs.select(F.col("_a").alias(entity), F.col("_b").alias(other), "similarity")
    return _mirror(pairs, entity, other, ["similarity"])


def user_similarity(train: DataFrame, by_entity: bool = False, top: int | None = None) -> DataFrame:
    """(user_id, other_user_id, similarity)."""
    return cosine_pairs(train, "user_id", "product_id", "other_user_id", by_entity=by_entity, top=top)


def item_similarity(train: DataFrame) -> DataFrame:
    """R2: (product_id, other_product_id, similarity)."""
    return cosine_pairs(train, "product_id", "user_id", "other_product_id")


def item_pairs(train: DataFrame, plan: str = "auto", by_entity: bool = False, top: int | None = None) -> DataFrame:
    """Item x item table shared by both CF scorers, from ONE self-join on user_id.

    For items j != i co-occurring in some user's history:
      ``cos``  = sum_v r(v,j)/|j| * r(v,i)/|i|      (item cosine, R2/R6)
      ``gram`` = sum_v r(v,j) * r(v,i) / |v|        (G = H^T R, user-based rewrite of R5)
    Output columns (product_id, other_product_id, cos, gram), both orders; ``by_entity`` and ``top`` (by ``cos``) as in
    ``cosine_pairs``.
    """
    if plan == "auto":
        known = train.select("user_id", "product_id", "score").where("user_id IS NOT NULL")
        rows = materialised(st.entity_rows(st.keyed_rows(known, "user_id", "product_id")), "product_rows")
        both = by_entity or top is not None
        pairs = _streamed_pairs(rows, "w", both, top)
        return pairs.toDF("product_id", "other_product_id", "cos", "gram") if both else \
            _mirror(pairs, "product_id", "other_product_id", ["cos", "gram"])
    t = with_norm(train.select("user_id", "product_id", "score"), "user_id", "_un")
    t = with_norm(t, "product_id", "_in")
    t = t.select("user_id", "product_id", "score", "_un", (F.col("score") / F.col("_in")).alias("_hi"))
    nb, n_sums = _join_size(train, "product_id", "user_id", plan)
    if nb is not None:
        from cartlens.operators.pair_blocks import blocked_pair_sums
        rows = t.select(F.col("product_id").alias("e"), F.col("user_id").alias("k"), F.col("_hi").alias("h"),
                        F.col("score").alias("r"), (F.lit(1.0) / F.col("_un")).alias("w"))
        pairs = blocked_pair_sums(rows, nb, with_gram=True)
        return _mirror(pairs, "product_id", "other_product_id", ["cos", "gram"])
    a = t.select(F.col("product_id").alias("_a"), "user_id", F.col("score").alias("_ra"), F.col("_hi").alias("_ha"),
                 "_un")
    values = ["_b", "_rb", "_hb"]
    b = pieces(t.select("user_id", F.col("product_id").alias("_b"), F.col("score").alias("_rb"), F.col("_hi").alias("_hb")),
               "user_id", values)
    met = fan_out(a, b, "user_id", "_a", values, n_sums, after=None if by_entity else "_a")
    pairs = met.where(F.col("_a") != F.col("_b")).groupBy("_a", "_b").agg(
        F.sum(F.col("_ha") * F.col("_hb")).alias("cos"), F.sum(F.col("_ra") * F.col("_rb") / F.col("_un")).alias("gram"))
    if by_entity:
        return pairs.select(F.col("_a").alias("product_id"), F.col("_b").alias("other_product_id"), "cos", "gram")
    return _mirror(pairs, "product_id", "other_product_id", ["cos", "gram"])


def similar(sim: DataFrame, key: str, other: str, n: int = 10) -> DataFrame:
    """Top-n most similar per key, similarity rounded to 4.

    Self is excluded by id (not by position) and only positive similarities are
    returned; an unknown key simply has no rows.
    """
    pos = sim.filter(F.col("similarity") > 0)
    return top_k_per_key(pos, key, "similarity", other, n).select(
        key, other, F.round("similarity", 4).alias("similarity"), "rank")


def similar_to(train: DataFrame, requested: DataFrame, entity: str, through: str, other: str, n: int = 10) -> DataFrame:
    """R3/R4 for the requested ids only: work follows their histories, not all pairs.

    The requested rows are cut out by a semi join before they meet everyone's
    rows on the shared key.  Unknown ids have no rows.
    """
    t = with_norm(train.select(entity, through, "score"), entity, "_norm") \
        .select(entity, through, (F.col("score") / F.col("_norm")).alias("_h"))
    own = t.join(requested.select(entity).distinct(), entity, "left_semi")
    everyone = t.select(F.col(entity).alias(other), through, F.col("_h").alias("_ho"))
    sims = (own.join(everyone, through).filter(F.col(entity) != F.col(other))
            .groupBy(entity, other).agg(F.sum(F.col("_h") * F.col("_ho")).alias("similarity")))
    return similar(sims, entity, other, n)
