"""Registered queries: interaction cleaning (S3, D1-D10) and popularity."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartlens.operators import interactions as ix
from cartlens.operators.popularity import cold_start, popular
from cartlens.plans import oracle_base as ob
from cartlens.plans.context import inputs
from cartlens.plans.registry import query

CLEAN = ob.clean_ctes()


@query("interactions_enriched", ob.with_ctes(*CLEAN, body="SELECT * FROM enriched"))
def interactions_enriched(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return ix.enrich(i.interactions, i.products)


@query("interactions_dedup", ob.with_ctes(*CLEAN, body="SELECT * FROM deduped"))
def interactions_dedup(spark, sf_dir):
    return inputs(spark, sf_dir).cleaned.deduped


_STRICT = ob.clean_ctes(min_user=40, min_product=30)


@query("activity_filter", ob.with_ctes(*_STRICT, body="SELECT * FROM filtered"))
def activity_filter(spark, sf_dir):
    """D3 with thresholds high enough to bite on the order log (users >= 40, products >= 30)."""
    i = inputs(spark, sf_dir)
    return ix.activity_filter(i.cleaned.deduped, 40, 30)


@query("interactions_scored", ob.with_ctes(*CLEAN, body="SELECT * FROM clean_t"))
def interactions_scored(spark, sf_dir):
    return inputs(spark, sf_dir).clean


_EVENT_CLEAN = ob.clean_ctes(log="event_log")


@query("event_log_scored", ob.with_ctes(*_EVENT_CLEAN, body="SELECT * FROM clean_t"))
def event_log_scored(spark, sf_dir):
    """The whole cleaning chain on the dense event log (all five event types, rating events with values)."""
    i = inputs(spark, sf_dir)
    return ix.clean(i.events, i.products)


_RAW_EVENT = ob.EVENT_LOG.replace(
    "CASE event_type WHEN 'signup' THEN 'add_to_cart' WHEN 'error' THEN 'rating' ELSE event_type END",
    "event_type").replace("event_log AS", "raw_event_log AS")


@query("null_fill", ob.with_ctes(_RAW_EVENT, ob.CATEGORIES, ob.PRODUCTS,
                                 ob.CLEAN_STAGES.format(log="raw_event_log", min_user=3, min_product=3),
                                 body="SELECT * FROM clean_t"))
def null_fill(spark, sf_dir):
    """D4-D6 with unknown event types kept (``signup``/``error`` score 1.0 and lose every dedup)."""
    from cartlens.sources import tables
    i = inputs(spark, sf_dir)
    return ix.clean(tables.event_log(spark, sf_dir, rename_unknown=False), i.products)


@query("temporal_split", ob.with_ctes(*CLEAN, body="""
SELECT *, 'train' AS split FROM train_t UNION ALL SELECT *, 'test' AS split FROM test_all_t"""))
def temporal_split(spark, sf_dir):
    i = inputs(spark, sf_dir)
    flagged = ix.flag_train(i.clean)
    return flagged.withColumn("split", F.when(F.col("is_train"), "train").otherwise("test")).drop("is_train")


@query("train_set", ob.with_ctes(*CLEAN, body="SELECT * FROM train_t"))
def train_set(spark, sf_dir):
    return inputs(spark, sf_dir).train


@query("warm_test", ob.with_ctes(*CLEAN, body="SELECT * FROM test_t"))
def warm_test(spark, sf_dir):
    return inputs(spark, sf_dir).test


@query("cleaning_diagnostics", ob.with_ctes(*CLEAN, body="""
SELECT 'loaded' AS stage, 1 AS stage_order, count(*) AS n_rows, count(DISTINCT user_id) AS n_users,
       count(DISTINCT product_id) AS n_products, CAST(NULL AS DOUBLE) AS min_score, CAST(NULL AS DOUBLE) AS max_score
FROM enriched
UNION ALL SELECT 'dedup', 2, count(*), count(DISTINCT user_id), count(DISTINCT product_id), NULL, NULL FROM deduped
UNION ALL SELECT 'filtered', 3, count(*), count(DISTINCT user_id), count(DISTINCT product_id), NULL, NULL FROM filtered
UNION ALL SELECT 'scored', 4, count(*), count(DISTINCT user_id), count(DISTINCT product_id), min(score), max(score) FROM clean_t
UNION ALL SELECT 'train', 5, count(*), count(DISTINCT user_id), count(DISTINCT product_id), min(score), max(score) FROM train_t
UNION ALL SELECT 'test', 6, count(*), count(DISTINCT user_id), count(DISTINCT product_id), min(score), max(score) FROM test_t
"""))
def cleaning_diagnostics(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return ix.diagnostics(i.interactions, i.products, i.cleaned)


POPULAR_SQL = """
pop_sums AS (SELECT product_id, sum(score) AS s FROM train_t GROUP BY product_id),
popular_t AS (
  SELECT product_id, round(s, 4) AS score,
         CAST(row_number() OVER (ORDER BY round(s, 10) DESC, product_id) AS INTEGER) AS rank
  FROM pop_sums QUALIFY rank <= {n}
)"""


@query("popular_items", ob.with_ctes(*CLEAN, POPULAR_SQL.format(n=10), body="""
SELECT p.rank, p.product_id, d.name, p.score FROM popular_t p JOIN products_t d ON p.product_id = d.product_id"""))
def popular_items(spark, sf_dir):
    """R8 joined to product names: the flagship query."""
    i = inputs(spark, sf_dir)
    pop = popular(i.train, 10)
    return pop.join(i.products.select("product_id", "name"), "product_id", "inner") \
        .select("rank", "product_id", "name", "score")


@query("cold_start_recs", ob.with_ctes(*CLEAN, POPULAR_SQL.format(n=10), ob.USERS, body="""
SELECT u.user_id, p.product_id, p.score, p.rank
FROM (SELECT user_id FROM users_t WHERE user_id NOT IN (SELECT user_id FROM train_t)) u, popular_t p"""))
def cold_start_recs(spark, sf_dir):
    """Every known user without train history receives the popularity list."""
    i = inputs(spark, sf_dir)
    return cold_start(i.users, i.train, 10)
