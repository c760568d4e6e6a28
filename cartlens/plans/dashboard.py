"""Registered queries: quality checks (V1-V7), dashboard aggregates (A1-A6), row counts (K5), plain scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartlens.operators import analytics as an
from cartlens.operators import quality as qa
from cartlens.operators.popularity import popular
from cartlens.plans import oracle_base as ob
from cartlens.plans import oracle_content as oq
from cartlens.plans.context import inputs
from cartlens.plans.registry import query
from cartlens.session import materialised

TABLE_CTES = {"categories": "categories_t", "users": "users_t", "products": "products_t",
              "product_tags": "product_tags_t", "interactions": "order_log"}
BASE = [ob.ORDER_LOG, ob.CATEGORIES, ob.PRODUCTS, ob.TAGS, ob.USERS]


#: The rules again, written from the table definitions and not from ``quality.RULES``: (table, rule, column, condition
#: of a broken row), (table, unique column), (table, column, parent table, parent column).
ROW_RULES = [
    ("categories", "not_null", "name", "name IS NULL"),
    ("users", "not_null", "username", "username IS NULL"),
    ("users", "not_null", "email", "email IS NULL"),
    ("users", "domain", "age_group", "age_group NOT IN ('18-24', '25-34', '35-44', '45-54', '55+')"),
    ("users", "domain", "gender", "gender NOT IN ('M', 'F', 'Other', 'Prefer not to say')"),
    ("products", "not_null", "name", "name IS NULL"),
    ("products", "not_null", "price", "price IS NULL"),
    ("products", "range", "price", "price < 0"),
    ("products", "range", "avg_rating", "avg_rating < 0 OR avg_rating > 5"),
    ("product_tags", "not_null", "product_id", "product_id IS NULL"),
    ("product_tags", "not_null", "tag", "tag IS NULL"),
    ("interactions", "not_null", "user_id", "user_id IS NULL"),
    ("interactions", "not_null", "product_id", "product_id IS NULL"),
    ("interactions", "not_null", "event_type", "event_type IS NULL"),
    ("interactions", "domain", "event_type", "event_type NOT IN ('view', 'click', 'add_to_cart', 'purchase', 'rating')"),
    ("interactions", "range", "rating", "rating < 1 OR rating > 5"),
]
UNIQUE_RULES = [("categories", "category_id"), ("users", "user_id"), ("users", "username"), ("users", "email"),
                ("products", "product_id"), ("product_tags", "tag_id"), ("interactions", "interaction_id")]
PARENT_RULES = [("categories", "parent_id", "categories", "category_id"), ("products", "category_id", "categories", "category_id"),
                ("product_tags", "product_id", "products", "product_id"), ("interactions", "user_id", "users", "user_id"),
                ("interactions", "product_id", "products", "product_id")]


def quality_sql() -> str:
    parts = [f"SELECT '{t}' AS table_name, '{rule}' AS rule, '{c}' AS column_name, count(*) AS violations "
             f"FROM {TABLE_CTES[t]} WHERE {broken}" for t, rule, c, broken in ROW_RULES]
    parts += [f"SELECT '{t}', 'unique', '{c}', count(*) FROM (SELECT {c} FROM {TABLE_CTES[t]} WHERE {c} IS NOT NULL "
              f"GROUP BY {c} HAVING count(*) > 1)" for t, c in UNIQUE_RULES]
    parts += [f"SELECT '{t}', 'foreign_key', '{c}', count(*) FROM {TABLE_CTES[t]} x WHERE x.{c} IS NOT NULL "
              f"AND NOT EXISTS (SELECT 1 FROM {TABLE_CTES[p]} p WHERE p.{pc} = x.{c})" for t, c, p, pc in PARENT_RULES]
    return "\nUNION ALL ".join(parts)


@query("quality_violations", ob.with_ctes(*BASE, body=quality_sql()))
def quality_violations(spark, sf_dir):
    """V1-V5 over the five derived reference tables (``recommendation_violations`` has the sixth).

    The interactions are joined together once and written; each rule then scans its own columns.
    """
    i = inputs(spark, sf_dir)
    log = materialised(i.interactions.select("interaction_id", "user_id", "product_id", "event_type", "rating"), "log")
    tags = materialised(i.tags, "tags")
    return qa.violations({"categories": i.categories, "users": i.users, "products": i.products,
                          "product_tags": tags, "interactions": log})


@query("live_product_tags", ob.with_ctes(*BASE, body="""
SELECT t.* FROM product_tags_t t WHERE EXISTS (SELECT 1 FROM products_t p WHERE p.product_id = t.product_id)"""))
def live_product_tags(spark, sf_dir):
    """V6: tags restricted to existing products (the cascade rule)."""
    i = inputs(spark, sf_dir)
    return qa.restrict_to_parents(i.tags, "product_id", i.products, "product_id")


@query("table_counts", ob.with_ctes(*BASE, body="""
SELECT 'categories' AS table_name, count(*) AS n_rows FROM categories_t
UNION ALL SELECT 'users', count(*) FROM users_t
UNION ALL SELECT 'products', count(*) FROM products_t
UNION ALL SELECT 'product_tags', count(*) FROM product_tags_t
UNION ALL SELECT 'interactions', count(*) FROM order_log"""))
def table_counts(spark, sf_dir):
    """K5."""
    i = inputs(spark, sf_dir)
    return an.table_counts({"categories": i.categories, "users": i.users, "products": i.products,
                            "product_tags": i.tags, "interactions": i.interactions})


CATALOG_SQL = """
catalog_v AS (
  SELECT p.*, c.name AS category_name FROM products_t p JOIN categories_t c ON p.category_id = c.category_id
)"""


@query("product_catalog", ob.with_ctes(*BASE, CATALOG_SQL, body="SELECT * FROM catalog_v"))
def product_catalog(spark, sf_dir):
    """Products denormalised with their category name, whole texts included."""
    i = inputs(spark, sf_dir)
    return an.catalog_view(i.products_with_text, i.categories)


@query("known_users", ob.with_ctes(*ob.clean_ctes(), body="SELECT DISTINCT user_id FROM train_t"))
def known_users(spark, sf_dir):
    """Users the recommenders know (those in train)."""
    return inputs(spark, sf_dir).train.select("user_id").distinct()


@query("product_picklist", ob.with_ctes(*BASE, body="SELECT product_id, name FROM products_t"))
def product_picklist(spark, sf_dir):
    """S12."""
    return inputs(spark, sf_dir).products.select("product_id", "name")


@query("user_profiles", ob.with_ctes(*BASE, *ob.clean_ctes()[3:], body="""
SELECT u.*, s.n_train_items FROM users_t u
JOIN (SELECT user_id, count(*) AS n_train_items FROM train_t GROUP BY user_id) s ON s.user_id = u.user_id"""))
def user_profiles(spark, sf_dir):
    """S10 in bulk: profile rows of every known user, with their train history size."""
    i = inputs(spark, sf_dir)
    counts = i.train.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_train_items"))
    return i.users.join(counts, "user_id", "inner")


@query("kpis", ob.with_ctes(*BASE, CATALOG_SQL, body="""
SELECT (SELECT count(*) FROM users_t) AS n_users, (SELECT count(*) FROM catalog_v) AS n_products,
       (SELECT count(*) FROM order_log) AS n_interactions,
       (SELECT count(DISTINCT category_name) FROM catalog_v) AS n_categories"""))
def kpis(spark, sf_dir):
    """A1."""
    i = inputs(spark, sf_dir)
    return an.kpis(i.users, an.catalog_view(i.products, i.categories), i.interactions)


@query("event_counts", ob.with_ctes(*BASE, body="SELECT event_type, count(*) AS n FROM order_log GROUP BY 1"))
def event_counts(spark, sf_dir):
    """A2 on the raw interactions."""
    return an.event_counts(inputs(spark, sf_dir).interactions)


@query("category_counts", ob.with_ctes(*BASE, CATALOG_SQL, body="""
SELECT category_name AS category, count(*) AS n,
       round(CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
FROM catalog_v GROUP BY 1"""))
def category_counts(spark, sf_dir):
    """A3."""
    i = inputs(spark, sf_dir)
    return an.category_counts(an.catalog_view(i.products, i.categories))


def _hist_sql(col: str, bins: int) -> str:
    return f"""
SELECT CAST(bin AS INTEGER) AS bin, round(lo + (bin - 1) * ((hi - lo) / {float(bins)}), 10) AS bin_lo,
       round(lo + bin * ((hi - lo) / {float(bins)}), 10) AS bin_hi, count(*) AS n
FROM (
  SELECT CASE WHEN r.hi > r.lo THEN least(floor((c.{col} - r.lo) / (r.hi - r.lo) * {float(bins)}) + 1, {bins})
              ELSE 1 END AS bin, r.lo, r.hi
  FROM catalog_v c, (SELECT min({col}) AS lo, max({col}) AS hi FROM catalog_v) r
  WHERE c.{col} IS NOT NULL
) GROUP BY bin, lo, hi"""


@query("rating_histogram", ob.with_ctes(*BASE, CATALOG_SQL, body=_hist_sql("avg_rating", 20)))
def rating_histogram(spark, sf_dir):
    """A4: 20 equal-width bins of avg_rating."""
    i = inputs(spark, sf_dir)
    return an.histogram(an.catalog_view(i.products, i.categories), "avg_rating", 20)


@query("price_histogram", ob.with_ctes(*BASE, CATALOG_SQL, body=_hist_sql("price", 30)))
def price_histogram(spark, sf_dir):
    """A5: 30 equal-width bins of price."""
    i = inputs(spark, sf_dir)
    return an.histogram(an.catalog_view(i.products, i.categories), "price", 30)


_PAGE = [*ob.clean_ctes(), ob.TAGS, oq.CORPUS, oq.MODEL, CATALOG_SQL, """
psim6 AS (
  SELECT a.product_id, b.product_id AS other_product_id, sum(a.weight * b.weight) AS sim
  FROM tfidf_t a JOIN tfidf_t b ON a.term_idx = b.term_idx AND a.product_id <> b.product_id GROUP BY 1, 2
),
sim6 AS (
  SELECT product_id, other_product_id,
         row_number() OVER (PARTITION BY product_id ORDER BY round(sim, 10) DESC, other_product_id) AS rank
  FROM psim6 WHERE sim > 0 QUALIFY rank <= 6
),
pop3 AS (
  SELECT product_id, row_number() OVER (ORDER BY round(s, 10) DESC, product_id) AS rank
  FROM (SELECT product_id, sum(score) AS s FROM train_t GROUP BY 1) QUALIFY rank <= 3
),
page_tags AS (SELECT product_id, string_agg(tag, ', ' ORDER BY tag_id) AS tags FROM product_tags_t GROUP BY 1),
page_sim AS (SELECT product_id, string_agg(CAST(other_product_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM sim6 GROUP BY 1)"""]


@query("product_page", ob.with_ctes(*_PAGE, body=f"""
SELECT c.product_id, c.name, c.category_name AS category, c.price, c.avg_rating, coalesce(t.tags, '') AS tags,
       coalesce(s.ids, '') AS similar_ids,
       (SELECT string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY rank) FROM pop3) AS popular_ids,
       '{an.DEFAULT_SEARCH_BASE}' || replace(c.name, ' ', '+') AS search_url
FROM catalog_v c LEFT JOIN page_tags t ON t.product_id = c.product_id LEFT JOIN page_sim s ON s.product_id = c.product_id"""))
def product_page(spark, sf_dir):
    """A6 for every product: details, tags, top-6 similar products, top-3 popular products, search link."""
    i = inputs(spark, sf_dir)
    sim = i.similar_lists.filter(F.col("rank") <= 6)
    pop = [r["product_id"] for r in popular(i.train, 3).orderBy("rank").collect()]
    return an.product_page(an.catalog_view(i.products, i.categories), i.tags, sim, pop)
