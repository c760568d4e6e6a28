"""DuckDB SQL for the derived base tables, written independently of the Spark code.

Each constant is a list of ``name AS (...)`` CTE bodies; ``with_ctes`` joins the
ones a query needs.  Window functions here use the plain single-partition form
(``row_number() over (order by ...)``), which is the obvious SQL and a
different route from the Spark jobs.
"""

from __future__ import annotations

from cartlens.functions.text import TOKEN_PATTERN, sql_stop_list

ORDER_LOG = """
order_log AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS interaction_id, o.o_custkey AS user_id, l.l_partkey AS product_id,
         CASE WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'O' THEN 'purchase'
              WHEN l.l_returnflag = 'N' THEN 'rating'
              WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'O' THEN 'add_to_cart'
              WHEN l.l_returnflag = 'A' THEN 'click' ELSE 'view' END AS event_type,
         CASE WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'F'
              THEN CAST(1.0 + (CAST(l.l_quantity AS BIGINT) % 9) * 0.5 AS DOUBLE) END AS rating,
         l.l_orderkey AS session_id, l.l_shipdate AS event_time
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""

EVENT_LOG = """
event_log AS (
  SELECT event_id AS interaction_id, user_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS product_id,
         CASE event_type WHEN 'signup' THEN 'add_to_cart' WHEN 'error' THEN 'rating' ELSE event_type END AS event_type,
         CASE WHEN event_type = 'error' THEN CAST(1.0 + (event_id % 9) * 0.5 AS DOUBLE) END AS rating,
         CAST(NULL AS BIGINT) AS session_id, ts AS event_time
  FROM events
)"""

CATEGORIES = """
cat_names AS (
  SELECT name, lvl, parent_name FROM (
    SELECT DISTINCT p_type AS name, 0 AS lvl, CAST(NULL AS VARCHAR) AS parent_name FROM part
    UNION ALL
    SELECT p_brand AS name, 1 AS lvl, arg_min(p_type, p_partkey) AS parent_name FROM part GROUP BY p_brand
  )
),
cat_ids AS (
  SELECT name, lvl, parent_name, CAST(row_number() OVER (ORDER BY lvl, name) AS BIGINT) AS category_id FROM cat_names
),
categories_t AS (
  SELECT c.category_id, c.name, p.category_id AS parent_id
  FROM cat_ids c LEFT JOIN cat_ids p ON c.parent_name = p.name
)"""

PRODUCTS = """
reviews_t AS (SELECT l_partkey, count(*) AS review_count FROM lineitem GROUP BY l_partkey),
products_t AS (
  SELECT p.p_partkey AS product_id, p.p_name AS name, d.text AS description,
         CAST(p.p_retailprice AS DOUBLE) AS price, c.category_id,
         CAST(2.5 + (p.p_size % 6) * 0.5 AS DOUBLE) AS avg_rating,
         CAST(coalesce(r.review_count, 0) AS BIGINT) AS review_count,
         CAST(NULL AS TIMESTAMP) AS created_at
  FROM part p
  LEFT JOIN categories_t c ON c.name = p.p_type AND c.parent_id IS NULL
  LEFT JOIN documents d ON d.doc_id = p.p_partkey
  LEFT JOIN reviews_t r ON r.l_partkey = p.p_partkey
)"""

TAGS = """
tag_raw AS (
  SELECT p_partkey, list_concat([lower(p_brand), lower(p_type)], string_split(lower(p_name), ' ')) AS l FROM part
),
tag_pos AS (SELECT p_partkey, unnest(l) AS tag, generate_subscripts(l, 1) AS pos FROM tag_raw),
tag_first AS (SELECT p_partkey, tag, min(pos) AS pos FROM tag_pos GROUP BY 1, 2),
product_tags_t AS (
  SELECT CAST(p_partkey * 1048576 + row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS BIGINT) AS tag_id,
         p_partkey AS product_id, tag
  FROM tag_first WHERE length(tag) > 1
)"""

USERS = """
users_t AS (
  SELECT c.c_custkey AS user_id, c.c_name AS username, CAST(NULL AS VARCHAR) AS email,
         CAST(NULL AS VARCHAR) AS age_group, CAST(NULL AS VARCHAR) AS gender, n.n_name AS location,
         CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS last_active
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

CLEAN_STAGES = """
enriched AS (
  SELECT i.interaction_id, i.user_id, i.product_id, i.event_type, i.rating, i.session_id, i.event_time,
         p.category_id, p.avg_rating AS product_avg_rating
  FROM {log} i JOIN products_t p ON i.product_id = p.product_id
),
deduped AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY user_id, product_id
      ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'add_to_cart' THEN 3
                               WHEN 'rating' THEN 4 WHEN 'purchase' THEN 5 END DESC NULLS LAST,
               interaction_id ASC NULLS LAST, event_time ASC NULLS LAST, session_id ASC NULLS LAST,
               rating ASC NULLS LAST) AS rn
    FROM enriched) WHERE rn = 1
),
filtered AS (
  SELECT * FROM deduped
  WHERE user_id IN (SELECT user_id FROM deduped GROUP BY user_id HAVING count(*) >= {min_user})
    AND product_id IN (SELECT product_id FROM deduped GROUP BY product_id HAVING count(*) >= {min_product})
),
scored AS (
  SELECT interaction_id, user_id, product_id, event_type,
         CAST(coalesce(rating, 0.0) AS DOUBLE) AS rating,
         CAST(coalesce(session_id, -1) AS BIGINT) AS session_id,
         event_time, category_id, product_avg_rating,
         CASE WHEN event_type = 'rating' AND rating IS NOT NULL AND rating > 0 THEN CAST(rating AS DOUBLE)
              ELSE CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'add_to_cart' THEN 3.0
                                   WHEN 'purchase' THEN 5.0 WHEN 'rating' THEN 4.0 ELSE 1.0 END END AS score
  FROM filtered
),
clean_t AS (
  SELECT interaction_id, user_id, product_id, event_type, rating, session_id, event_time, category_id,
         product_avg_rating, CAST(score AS DOUBLE) AS score, CAST(score AS DOUBLE) / 5.0 AS score_norm
  FROM scored
),
positioned AS (
  SELECT *, row_number() OVER (ORDER BY event_time, user_id, product_id) AS pos,
         count(*) OVER () AS n_all
  FROM clean_t
),
train_t AS (
  SELECT * EXCLUDE (pos, n_all) FROM positioned WHERE pos <= floor(n_all * 8 / 10)
),
test_all_t AS (
  SELECT * EXCLUDE (pos, n_all) FROM positioned WHERE pos > floor(n_all * 8 / 10)
),
test_t AS (
  SELECT * FROM test_all_t
  WHERE user_id IN (SELECT DISTINCT user_id FROM train_t)
    AND product_id IN (SELECT DISTINCT product_id FROM train_t)
)"""

STOP_LIST = sql_stop_list()


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n" + body


def clean_ctes(log: str = "order_log", min_user: int = 3, min_product: int = 3) -> list[str]:
    src = ORDER_LOG if log == "order_log" else EVENT_LOG
    return [src, CATEGORIES, PRODUCTS, CLEAN_STAGES.format(log=log, min_user=min_user, min_product=min_product)]


TOKEN_RE = TOKEN_PATTERN
