"""DuckDB oracle CTEs for the matrix and collaborative-filtering queries.

These use the textbook forms on purpose: the user-based scores go through an
explicit user x user cosine table, norms are joined after the dot products,
and the full-blend variant scores the complete user x item grid.
"""

from __future__ import annotations

NORMS = """
unorm AS (SELECT user_id, sqrt(sum(score * score)) AS nrm FROM train_t GROUP BY user_id),
inorm AS (SELECT product_id, sqrt(sum(score * score)) AS nrm FROM train_t GROUP BY product_id)"""

USER_SIM = """
udot AS (
  SELECT a.user_id AS u, b.user_id AS v, sum(a.score * b.score) AS dot
  FROM train_t a JOIN train_t b ON a.product_id = b.product_id AND a.user_id <> b.user_id
  GROUP BY 1, 2
),
usim AS (
  SELECT d.u, d.v, d.dot / (x.nrm * y.nrm) AS sim
  FROM udot d JOIN unorm x ON x.user_id = d.u JOIN unorm y ON y.user_id = d.v
)"""

ITEM_SIM = """
idot AS (
  SELECT a.product_id AS j, b.product_id AS i, sum(a.score * b.score) AS dot
  FROM train_t a JOIN train_t b ON a.user_id = b.user_id AND a.product_id <> b.product_id
  GROUP BY 1, 2
),
isim AS (
  SELECT d.j, d.i, d.dot / (x.nrm * y.nrm) AS sim
  FROM idot d JOIN inorm x ON x.product_id = d.j JOIN inorm y ON y.product_id = d.i
)"""

SCORES = """
ub_raw AS (
  SELECT s.u AS user_id, t.product_id, sum(s.sim * t.score) AS score
  FROM usim s JOIN train_t t ON t.user_id = s.v GROUP BY 1, 2
),
ib_raw AS (
  SELECT t.user_id, s.i AS product_id, sum(s.sim * t.score) AS score
  FROM train_t t JOIN isim s ON s.j = t.product_id GROUP BY 1, 2
),
ub AS (
  SELECT * FROM ub_raw r WHERE score > 0
    AND NOT EXISTS (SELECT 1 FROM train_t t WHERE t.user_id = r.user_id AND t.product_id = r.product_id)
),
ib AS (
  SELECT * FROM ib_raw r WHERE score > 0
    AND NOT EXISTS (SELECT 1 FROM train_t t WHERE t.user_id = r.user_id AND t.product_id = r.product_id)
),
ub_ranked AS (
  SELECT user_id, product_id, score,
         row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, product_id) AS rank FROM ub
),
ib_ranked AS (
  SELECT user_id, product_id, score,
         row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, product_id) AS rank FROM ib
)"""


def blend_sql(n: int) -> str:
    """R10 with n: each list cut to 2n and rounded to 4 places, blended in decimal, top n."""
    return f"""
ub_cut_{n} AS (SELECT user_id, product_id, CAST(round(score, 4) AS DECIMAL(18,4)) AS s FROM ub_ranked WHERE rank <= {2 * n}),
ib_cut_{n} AS (SELECT user_id, product_id, CAST(round(score, 4) AS DECIMAL(18,4)) AS s FROM ib_ranked WHERE rank <= {2 * n}),
cf_mix_{n} AS (
  SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.product_id, b.product_id) AS product_id,
         CAST(round(CAST(0.5 AS DECIMAL(10,4)) * coalesce(a.s, 0) + CAST(0.5 AS DECIMAL(10,4)) * coalesce(b.s, 0), 4)
              AS DOUBLE) AS score
  FROM ub_cut_{n} a FULL OUTER JOIN ib_cut_{n} b ON a.user_id = b.user_id AND a.product_id = b.product_id
),
cf_blend_{n} AS (
  SELECT user_id, product_id, score,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, product_id) AS INTEGER) AS rank
  FROM cf_mix_{n} QUALIFY rank <= {n}
)"""


FULL_BLEND = """
grid AS (
  SELECT u.user_id, p.product_id
  FROM (SELECT DISTINCT user_id FROM train_t) u CROSS JOIN (SELECT DISTINCT product_id FROM train_t) p
),
grid_scored AS (
  SELECT g.user_id, g.product_id,
         CASE WHEN EXISTS (SELECT 1 FROM train_t t WHERE t.user_id = g.user_id AND t.product_id = g.product_id)
              THEN 0.0 ELSE 0.5 * coalesce(a.score, 0.0) + 0.5 * coalesce(b.score, 0.0) END AS raw
  FROM grid g
  LEFT JOIN ub_raw a ON a.user_id = g.user_id AND a.product_id = g.product_id
  LEFT JOIN ib_raw b ON b.user_id = g.user_id AND b.product_id = g.product_id
),
full_blend AS (
  SELECT user_id, product_id, round(raw, 4) AS score,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(raw, 10) DESC, product_id) AS INTEGER) AS rank
  FROM grid_scored QUALIFY rank <= 10
)"""
