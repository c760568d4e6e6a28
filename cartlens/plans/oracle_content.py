"""DuckDB oracle CTEs for the TF-IDF content model and its consumers.

Similarity here is the plain term join (sum of weight products over shared
terms), a different route from the blocked dense products of the Spark jobs.
"""

from __future__ import annotations

from cartlens.plans.oracle_base import STOP_LIST, TOKEN_RE

CORPUS = """
tag_str AS (SELECT product_id, string_agg(tag, ' ' ORDER BY tag_id) AS tags FROM product_tags_t GROUP BY product_id),
corpus_t AS (
  SELECT p.product_id, p.name, coalesce(p.description, '') AS description, p.price, p.avg_rating, p.review_count,
         c.name AS category, coalesce(t.tags, '') AS tags,
         p.name || ' ' || c.name || ' ' || coalesce(t.tags, '') || ' ' || coalesce(p.description, '') AS corpus
  FROM products_t p JOIN categories_t c ON p.category_id = c.category_id
  LEFT JOIN tag_str t ON t.product_id = p.product_id
)"""


def analysed(name: str, source: str, id_col: str, text_col: str) -> str:
    """tf table ``name`` = (id, term, tf) for the documents of ``source``."""
    return f"""
{name}_words AS (
  SELECT {id_col}, list_filter(regexp_extract_all(lower({text_col}), '{TOKEN_RE}'),
                               lambda w: NOT list_contains({STOP_LIST}, w)) AS w
  FROM {source}
),
{name}_grams AS (
  SELECT {id_col}, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM {name}_words
),
{name} AS (
  SELECT {id_col}, term, count(*) AS tf FROM (SELECT {id_col}, unnest(g) AS term FROM {name}_grams) GROUP BY 1, 2
)"""


MODEL = analysed("tf_t", "corpus_t", "product_id", "corpus") + """,
vocab_t AS (
  SELECT term, term_count, doc_freq,
         ln((1.0 + (SELECT count(*) FROM corpus_t)) / (1.0 + doc_freq)) + 1.0 AS idf,
         CAST(row_number() OVER (ORDER BY term_count DESC, term) - 1 AS INTEGER) AS term_idx
  FROM (SELECT term, CAST(sum(tf) AS BIGINT) AS term_count, count(*) AS doc_freq FROM tf_t GROUP BY term)
  QUALIFY term_idx < 500
),
tfidf_t AS (
  SELECT product_id, term, term_idx, w / sqrt(sum(w * w) OVER (PARTITION BY product_id)) AS weight
  FROM (SELECT t.product_id, t.term, v.term_idx, t.tf * v.idf AS w FROM tf_t t JOIN vocab_t v ON v.term = t.term)
)"""

SIMILAR = """
psim AS (
  SELECT a.product_id, b.product_id AS other_product_id, sum(a.weight * b.weight) AS sim
  FROM tfidf_t a JOIN tfidf_t b ON a.term_idx = b.term_idx AND a.product_id <> b.product_id
  GROUP BY 1, 2
),
similar_products_t AS (
  SELECT product_id, other_product_id, round(sim, 4) AS similarity,
         CAST(row_number() OVER (PARTITION BY product_id ORDER BY round(sim, 10) DESC, other_product_id) AS INTEGER) AS rank
  FROM psim WHERE sim > 0 QUALIFY rank <= 10
)"""


def content_recs_sql(n: int) -> str:
    return f"""
top5_{n} AS (
  SELECT user_id, product_id FROM train_t
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) <= 5
),
citem_{n} AS (
  SELECT a.product_id AS j, b.product_id AS i, sum(a.weight * b.weight) AS cos
  FROM tfidf_t a JOIN tfidf_t b ON a.term_idx = b.term_idx
  WHERE a.product_id IN (SELECT product_id FROM top5_{n}) GROUP BY 1, 2
),
cscore_{n} AS (
  SELECT t.user_id, c.i AS product_id, sum(c.cos) AS score
  FROM top5_{n} t JOIN citem_{n} c ON c.j = t.product_id GROUP BY 1, 2
),
content_recs_{n} AS (
  SELECT user_id, product_id, round(score, 4) AS score,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 10) DESC, product_id) AS INTEGER) AS rank
  FROM cscore_{n} c
  WHERE score > 0
    AND NOT EXISTS (SELECT 1 FROM train_t t WHERE t.user_id = c.user_id AND t.product_id = c.product_id)
  QUALIFY rank <= {n}
)"""


SEARCH = """
queries_t AS (SELECT conv_id * 1048576 + turn AS query_id, text FROM conversations WHERE role = 'user'),
""" + analysed("qtf_t", "queries_t", "query_id", "text").lstrip("\n") + """,
qvec AS (
  SELECT query_id, term_idx, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight
  FROM (SELECT q.query_id, v.term_idx, q.tf * v.idf AS w FROM qtf_t q JOIN vocab_t v ON v.term = q.term)
),
qscore AS (
  SELECT q.query_id, w.product_id, sum(q.weight * w.weight) AS score
  FROM qvec q JOIN tfidf_t w ON w.term_idx = q.term_idx GROUP BY 1, 2
),
search_t AS (
  SELECT query_id, product_id, round(score, 4) AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, product_id) AS INTEGER) AS rank
  FROM qscore WHERE score > 0 QUALIFY rank <= 10
)"""
