"""DuckDB oracle CTEs for catalogue cleaning (C1-C17) over the raw text built from ``part``."""

from __future__ import annotations


def _price_txt(x: str) -> str:
    cents = f"CAST(round(({x}) * 100) AS BIGINT)"
    whole = f"({cents} // 100)"
    frac = f"lpad(CAST({cents} % 100 AS VARCHAR), 2, '0')"
    grouped = (f"CASE WHEN {whole} >= 1000 THEN CAST({whole} // 1000 AS VARCHAR) || ',' || "
               f"lpad(CAST({whole} % 1000 AS VARCHAR), 3, '0') ELSE CAST({whole} AS VARCHAR) END")
    return f"({grouped} || '.' || {frac})"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _num(x: str) -> str:
    return (f"TRY_CAST(nullif(regexp_extract(replace(coalesce({x}, 'nan'), ',', ''), '(\\d+\\.?\\d*)', 1), '') "
            f"AS DOUBLE)")


_PARTS = "string_split(translate(coalesce(product_category_tree, 'nan'), '\"[]', ''), '>>')"

RAW = f"""
raw_cat AS (
  SELECT p.p_partkey AS source_ord,
         CASE WHEN p.p_size = 1 THEN NULL WHEN p.p_size = 2 THEN ' ab ' ELSE ' ' || p.p_name || ' ' END AS product_name,
         CASE WHEN p.p_size % 5 = 0 THEN NULL ELSE 'Rs ' || {_price_txt('p.p_retailprice')} END AS discounted_price,
         CASE WHEN p.p_size % 10 = 0 THEN 'abc' ELSE {_price_txt('p.p_retailprice + 100.0')} END AS retail_price,
         CASE WHEN p.p_size % 7 = 0 THEN 'No rating available'
              ELSE CAST(p.p_size // 8 AS VARCHAR) || '.' || CAST(p.p_size % 8 AS VARCHAR) END AS product_rating,
         d.text AS description,
         CASE WHEN p.p_size % 11 = 0 THEN NULL WHEN p.p_size % 13 = 0 THEN '["' || p.p_type || '"]'
              ELSE '["' || p.p_type || ' >> ' || p.p_brand || ' >> ' || p.p_name || '"]' END AS product_category_tree,
         CASE WHEN p.p_size % 9 = 0 THEN NULL ELSE p.p_brand END AS brand
  FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey
)"""

CLEAN = f"""
cat_parsed AS (
  SELECT source_ord,
         {_strip("coalesce(product_name, 'Unknown Product')")} AS product_name,
         {_num('discounted_price')} AS discounted_price,
         {_num('retail_price')} AS retail_price,
         coalesce({_num('discounted_price')}, {_num('retail_price')}, 999.0) AS price,
         least(greatest(coalesce(TRY_CAST(product_rating AS DOUBLE), 3.5), 1.0), 5.0) AS product_rating,
         {_strip("coalesce(description, '')")} AS description,
         {_strip(_PARTS + "[1]")} AS main_category,
         {_strip(f"CASE WHEN len({_PARTS}) > 1 THEN {_PARTS}[2] ELSE {_PARTS}[1] END")} AS sub_category,
         {_strip("coalesce(brand, 'Unknown')")} AS brand
  FROM raw_cat
),
cat_clean AS (
  SELECT * FROM cat_parsed WHERE price > 0 AND length(product_name) > 3
  QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY source_ord) = 1
),
top_cats AS (
  SELECT main_category, n, CAST(row_number() OVER (ORDER BY n DESC, main_category) AS INTEGER) AS category_rank
  FROM (SELECT main_category, count(*) AS n FROM cat_clean GROUP BY 1)
  QUALIFY category_rank <= 10
)"""

SAMPLE = """
cat_sample AS (
  SELECT c.*, CAST(row_number() OVER (ORDER BY t.category_rank, c.draw) AS INTEGER) AS sample_pos
  FROM (
    SELECT *, row_number() OVER (PARTITION BY main_category ORDER BY md5(CAST(source_ord AS VARCHAR) || ':42'), source_ord) AS draw
    FROM cat_clean WHERE main_category IN (SELECT main_category FROM top_cats)
  ) c JOIN top_cats t ON t.main_category = c.main_category
  WHERE c.draw <= 200 // (SELECT count(*) FROM top_cats)
  QUALIFY sample_pos <= 200
)"""

DIMS = """
dim_mains AS (SELECT main_category AS name, min(source_ord) AS f FROM cat_clean GROUP BY 1),
dim_subs AS (
  SELECT sub_category AS name, min(source_ord) AS f, arg_min(main_category, source_ord) AS parent
  FROM cat_clean GROUP BY 1
),
dim_main_ids AS (SELECT name, row_number() OVER (ORDER BY f) AS category_id FROM dim_mains),
dim_sub_ids AS (
  SELECT name, parent, row_number() OVER (ORDER BY f) + (SELECT count(*) FROM dim_mains) AS category_id
  FROM dim_subs WHERE name NOT IN (SELECT name FROM dim_mains) AND name <> parent
),
category_dim_t AS (
  SELECT CAST(category_id AS BIGINT) AS category_id, name, CAST(NULL AS BIGINT) AS parent_id FROM dim_main_ids
  UNION ALL
  SELECT CAST(s.category_id AS BIGINT), s.name, CAST(m.category_id AS BIGINT)
  FROM dim_sub_ids s JOIN dim_main_ids m ON m.name = s.parent
),
cat_numbered AS (
  SELECT *, CAST(row_number() OVER (ORDER BY source_ord) AS BIGINT) AS product_id FROM cat_clean
),
product_dim_t AS (
  SELECT n.product_id, n.product_name AS name, n.description, CAST(n.price AS DOUBLE) AS price,
         CAST(coalesce(m.category_id, 1) AS BIGINT) AS category_id, n.product_rating AS avg_rating,
         CAST(0 AS BIGINT) AS review_count, CAST(NULL AS TIMESTAMP) AS created_at, n.source_ord
  FROM cat_numbered n LEFT JOIN dim_main_ids m ON m.name = n.main_category
),
ptag_list AS (
  SELECT product_id,
         [CASE WHEN brand NOT IN ('Unknown', 'nan') THEN lower(brand) END, lower(main_category), lower(sub_category)] AS l
  FROM cat_numbered
),
ptag_pos AS (SELECT product_id, unnest(l) AS tag, generate_subscripts(l, 1) AS pos FROM ptag_list),
ptag_first AS (SELECT product_id, tag, min(pos) AS pos FROM ptag_pos WHERE tag IS NOT NULL GROUP BY 1, 2),
product_tag_dim_t AS (
  SELECT CAST(product_id * 1048576 + row_number() OVER (PARTITION BY product_id ORDER BY pos) AS BIGINT) AS tag_id,
         product_id, tag
  FROM ptag_first WHERE length(tag) > 1
)"""
