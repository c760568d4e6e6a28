"""Registered queries: catalogue cleaning and dimension build."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cartlens.operators import catalogue as cg
from cartlens.operators.ordering import global_row_index
from cartlens.plans import oracle_base as ob
from cartlens.plans import oracle_catalogue as oc
from cartlens.plans.registry import query
from cartlens.session import ensure_checkpoint_dir, materialised
from cartlens.sources import tables

BASE = [oc.RAW, oc.CLEAN]


def _clean(spark, sf_dir):
    return cg.clean_catalogue(tables.raw_catalogue(spark, sf_dir))


def _written(spark, sf_dir, text=False):
    """The cleaned catalogue as a written table, for queries that read it several times; its texts only where they are asked for."""
    clean = _clean(spark, sf_dir)
    return materialised(clean if text else clean.drop("description"), "catalogue")


@query("catalog_clean", ob.with_ctes(*BASE, body="SELECT * FROM cat_clean"))
def catalog_clean(spark, sf_dir):
    """C1-C10 on the raw catalogue text derived from ``part`` and ``documents``."""
    return _clean(spark, sf_dir)


_FIELDS = ("product_name", "discounted_price", "retail_price", "product_rating", "description", "product_category_tree", "brand")


@query("catalogue_csv", ob.with_ctes(oc.RAW, body=f"""
SELECT 'row' AS kind, {", ".join(_FIELDS)} FROM raw_cat
UNION ALL
SELECT 'broken', p_name || ',' || p_brand, {", ".join(["NULL"] * 6)} FROM part WHERE p_size % 5 = 0
UNION ALL
SELECT 'broken', {" || ',' || ".join(["p_brand"] * 9)}, {", ".join(["NULL"] * 6)} FROM part WHERE p_size % 7 = 0"""))
def catalogue_csv(spark, sf_dir):
    """The raw catalogue and rows of too few and too many fields, written as CSV files and read back, broken ones apart."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cartlens-{spark.conf.get('spark.app.id')}/csv-{uuid.uuid4().hex[:12]}"

    def put(df):
        (df.write.mode("append").option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))

    part = tables.read(spark, sf_dir, "part")
    put(tables.raw_catalogue(spark, sf_dir).select(*_FIELDS))
    put(part.where("p_size % 5 = 0").select("p_name", "p_brand"))
    put(part.where("p_size % 7 = 0").select(*[F.col("p_brand").alias(f"b{k}") for k in range(9)]))
    good = cg.read_catalogue_csv(spark, path).select(F.lit("row").alias("kind"), *_FIELDS)
    broken = cg.broken_rows(spark, path).select(F.lit("broken").alias("kind"), F.regexp_replace("record", "[\\r\\n]+$", "").alias("product_name"),
                                                *[F.lit(None).cast("string").alias(c) for c in _FIELDS[1:]])
    return good.unionByName(broken)


@query("catalog_summary", ob.with_ctes(*BASE, body="""
SELECT count(*) AS n_products, count(DISTINCT main_category) AS n_categories, min(price) AS min_price,
       max(price) AS max_price FROM cat_clean"""))
def catalog_summary(spark, sf_dir):
    return cg.catalogue_summary(_clean(spark, sf_dir))


@query("top_categories", ob.with_ctes(*BASE, body="SELECT * FROM top_cats"))
def top_categories(spark, sf_dir):
    return cg.top_categories(_clean(spark, sf_dir), 10).select(
        "main_category", "n", F.col("category_rank").cast("int").alias("category_rank"))


@query("stratified_sample", ob.with_ctes(*BASE, oc.SAMPLE, body="SELECT * EXCLUDE (draw) FROM cat_sample"))
def stratified_sample(spark, sf_dir):
    """Up to 200 rows spread evenly over the 10 largest categories (seeded, repeatable draw)."""
    s = cg.stratified_sample(_written(spark, sf_dir, text=True), 200, 10, 42)
    return s.withColumn("sample_pos", F.col("sample_pos").cast("int"))


@query("sample_category_counts", ob.with_ctes(*BASE, oc.SAMPLE, body="""
SELECT main_category, count(*) AS n FROM cat_sample GROUP BY main_category"""))
def sample_category_counts(spark, sf_dir):
    """C14."""
    return cg.category_counts(cg.stratified_sample(_written(spark, sf_dir), 200, 10, 42))


@query("category_dim", ob.with_ctes(*BASE, oc.DIMS, body="SELECT * FROM category_dim_t"))
def category_dim(spark, sf_dir):
    """C15 over the whole cleaned catalogue."""
    return cg.category_dim(_written(spark, sf_dir))


@query("product_dim", ob.with_ctes(*BASE, oc.DIMS, body="SELECT * FROM product_dim_t"))
def product_dim(spark, sf_dir):
    """C16 over the whole cleaned catalogue, ids in file order."""
    clean = _written(spark, sf_dir, text=True)
    return cg.product_dim(clean, cg.category_dim(clean))


@query("product_tags", ob.with_ctes(*BASE, oc.DIMS, body="SELECT * FROM product_tag_dim_t"))
def product_tags(spark, sf_dir):
    """C17: tags of every cleaned catalogue product."""
    numbered = global_row_index(_written(spark, sf_dir), ["source_ord"], "product_id", start=1)
    return cg.product_tags(numbered)
