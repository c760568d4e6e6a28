"""Driver tables -> the six reference tables (S1, FIXTURES section 2).

The driver ships TPC-H-like Parquet tables.  These functions derive the
catalogue (categories, products, product_tags), users and two interaction
logs from them with plain joins and aggregates, so every downstream job
grows with the input.  Only needed columns are selected before any join so
Parquet scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.functions.numeric import pair_id
from cartlens.operators.ordering import global_row_index


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- interactions

def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse, large interaction log: one row per line item, user = the order's customer."""
    l = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = l.join(o, l.l_orderkey == o.o_orderkey, "inner")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    event_type = (
        F.when((flag == "N") & (status == "O"), "purchase")
        .when(flag == "N", "rating")
        .when((flag == "A") & (status == "O"), "add_to_cart")
        .when(flag == "A", "click")
        .otherwise("view")
    )
    rating = F.when(
        (flag == "N") & (status == "F"),
        (F.lit(1.0) + (F.col("l_quantity").cast("bigint") % 9) * F.lit(0.5)).cast("double"),
    )
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("interaction_id"),
        F.col("o_custkey").cast("bigint").alias("user_id"),
        F.col("l_partkey").cast("bigint").alias("product_id"),
        event_type.alias("event_type"),
        rating.alias("rating"),
        F.col("l_orderkey").cast("bigint").alias("session_id"),
        F.col("l_shipdate").alias("event_time"),
    )


def event_log(spark: SparkSession, sf_dir: str, rename_unknown: bool = True) -> DataFrame:
    """Dense event log; ``signup``/``error`` become add_to_cart/rating unless ``rename_unknown`` is off."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", "ts")
    et = F.col("event_type")
    if rename_unknown:
        mapped = F.when(et == "signup", "add_to_cart").when(et == "error", "rating").otherwise(et)
    else:
        mapped = et
    return e.select(
        F.col("event_id").alias("interaction_id"),
        F.col("user_id"),
        F.regexp_extract("props", r"([0-9]+)", 1).cast("bigint").alias("product_id"),
        mapped.alias("event_type"),
        F.when(et == "error", (F.lit(1.0) + (F.col("event_id") % 9) * F.lit(0.5)).cast("double")).alias("rating"),
        F.lit(None).cast("bigint").alias("session_id"),
        F.col("ts").alias("event_time"),
    )


# ------------------------------------------------------------------ catalogue

def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types are parent categories, brands are children.

    A brand's parent is the type of its lowest part key.  Ids: parents by name
    from 1, then children by name (distinct names, numbered with the
    range-partitioned row index).
    """
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    parents = part.groupBy(F.col("p_type").alias("name")).agg(F.lit(0).alias("_level"))
    children = part.groupBy(F.col("p_brand").alias("name")).agg(
        F.min_by("p_type", "p_partkey").alias("_parent_name"))
    both = parents.select("name", F.lit(0).alias("_level"), F.lit(None).cast("string").alias("_parent_name")) \
        .unionByName(children.select("name", F.lit(1).alias("_level"), "_parent_name"))
    numbered = global_row_index(both, ["_level", "name"], "category_id", start=1)
    ids = numbered.select(F.col("name").alias("_parent_name"), F.col("category_id").alias("parent_id"))
    return (numbered.join(ids, "_parent_name", "left")
            .select("category_id", "name", "parent_id"))


def products(spark: SparkSession, sf_dir: str, categories_df: DataFrame | None = None) -> DataFrame:
    """Parts as products.  The description is the whole document with doc_id = part key."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").alias("description"))
    reviews = (read(spark, sf_dir, "lineitem").select("l_partkey")
               .groupBy("l_partkey").agg(F.count(F.lit(1)).alias("review_count")))
    cats = (categories_df if categories_df is not None else categories(spark, sf_dir)) \
        .filter(F.col("parent_id").isNull()) \
        .select(F.col("name").alias("p_type"), "category_id")
    return (
        part.join(cats, "p_type", "left")
        .join(docs, part.p_partkey == docs.doc_id, "left")
        .join(reviews, part.p_partkey == reviews.l_partkey, "left")
        .select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("description"),
            F.col("p_retailprice").cast("double").alias("price"),
            F.col("category_id"),
            (F.lit(2.5) + (F.col("p_size") % 6) * F.lit(0.5)).cast("double").alias("avg_rating"),
            F.coalesce(F.col("review_count"), F.lit(0)).cast("bigint").alias("review_count"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
        )
    )


def product_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags per part: brand, type and the words of the name, lower-cased, distinct, in that order."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    raw = F.concat(F.array(F.lower("p_brand"), F.lower("p_type")), F.split(F.lower("p_name"), " "))
    kept = F.filter(F.array_distinct(raw), lambda t: F.length(t) > 1)
    return (part.select("p_partkey", F.posexplode(kept).alias("pos", "tag"))
            .select(pair_id(F.col("p_partkey"), F.col("pos") + 1).alias("tag_id"),
                    F.col("p_partkey").alias("product_id"), "tag"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("age_group"),
        F.lit(None).cast("string").alias("gender"),
        F.col("n_name").alias("location"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_active"),
    )


def price_text(price):
    """``1234.5`` -> ``1,234.50`` with integer arithmetic (identical in any SQL engine)."""
    cents = F.round(price * 100).cast("bigint")
    whole = F.floor(cents / 100).cast("bigint")
    frac = F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = F.when(whole >= 1000, F.concat((F.floor(whole / 1000)).cast("bigint").cast("string"), F.lit(","),
                                              F.lpad((whole % 1000).cast("string"), 3, "0"))) \
        .otherwise(whole.cast("string"))
    return F.concat(grouped, F.lit("."), frac)


def raw_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw catalogue text columns (the shape of the reference's CSV) built from ``part``.

    Prices become text with thousands separators and a currency prefix, the
    category tree the bracketed ``["Type >> Brand >> Name"]`` form.  Values are
    blanked or garbled by rules on ``p_size`` so the cleaner's null and error
    paths are exercised; ``source_ord`` carries file order.
    """
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.col("p_size")
    return part.join(docs, part.p_partkey == docs.doc_id, "left").select(
        F.col("p_partkey").alias("source_ord"),
        F.when(size == 1, F.lit(None)).when(size == 2, F.lit(" ab "))
        .otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("product_name"),
        F.when(size % 5 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("Rs "), price_text(F.col("p_retailprice")))).alias("discounted_price"),
        F.when(size % 10 == 0, F.lit("abc"))
        .otherwise(price_text(F.col("p_retailprice") + F.lit(100.0))).alias("retail_price"),
        F.when(size % 7 == 0, F.lit("No rating available"))
        .otherwise(F.concat((F.floor(size / 8)).cast("bigint").cast("string"), F.lit("."),
                            (size % 8).cast("string"))).alias("product_rating"),
        F.col("text").alias("description"),
        F.when(size % 11 == 0, F.lit(None))
        .when(size % 13 == 0, F.concat(F.lit('["'), F.col("p_type"), F.lit('"]')))
        .otherwise(F.concat(F.lit('["'), F.col("p_type"), F.lit(" >> "), F.col("p_brand"), F.lit(" >> "),
                            F.col("p_name"), F.lit('"]')))
        .alias("product_category_tree"),
        F.when(size % 9 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("brand"),
    )
