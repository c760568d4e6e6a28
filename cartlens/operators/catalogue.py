"""Catalogue cleaning and dimension build.

Input: the raw catalogue text columns plus ``source_ord`` (file order).  All
steps are column expressions, aggregates and joins; surrogate keys come from
the range-partitioned ``global_row_index``.  The only global windows number
at most ``k`` top categories or the ``n`` sampled rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StringType, StructField, StructType

from cartlens.functions.numeric import pair_id
from cartlens.functions.parsing import (DEFAULT_PRICE, NO_BRAND, UNKNOWN_BRAND, UNKNOWN_NAME, main_category,
                                        price_number, rating_number, strip, sub_category)
from cartlens.operators.ordering import global_row_index
from cartlens.session import materialised
from cartlens.sources.schemas import RAW_CATALOGUE


_FILE_BITS = 40  # rows of one file in a source position


BROKEN = "_corrupt_record"


def _catalogue_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the CSV files with ``source_ord``; rows that do not fit the columns have their text in ``BROKEN``.

    ``source_ord`` records file order for "keep first" semantics: the files by
    path, and the rows of a file by place.  A file with quoted line breaks is
    one task's work and so its rows are numbered in order by
    ``monotonically_increasing_id``; tasks may take files in any order, so the
    numbers are made relative to each file's first row.
    """
    schema = StructType([*RAW_CATALOGUE.fields, StructField(BROKEN, StringType())])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", BROKEN).option("quote", '"').option("escape", '"').csv(path))
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_mid"))
    files = rows.groupBy("_file").agg(F.min("_mid").alias("_first"))
    files = files.withColumn("_nr", F.row_number().over(Window.orderBy("_file")) - 1)  # a row per file
    return rows.join(files, "_file").withColumn(
        "source_ord", F.shiftleft(F.col("_nr").cast("bigint"), _FILE_BITS) + F.col("_mid") - F.col("_first")
    ).drop("_file", "_mid", "_first", "_nr")


def read_catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw catalogue CSV with an explicit all-text schema (multi-line quoted fields allowed).

    Rows with too few or too many fields are not part of it; ``broken_rows`` has them.
    """
    return _catalogue_rows(spark, path).where(F.col(BROKEN).isNull()).drop(BROKEN)


def broken_rows(spark: SparkSession, path: str) -> DataFrame:
    """(source_ord, record): position and text of the rows that the reader could not fit to the columns."""
    # written with all its columns: the reader refuses to give this one alone
    rows = materialised(_catalogue_rows(spark, path).where(F.col(BROKEN).isNotNull()), "broken-rows")
    return rows.select("source_ord", F.col(BROKEN).alias("record"))


def clean_catalogue(raw: DataFrame, max_description_chars: int | None = None) -> DataFrame:
    """Parsed, validated, de-duplicated catalogue rows.

    ``max_description_chars`` (the reference loader used 500) is off by
    default: whole descriptions are kept.
    """
    desc = strip(F.coalesce(F.col("description"), F.lit("")))  # C5
    if max_description_chars:
        desc = F.substring(desc, 1, max_description_chars)
    disc = price_number(F.col("discounted_price"))
    retail = price_number(F.col("retail_price"))
    parsed = raw.select(
        "source_ord",
        strip(F.coalesce(F.col("product_name"), F.lit(UNKNOWN_NAME))).alias("product_name"),
        disc.alias("discounted_price"),
        retail.alias("retail_price"),
        F.coalesce(disc, retail, F.lit(DEFAULT_PRICE)).alias("price"),  # C3
        rating_number(F.col("product_rating")).alias("product_rating"),
        desc.alias("description"),
        main_category(F.col("product_category_tree")).alias("main_category"),
        sub_category(F.col("product_category_tree")).alias("sub_category"),
        strip(F.coalesce(F.col("brand"), F.lit(UNKNOWN_BRAND))).alias("brand"),
    )
    valid = parsed.filter((F.col("price") > 0) & (F.length("product_name") > 3))  # C9
    # keep the first row of each name in file order; a partial WindowGroupLimit
    # trims each name to one row per input partition before the shuffle
    w = Window.partitionBy("product_name").orderBy("source_ord")
    return valid.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def catalogue_summary(clean: DataFrame) -> DataFrame:
    """C11."""
    return clean.agg(F.count(F.lit(1)).alias("n_products"),
                     F.countDistinct("main_category").alias("n_categories"),
                     F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def top_categories(clean: DataFrame, k: int = 10) -> DataFrame:
    """The k largest main categories (ties: name asc) with their rank."""
    counts = clean.groupBy("main_category").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("main_category").asc()).limit(k)
    w = Window.orderBy(F.col("n").desc(), F.col("main_category").asc())  # k rows
    return top.withColumn("category_rank", F.row_number().over(w))


def in_top_categories(clean: DataFrame, k: int = 10) -> DataFrame:
    """Rows of the top-k categories (the k-row list is broadcast)."""
    return clean.join(F.broadcast(top_categories(clean, k).select("main_category", "category_rank")),
                      "main_category", "inner")


def sample_key(ord_col, seed: int):
    """Portable seeded hash of a source position (MD5 as text)."""
    return F.md5(F.concat_ws(":", ord_col.cast("string"), F.lit(str(seed))))


def stratified_sample(clean: DataFrame, n: int = 200, k: int = 10, seed: int = 42) -> DataFrame:
    """Per top category up to ``n // (number of top categories)`` rows, drawn without replacement.

    The draw orders each category by a seeded hash of the source position,
    so it is repeatable and can be checked; it cannot reproduce NumPy's
    generator.  Output keeps category order (count desc) then draw order, as
    ``sample_pos``.
    """
    rows = in_top_categories(clean, k)
    n_top = top_categories(clean, k).count()
    per_cat = n // max(n_top, 1)
    key = sample_key(F.col("source_ord"), seed)
    w = Window.partitionBy("main_category").orderBy(key, F.col("source_ord"))
    picked = rows.withColumn("_draw", F.row_number().over(w)).filter(F.col("_draw") <= per_cat)
    # at most n rows: number them in category order then draw order
    pw = Window.orderBy("category_rank", "_draw")
    out = picked.withColumn("sample_pos", F.row_number().over(pw)).filter(F.col("sample_pos") <= n)
    return out.drop("_draw", "category_rank")


def category_counts(df: DataFrame) -> DataFrame:
    """C14."""
    return df.groupBy("main_category").agg(F.count(F.lit(1)).alias("n"))


def category_dim(products: DataFrame, order_col: str = "source_ord") -> DataFrame:
    """Main categories in first-appearance order, then sub categories whose parent is the main
    category of the sub's first row; a sub whose name is already a main category (or equals its parent)
    is skipped.  (category_id, name, parent_id).
    """
    mains = products.groupBy(F.col("main_category").alias("name")).agg(F.min(order_col).alias("_first"))
    subs = products.groupBy(F.col("sub_category").alias("name")).agg(
        F.min(order_col).alias("_first"), F.min_by("main_category", F.col(order_col)).alias("_parent"))
    mains = materialised(mains, "mains")  # a row per category, read for names, number and ids
    subs = materialised(subs.join(mains.select("name"), "name", "left_anti").filter(F.col("name") != F.col("_parent")), "subs")
    # surrogate keys in first-appearance order, numbered without a single-task window
    main_ids = global_row_index(mains, ["_first"], "category_id", start=1).select("name", "category_id")
    n_main = mains.count()
    sub_ids = global_row_index(subs, ["_first"], "category_id", start=n_main + 1).select(
        "name", "_parent", "category_id")
    parents = main_ids.select(F.col("name").alias("_parent"), F.col("category_id").alias("parent_id"))
    return (main_ids.select("category_id", "name", F.lit(None).cast("bigint").alias("parent_id"))
            .unionByName(sub_ids.join(parents, "_parent", "inner").select("category_id", "name", "parent_id")))


def product_dim(products: DataFrame, categories: DataFrame, order_col: str = "source_ord",
                max_name_chars: int | None = None, max_description_chars: int | None = None) -> DataFrame:
    """Product rows with surrogate ids in source order and the *main* category's id (default 1).

    The reference loader cut names to 200 and descriptions to 500 characters;
    both limits are optional here and off by default.
    """
    mains = categories.filter(F.col("parent_id").isNull()).select(
        F.col("name").alias("main_category"), F.col("category_id"))
    numbered = global_row_index(products, [order_col], "product_id", start=1)
    name = F.col("product_name") if not max_name_chars else F.substring("product_name", 1, max_name_chars)
    desc = F.col("description") if not max_description_chars else F.substring("description", 1, max_description_chars)
    return numbered.join(mains, "main_category", "left").select(
        "product_id", name.alias("name"), desc.alias("description"), F.col("price").cast("double").alias("price"),
        F.coalesce(F.col("category_id"), F.lit(1)).cast("bigint").alias("category_id"),
        F.col("product_rating").alias("avg_rating"), F.lit(0).cast("bigint").alias("review_count"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"), order_col)


def product_tags(product_rows: DataFrame, max_tag_chars: int | None = None) -> DataFrame:
    """C17: distinct tags per product -- lower(brand) unless Unknown/nan, lower(main), lower(sub) -- longer than 1.

    Expects (product_id, brand, main_category, sub_category).
    """
    def cut(c):
        return F.substring(c, 1, max_tag_chars) if max_tag_chars else c
    brand = F.when(~F.col("brand").isin(*NO_BRAND), cut(F.lower("brand")))
    cand = F.array(brand, cut(F.lower("main_category")), cut(F.lower("sub_category")))
    kept = F.filter(F.array_distinct(cand), lambda t: t.isNotNull() & (F.length(t) > 1))
    return product_rows.select("product_id", F.posexplode(kept).alias("pos", "tag")).select(
        pair_id(F.col("product_id"), F.col("pos") + 1).alias("tag_id"), "product_id", "tag")
