"""Dashboard aggregates (A1-A6) and table row counts (K5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Placeholder search page used to build product links (the base is a parameter).
DEFAULT_SEARCH_BASE = "https://shop.example/search?q="


def catalog_view(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products with their category name (inner join: unknown categories drop out)."""
    cats = categories.select("category_id", F.col("name").alias("category_name"))
    return products.join(cats, "category_id", "inner")


def kpis(users: DataFrame, catalog: DataFrame, interactions: DataFrame) -> DataFrame:
    """A1: one row of headline counts, from a single aggregate over the tagged union of the three inputs."""
    none = F.lit(None).cast("string")
    tagged = (users.select(F.lit("u").alias("_t"), none.alias("_c"))
              .unionByName(catalog.select(F.lit("p").alias("_t"), F.col("category_name").alias("_c")))
              .unionByName(interactions.select(F.lit("i").alias("_t"), none.alias("_c"))))

    def count_of(tag):
        return F.sum(F.when(F.col("_t") == tag, 1).otherwise(0)).cast("bigint")
    return tagged.agg(count_of("u").alias("n_users"), count_of("p").alias("n_products"),
                      count_of("i").alias("n_interactions"),
                      F.countDistinct(F.when(F.col("_t") == "p", F.col("_c"))).alias("n_categories"))


def event_counts(interactions: DataFrame) -> DataFrame:
    """A2: interactions per event type."""
    return interactions.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def category_counts(catalog: DataFrame) -> DataFrame:
    """A3: products per category and share in percent (window over the grouped, one-row-per-category table)."""
    c = catalog.groupBy(F.col("category_name").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return c.select("category", "n", F.round(F.col("n").cast("double") * F.lit(100.0) / total, 6).alias("share"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """A4/A5: equal-width histogram over [min, max]; the maximum falls in the last bin.

    Non-empty bins only: (bin, bin_lo, bin_hi, n).  The range is one aggregate
    whose two scalars are fixed into the bin expression.
    """
    rng = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = rng["lo"], rng["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n bigint")
    x = F.col(col)
    lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
    if hi > lo:
        b = F.least(F.floor((x - lo_c) / (hi_c - lo_c) * F.lit(float(bins))) + 1, F.lit(bins))
    else:
        b = F.lit(1)
    counted = df.filter(x.isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi_c - lo_c) / F.lit(float(bins))
    return counted.select("bin", F.round(lo_c + (F.col("bin") - 1) * width, 10).alias("bin_lo"),
                          F.round(lo_c + F.col("bin") * width, 10).alias("bin_hi"), "n")


def search_url(name: Column, base: str = DEFAULT_SEARCH_BASE) -> Column:
    """Search link: base + name with spaces replaced by ``+``."""
    return F.concat(F.lit(base), F.replace(name, F.lit(" "), F.lit("+")))


def product_page(catalog: DataFrame, tags: DataFrame, similar: DataFrame, popular_ids: list[int],
                 base: str = DEFAULT_SEARCH_BASE) -> DataFrame:
    """Per product -- details, its tags, its similar products (in rank order) and the popular list.

    ``similar``: (product_id, other_product_id, similarity, rank).  The popular
    panel does not depend on the product (it is the global popularity list),
    so it is a literal.
    """
    t = tags.groupBy("product_id").agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("tag_id", "tag"))),
                                      lambda x: x["tag"])).alias("tags"))
    s = similar.groupBy("product_id").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "other_product_id"))),
                                     lambda x: x["other_product_id"].cast("string"))).alias("similar_ids"))
    pop = ",".join(str(x) for x in popular_ids)
    return (catalog.select("product_id", "name", F.col("category_name").alias("category"), "price", "avg_rating")
            .join(t, "product_id", "left").join(s, "product_id", "left")
            .select("product_id", "name", "category", "price", "avg_rating",
                    F.coalesce("tags", F.lit("")).alias("tags"),
                    F.coalesce("similar_ids", F.lit("")).alias("similar_ids"),
                    F.lit(pop).alias("popular_ids"), search_url(F.col("name"), base).alias("search_url")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """K5: (table_name, n_rows) per table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def lookup_products(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """S8 in bulk: one row per requested id, product columns null when the id is unknown (left join)."""
    return ids.select("product_id").distinct().join(catalog, "product_id", "left")


def tags_of(tags: DataFrame, ids: DataFrame) -> DataFrame:
    """S9 in bulk: the tags of the requested products, in tag_id order per product."""
    return tags.join(ids.select("product_id").distinct(), "product_id", "left_semi")
