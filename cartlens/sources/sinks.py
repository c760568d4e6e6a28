"""Writers and readers of the pipeline's persisted tables.

Everything is Parquet written with ``mode("overwrite")`` so a re-run after a
failure replaces partial output.  Fitted "models" are plain tables: the
item-pair table, the vocabulary and the TF-IDF triples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _write(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None) -> str:
    w = df.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_cleaned(clean: DataFrame, train: DataFrame, test: DataFrame, base: str) -> dict[str, str]:
    """K1: interactions_clean, train and test."""
    return {name: _write(df, f"{base}/{name}") for name, df in
            (("interactions_clean", clean), ("train", train), ("test", test))}


def write_matrix(scores: DataFrame, base: str) -> str:
    """K2: the user x item matrix as (user_id, product_id, score) triples, clustered by user."""
    return _write(scores.repartition("user_id").sortWithinPartitions("user_id", "product_id"),
                  f"{base}/user_item_scores")


def write_dimensions(categories: DataFrame, products: DataFrame, tags: DataFrame, base: str) -> dict[str, str]:
    """K3: category, product and tag dimensions."""
    return {name: _write(df, f"{base}/{name}") for name, df in
            (("categories", categories), ("products", products), ("product_tags", tags))}


def write_recommendations(recs: DataFrame, base: str) -> str:
    """K4: the recommendations table, partitioned by algorithm."""
    return _write(recs, f"{base}/recommendations", ["algo_used"])


def save_models(base: str, item_pairs: DataFrame | None = None, vocab: DataFrame | None = None,
                weights: DataFrame | None = None) -> dict[str, str]:
    """K6: fitted tables instead of pickled objects."""
    out = {}
    for name, df in (("item_pairs", item_pairs), ("vocabulary", vocab), ("tfidf", weights)):
        if df is not None:
            # two rows for each pair of items that met: worth the better compression
            out[name] = _write(df, f"{base}/{name}", compression="zstd" if name == "item_pairs" else None)
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a persisted table back."""
    return spark.read.parquet(path)
