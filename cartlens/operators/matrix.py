"""User x item score matrix (M1-M7): long as (user_id, product_id, score), or as sparse rows per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartlens.operators.ordering import global_row_index
from cartlens.session import materialised


def user_item_scores(train: DataFrame) -> DataFrame:
    """M1/M2: max score per (user, product); the sparse matrix as triples."""
    return train.groupBy("user_id", "product_id").agg(F.max("score").alias("score"))


#: Columns of a numbered piece of a matrix row, and so the most entries that one has.
ROW_COLUMNS = 4_096


def matrix_rows(scores: DataFrame, items: DataFrame, columns: int = ROW_COLUMNS) -> DataFrame:
    """M1 as one sparse row per user: (user_id, chunk, n, idx, scores), the row pivot without a dense table.

    ``scores`` is the long matrix and ``items`` the column numbers (product_id, idx).  ``idx`` holds the columns of the stored
    values, rising, and ``scores`` the values beside them; a missing column is 0.  A row comes in chunks of ``columns`` columns
    (chunk = idx div columns), so a user with any number of products, or a catalogue of any size, has pieces of bounded size, and
    a cell is found in the one chunk that its column lies in.  There is no cap on columns.
    """
    chunk = F.floor(F.col("idx") / F.lit(columns)).cast("long")
    rows = scores.join(items, "product_id").groupBy("user_id", chunk.alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "score"))).alias("cells"))
    return rows.select("user_id", "chunk", F.size("cells").alias("n"), F.col("cells.idx").alias("idx"),
                       F.col("cells.score").alias("scores"))


def matrix_cells(rows: DataFrame, items: DataFrame, wanted: DataFrame, columns: int = ROW_COLUMNS) -> DataFrame:
    """(user_id, product_id, score) of each wanted (user_id, product_id): the stored value, or 0 where there is none.

    Cells outside the matrix, of users or products without any score, are left out.  Each cell meets one chunk of its user's row,
    so the work follows the wanted cells.  ``rows`` is read for its users and for its values, so it should be a written table.
    The users are written too, as a list of a known size: a short one is broadcast, and cells of other users end before any exchange.
    """
    known = materialised(rows.select("user_id").distinct(), "ids")
    at = (wanted.select("user_id", "product_id").join(known, "user_id", "left_semi").distinct().join(items, "product_id")
          .withColumn("chunk", F.floor(F.col("idx") / F.lit(columns)).cast("long")))
    stored = rows.select("user_id", "chunk", F.col("idx").alias("_at"), "scores")
    place = F.array_position("_at", F.col("idx"))
    return at.join(stored, ["user_id", "chunk"], "left").select(
        "user_id", "product_id", F.when(place > 0, F.element_at("scores", place.cast("int"))).otherwise(F.lit(0.0)).alias("score"))


def id_maps(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M3: 0-based user and item indexes in first-seen order of the time-ordered train rows.

    An entity's first-seen key is the smallest (event_time, user_id,
    product_id) among its rows; the dense index then comes from the
    range-partitioned ``global_row_index`` (no single-task window).
    """
    first = F.min(F.struct("event_time", "user_id", "product_id")).alias("_k")
    keys = [F.col("_k.event_time").alias("_t"), F.col("_k.user_id").alias("_fu"), F.col("_k.product_id").alias("_fp")]
    first_u = train.groupBy("user_id").agg(first).select("user_id", *keys)
    first_i = train.groupBy("product_id").agg(first).select("product_id", *keys)
    # written: they are counted and then ordered, and the second pass is not to read the train rows again
    users = global_row_index(materialised(first_u, "first_seen"), ["_t", "_fu", "_fp"], "idx").select("user_id", "idx")
    items = global_row_index(materialised(first_i, "first_seen"), ["_t", "_fu", "_fp"], "idx").select("product_id", "idx")
    return users, items


def matrix_stats(scores: DataFrame) -> DataFrame:
    """M4-M6: users, products, stored values (M5: shape and stored-value count) and sparsity in one aggregate."""
    agg = scores.agg(F.countDistinct("user_id").alias("n_users"),
                     F.countDistinct("product_id").alias("n_products"),
                     F.count(F.lit(1)).alias("n_stored"))
    return agg.withColumn(
        "sparsity",
        F.round(F.lit(1.0) - F.col("n_stored").cast("double")
                / (F.col("n_users").cast("double") * F.col("n_products").cast("double")), 10))


def event_breakdown(train: DataFrame) -> DataFrame:
    """M7: rows per event type and share of all rows in percent.

    The total is a window over the grouped table (one row per event type).
    """
    counts = train.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("event_type", "n",
                         F.round(F.col("n").cast("double") * F.lit(100.0) / total.cast("double"), 6).alias("pct"))
