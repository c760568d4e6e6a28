"""Interaction cleaning (D1-D10): enrich, dedup, activity filter, score, split.

Each step is DataFrame -> DataFrame and the pipeline is a ``transform`` chain.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartlens.functions.scoring import event_precedence, event_score
from cartlens.operators.ordering import first_k_flag
from cartlens.session import materialised

CLEAN_COLUMNS = ["interaction_id", "user_id", "product_id", "event_type", "rating", "session_id", "event_time",
                 "category_id", "product_avg_rating", "score", "score_norm"]


def enrich(interactions: DataFrame, products: DataFrame) -> DataFrame:
    """S3: inner join to products for ``category_id`` and ``product_avg_rating``."""
    p = products.select("product_id", "category_id", F.col("avg_rating").alias("product_avg_rating"))
    return interactions.join(p, "product_id", "inner").select(
        "interaction_id", "user_id", "product_id", "event_type", "rating", "session_id", "event_time",
        "category_id", "product_avg_rating")


def dedup(df: DataFrame) -> DataFrame:
    """One row per (user, product), the highest-precedence event wins.

    Unknown event types have null precedence and lose to every known type.
    Tie-break (ours; the reference's sort is unstable): interaction_id,
    event_time, session_id, rating.  ``row_number() = 1`` runs as a partial
    ``WindowGroupLimit`` on the map side, so a hot (user, product) pair is cut
    to one row per input partition before the shuffle.
    """
    w = Window.partitionBy("user_id", "product_id").orderBy(
        event_precedence(F.col("event_type")).desc_nulls_last(),
        F.col("interaction_id").asc_nulls_last(),
        F.col("event_time").asc_nulls_last(),
        F.col("session_id").asc_nulls_last(),
        F.col("rating").asc_nulls_last(),
    )
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def without_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` with a known key that is not among ``ids`` (one column, ``key``), which are written first.

    Spark knows the size of a written list: a short one is broadcast, so the rows stay where they are, and only a
    long one costs an exchange of the rows.
    """
    return df.where(F.col(key).isNotNull()).join(materialised(ids, "ids"), key, "left_anti")


def _active(df: DataFrame, key: str, least: int) -> tuple[DataFrame, bool]:
    """(ids, keep): the ids with ``least`` rows or more (keep), or those with fewer if they are not the larger part; written."""
    counts = materialised(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "activity")
    n_ids, n_few = counts.agg(F.count(F.lit(1)), F.count_if(F.col("_n") < least)).first()
    keep = 2 * n_few > n_ids
    return counts.filter(F.col("_n") >= least if keep else F.col("_n") < least).select(key), keep


def activity_filter(df: DataFrame, min_user: int = 3, min_product: int = 3) -> DataFrame:
    """D3: keep users and products with enough rows, both counted on the same input (one pass).

    ``df`` is read once for each count and once for the rows, so it should be a written table.  The shorter of the
    two lists of an entity, ids that stay and ids that go, is written (``without_ids``).
    """
    lists = [(key, *_active(df, key, least)) for key, least in (("user_id", min_user), ("product_id", min_product))]
    for key, ids, keep in lists:
        df = df.join(materialised(ids, "ids"), key, "left_semi") if keep else without_ids(df, key, ids)
    return df


def assign_scores(df: DataFrame) -> DataFrame:
    """D4-D5."""
    return (df.withColumn("score", event_score(F.col("event_type"), F.col("rating")))
            .withColumn("score_norm", F.col("score") / F.lit(5.0)))


def fill_missing(df: DataFrame) -> DataFrame:
    """After scoring, rating -> 0.0 and session_id -> -1."""
    return (df.withColumn("rating", F.coalesce(F.col("rating"), F.lit(0.0)).cast("double"))
            .withColumn("session_id", F.coalesce(F.col("session_id"), F.lit(-1)).cast("bigint")))


def deduped_enriched(interactions: DataFrame, products: DataFrame) -> DataFrame:
    """S3 + D2: one row per (user, product) with the product fields.

    The dedup runs before the product join (same result: the inner join keeps
    or drops all rows of a product together), so the (user, product) shuffle
    spreads a hot product over tasks and the join sees one row per pair.
    """
    return enrich(dedup(interactions), products)


def score_filtered(deduped: DataFrame, min_user: int = 3, min_product: int = 3) -> DataFrame:
    """D3 -> D4/D5 -> D6 on the deduplicated rows."""
    return (activity_filter(deduped, min_user, min_product)
            .transform(assign_scores)
            .transform(fill_missing)
            .select(*CLEAN_COLUMNS))


def clean(interactions: DataFrame, products: DataFrame, min_user: int = 3, min_product: int = 3) -> DataFrame:
    """S3 -> D2 -> D3 -> D4/D5 -> D6; the deduplicated rows are written, since the activity filter reads them three times."""
    return score_filtered(materialised(deduped_enriched(interactions, products), "dedup"), min_user, min_product)


def flag_train(clean_df: DataFrame, test_ratio: float = 0.2) -> DataFrame:
    """``is_train`` marks the first ``int(n * (1 - test_ratio))`` rows by event time.

    Order key (event_time, user_id, product_id) is unique after dedup.
    """
    n = clean_df.count()
    k = int(n * (1 - test_ratio))
    return first_k_flag(clean_df, "event_time", ["user_id", "product_id"], k, flag_col="is_train")


def parse_event_time(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Event time from text; null where the text does not fit the pattern."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def warm_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test rows whose user and product both occur in train.

    The ids that do not occur are looked for first and written: they are few in most splits, and then the test rows
    need no exchange (``without_ids``).
    """
    unseen = [(key, test.select(key).distinct().join(train.select(key).distinct(), key, "left_anti"))
              for key in ("user_id", "product_id")]
    for key, ids in unseen:
        test = without_ids(test, key, ids)
    return test


class CleanResult:
    """The tables of a cleaning job; ``test`` may be a function, called when the test rows are first asked for."""

    def __init__(self, clean: DataFrame, train: DataFrame, test: DataFrame | Callable[[], DataFrame],
                 deduped: DataFrame | None = None):
        self.clean, self.train, self.deduped = clean, train, deduped
        self._test = test

    @cached_property
    def test(self) -> DataFrame:
        return self._test() if callable(self._test) else self._test


def run(interactions: DataFrame, products: DataFrame, min_user: int = 3, min_product: int = 3,
        test_ratio: float = 0.2, materialize: bool = True) -> CleanResult:
    """The whole cleaning job.

    With ``materialize`` the clean table is written to the shared folder
    before the split reads it several times, which also cuts lineage so a lost
    executor does not replay the dedup.  The split itself is not written: it is
    a condition on the clean rows beside the few ranked ones of one time bucket.
    """
    d = deduped_enriched(interactions, products)
    if materialize:
        d = materialised(d, "dedup")  # read three times by the activity filter
    c = score_filtered(d, min_user, min_product)
    if materialize:
        c = materialised(c, "clean")
    flagged = flag_train(c, test_ratio)
    train = flagged.filter(F.col("is_train")).drop("is_train")
    test_all = flagged.filter(~F.col("is_train")).drop("is_train")
    return CleanResult(clean=c, train=train, test=lambda: warm_test(train, test_all), deduped=d)


def diagnostics(interactions: DataFrame, products: DataFrame, result: CleanResult | None = None,
                min_user: int = 3, min_product: int = 3, test_ratio: float = 0.2) -> DataFrame:
    """Rows, users, products and score range after each stage, one row per stage, an empty one included.

    Pass the ``CleanResult`` of an earlier ``run`` to reuse its materialised
    tables instead of recomputing them.  Scoring neither adds nor drops rows,
    so the filtered stage is counted on the scored rows.  Every row stands once
    by its user and once by its product in one aggregate for all stages, which
    gives rows and distinct ids from a single exchange of partial sums.
    """
    if result is None:
        result = run(interactions, products, min_user, min_product, test_ratio, materialize=False)
    deduped = result.deduped if result.deduped is not None else deduped_enriched(interactions, products)
    stages = [("loaded", enrich(interactions, products), False), ("dedup", deduped, False), ("filtered", result.clean, False),
              ("scored", result.clean, True), ("train", result.train, True), ("test", result.test, True)]
    rows = None
    for order, (_, d, with_score) in enumerate(stages, start=1):
        score = F.col("score").cast("double") if with_score else F.lit(None).cast("double")
        part = d.select(F.lit(order).alias("stage_order"), "user_id", "product_id", score.alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    sides = F.array(F.struct(F.lit("user").alias("side"), F.col("user_id").alias("id")),
                    F.struct(F.lit("product").alias("side"), F.col("product_id").alias("id")))
    by_id = (rows.select("stage_order", "score", F.explode(sides).alias("s")).groupBy("stage_order", "s.side", "s.id")
             .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")))
    empty = rows.sparkSession.range(1, len(stages) + 1, 1, 1).select(
        F.col("id").cast("int").alias("stage_order"), F.lit(None).cast("string").alias("side"),
        F.lit(None).cast(by_id.schema["id"].dataType).alias("id"), F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    user, product = F.col("side") == "user", F.col("side") == "product"
    names = F.array(*[F.lit(name) for name, _, _ in stages])
    return by_id.unionByName(empty).groupBy("stage_order").agg(
        F.sum(F.when(user, F.col("n")).otherwise(F.lit(0))).alias("n_rows"),
        F.count_if(user & F.col("id").isNotNull()).alias("n_users"),
        F.count_if(product & F.col("id").isNotNull()).alias("n_products"),
        F.min("low").alias("min_score"), F.max("high").alias("max_score"),
    ).select(F.element_at(names, F.col("stage_order")).alias("stage"), "stage_order", "n_rows", "n_users", "n_products",
             "min_score", "max_score")
