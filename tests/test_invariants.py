"""Invariants of the registered jobs on the sf0.001 driver tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF0001


@pytest.fixture(scope="module")
def q():
    import __spark_entry__ as entry
    return entry.queries()


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["rank", "product_id", "name", "score"]
    assert 0 < df.count() <= 10


def test_similarity_symmetric_and_bounded(spark, q):
    s = q["item_similarity"](spark, SF0001)
    assert s.filter((F.col("similarity") <= 0) | (F.col("similarity") > 1.0 + 1e-9)).count() == 0
    back = s.select(F.col("other_product_id").alias("product_id"), F.col("product_id").alias("other_product_id"),
                    F.col("similarity").alias("back"))
    j = s.join(back, ["product_id", "other_product_id"], "full_outer")
    assert j.filter(F.col("similarity").isNull() | F.col("back").isNull()
                    | (F.abs(F.col("similarity") - F.col("back")) > 1e-9)).count() == 0


@pytest.mark.parametrize("name", ["user_based_recs", "item_based_recs", "cf_blend", "content_recs", "hybrid_recs"])
def test_lists_are_unseen_bounded_and_ranked(spark, q, name):
    from cartlens.plans.context import inputs
    recs = q[name](spark, SF0001)
    train = inputs(spark, SF0001).train
    if name != "hybrid_recs":
        assert recs.join(train, ["user_id", "product_id"], "left_semi").count() == 0
    per_user = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("mx"),
                                           F.countDistinct("rank").alias("nd"))
    assert per_user.filter((F.col("n") > 10) | (F.col("mx") != F.col("n")) | (F.col("nd") != F.col("n"))).count() == 0


def test_split_disjoint_and_ordered(spark, q):
    s = q["temporal_split"](spark, SF0001)
    train = s.filter("split = 'train'")
    test = s.filter("split = 'test'")
    assert train.join(test, ["user_id", "product_id"], "inner").count() == 0
    assert train.agg(F.max("event_time")).first()[0] <= test.agg(F.min("event_time")).first()[0]
    n = s.count()
    assert train.count() == int(n * 0.8)


def test_precision_not_above_hit_rate(spark, q):
    r = q["ranking_metrics"](spark, SF0001).first()
    assert r["precision"] <= r["hit_rate"] and 0 <= r["recall"] <= 1


def test_global_row_index_is_contiguous(spark):
    from cartlens.operators.ordering import global_row_index
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = global_row_index(df, ["k"], "i", num_partitions=7).orderBy("k").collect()
    assert [r["i"] for r in got] == list(range(5000))


def test_blocked_cf_lists_equal_join_plan(spark):
    from cartlens.operators.cf import cf_scores, ranked_lists
    from cartlens.operators.cf_blocks import blocked_lists
    from cartlens.plans.context import inputs
    i = inputs(spark, SF0001)
    keys = ["list", "user_id", "product_id", "rank"]
    a = blocked_lists(i.train, i.cf_pairs, 40, 40, 10, hist_per_group=1000, min_item_blocks=3)
    b = ranked_lists(cf_scores(i.train, i.cf_pairs), 40, 40, 10)
    a = a.select(*keys, F.round("score", 8).alias("s"))
    b = b.select(*keys, F.round("score", 8).alias("s"))
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_users_split_equals_join_plan(spark):
    from cartlens.operators.cf import cf_scores, ranked_lists
    from cartlens.operators.cf_blocks import cf_lists
    from cartlens.plans.context import inputs
    i = inputs(spark, SF0001)
    sizes = i.train.groupBy("user_id").count()
    threshold = sorted(r["count"] for r in sizes.collect())[-5]  # a handful of users count as hot
    keys = ["list", "user_id", "product_id", "rank"]
    a = cf_lists(i.train, i.cf_pairs, 40, 40, 10, hot_user_rows=threshold - 1)
    b = ranked_lists(cf_scores(i.train, i.cf_pairs), 40, 40, 10)
    a = a.select(*keys, F.round("score", 8).alias("s"))
    b = b.select(*keys, F.round("score", 8).alias("s"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_runs_from_foreign_working_directory(tmp_path):
    """The driver imports __spark_entry__ from elsewhere: grouped-map kernels must not need the package on workers."""
    import subprocess
    import sys
    repo = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.queries()['similar_products'](s, %r).count(), e.entry(s).count())\n" % (repo, SF0001))
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


def test_cohort_scoring_equals_full_run_rows(spark):
    from cartlens.operators.cf_blocks import cf_lists
    from cartlens.plans.context import inputs
    i = inputs(spark, SF0001)
    cohort = i.train.select("user_id").distinct().orderBy("user_id").limit(7)
    part = cf_lists(i.train, i.cf_pairs, 40, 40, 10, users=cohort)
    full = i.cf_lists.join(cohort, "user_id", "left_semi")
    keys = ["list", "user_id", "product_id", "rank"]
    a = part.select(*keys, F.round("score", 8).alias("s"))
    b = full.select(*keys, F.round("score", 8).alias("s"))
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_cohort_path_without_pair_table(spark):
    from cartlens.operators.cf import cohort_scores, ranked_lists
    from cartlens.plans.context import inputs
    i = inputs(spark, SF0001)
    cohort = i.train.select("user_id").distinct().orderBy("user_id").limit(5)
    keys = ["list", "user_id", "product_id", "rank"]
    a = ranked_lists(cohort_scores(i.train, cohort), 40, 40, 10).select(*keys, F.round("score", 8).alias("s"))
    b = i.cf_lists.join(cohort, "user_id", "left_semi").select(*keys, F.round("score", 8).alias("s"))
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
