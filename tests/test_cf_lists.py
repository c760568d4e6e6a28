"""Lists from streamed neighbour histories equal the all-join plan, however users, items and batches are cut."""

import pytest
from pyspark.sql import functions as F

from cartlens.operators import cf, cf_lists
from cartlens.operators import similarity as sim


@pytest.fixture(scope="module")
def train(spark):
    rows = [(u, (u * 7 + k * k) % 60, 1.0 + (u + k) % 5) for u in range(80) for k in range(9)] + [(500, j, 2.0) for j in range(40)] \
        + [(600, 1000, 3.0)]
    return (spark.createDataFrame(rows, "user_id long, product_id long, score double")
            .groupBy("user_id", "product_id").agg(F.max("score").alias("score")).cache())


def shown(df):
    return sorted((r["list"], r["user_id"], r["rank"], r["product_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("history_rows,user_groups,step", [(None, None, None), (300, 2, 40)])
def test_lists_equal_the_join_plan(spark, train, monkeypatch, history_rows, user_groups, step):
    if step is not None:
        held = cf_lists._kernel

        def small(*cuts):
            run = held(*cuts)

            def stepped(batches):
                before, cf_lists.STEP = cf_lists.STEP, step  # the worker process outlives the test
                try:
                    yield from run(b.iloc[i:i + 3] for b in batches for i in range(0, len(b), 3))
                finally:
                    cf_lists.STEP = before
            return stepped
        monkeypatch.setattr(cf_lists, "_kernel", small)
    pairs = sim.item_pairs(train, "join")
    want = cf.ranked_lists(cf.cf_scores(train, pairs), 6, 5, 4, 0.3, 0.7)
    got = cf_lists.neighbour_lists(train, 6, 5, 4, 0.3, 0.7, history_rows=history_rows, user_groups=user_groups)
    assert shown(got) == shown(want)
    cohort = train.select("user_id").where("user_id % 9 = 0 OR user_id = 500").distinct()
    part = cf_lists.neighbour_lists(train, 6, 5, users=cohort, history_rows=history_rows, user_groups=user_groups)
    assert shown(part) == shown(cf.ranked_lists(cf.cf_scores(train, pairs, users=cohort), 6, 5))


def test_the_queries_lists_use_no_pair_table(spark):
    from cartlens.plans import context
    i = context.Inputs(spark, "/root/testdata/sf0.001")
    assert i.cf_lists.count() > 0 and "cf_pairs" not in i.__dict__
