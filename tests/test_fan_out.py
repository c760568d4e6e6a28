"""Pairs and cohort scores: the exchange carries arrays, and the sums and cuts on top of it need no further one."""

import pytest
from pyspark.sql import functions as F

from cartlens.operators import cf
from cartlens.operators import similarity as sim


@pytest.fixture(scope="module")
def train(spark):
    rows = [(u, (u * 7 + k * k) % 60, 1.0 + (u + k) % 5) for u in range(80) for k in range(9)] + [(500, j, 2.0) for j in range(60)]
    return (spark.createDataFrame(rows, "user_id long, product_id long, score double")
            .groupBy("user_id", "product_id").agg(F.max("score").alias("score")).cache())


def exchanges_after_fan_out(df):
    """Exchanges between the result and ``fan_out``'s own, which is the one by number."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    return plan.split("REPARTITION_BY_NUM")[0].count("Exchange ") - 1


@pytest.mark.parametrize("by_entity", [False, True])
def test_pairs_are_summed_where_their_entity_lies(train, by_entity):
    pairs = sim.cosine_pairs(train, "product_id", "user_id", "other_product_id", "join", by_entity=by_entity)
    assert exchanges_after_fan_out(pairs) == 0
    n = train.join(train.groupBy("product_id").agg(F.sqrt(F.sum(F.col("score") ** 2)).alias("n")), "product_id")
    a = n.select("user_id", "product_id", (F.col("score") / F.col("n")).alias("x"))
    b = a.select("user_id", F.col("product_id").alias("other_product_id"), F.col("x").alias("y"))
    plain = a.join(b, "user_id").where("product_id != other_product_id").groupBy("product_id", "other_product_id") \
        .agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))
    key = lambda df: {(r[0], r[1]): r["similarity"] for r in df.collect()}
    got, want = key(pairs), key(plain)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_the_cut_per_entity_needs_no_exchange_of_pairs(train):
    top = sim.similar(sim.item_pairs(train, "join", by_entity=True).withColumnRenamed("cos", "similarity"),
                      "product_id", "other_product_id", 3)
    assert exchanges_after_fan_out(top) == 0


@pytest.mark.parametrize("entries", [1, 4, 1000])
def test_pieces_hold_every_entry_once(train, entries):
    got = sim.pieces(train, "user_id", ["product_id", "score"], entries)
    flat = got.select("user_id", F.inline(F.arrays_zip("product_id", "score")))
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, train.select("user_id", "product_id", "score").collect()))


def test_cohort_scores_send_one_row_per_neighbour_and_mark_seen_items(train):
    cohort = train.select("user_id").where("user_id % 9 = 0 OR user_id = 500").distinct()
    scores = cf.cohort_scores(train, cohort)
    assert exchanges_after_fan_out(cf.ranked_lists(scores, 5, 5)) == 0
    want = {(r["user_id"], r["product_id"]): (r["score_user"], r["score_item"])
            for r in cf.cf_scores(train, sim.item_pairs(train, "join"), users=cohort).collect()}
    got = {(r["user_id"], r["product_id"]): (r["score_user"], r["score_item"]) for r in scores.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
