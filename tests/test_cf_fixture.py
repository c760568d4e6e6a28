"""Hand-checked collaborative-filtering fixture (expected values computed independently with NumPy)."""

import pytest
from pyspark.sql import functions as F

from cartlens.operators import cf
from cartlens.operators import matrix as mx
from cartlens.operators import similarity as sim
from cartlens.operators.popularity import cold_start, popular

TRAIN = [(1, 1, 5.0), (1, 2, 3.0), (2, 1, 5.0), (2, 2, 1.0), (2, 3, 4.0), (3, 2, 2.0), (3, 3, 5.0), (4, 4, 1.0)]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TRAIN, "user_id long, product_id long, score double")


def pairs_of(df, a, b, col):
    return {(r[a], r[b]): round(r[col], 4) for r in df.collect()}


def test_user_cosine(train):
    got = pairs_of(sim.user_similarity(train), "user_id", "other_user_id", "similarity")
    assert got[(1, 2)] == 0.741 and got[(2, 1)] == 0.741
    assert got[(1, 3)] == 0.1911 and got[(2, 3)] == 0.6304
    assert not any(4 in k for k in got)


def test_item_cosine(train):
    got = pairs_of(sim.item_similarity(train), "product_id", "other_product_id", "similarity")
    assert got[(1, 2)] == 0.7559 and got[(1, 3)] == 0.4417 and got[(2, 3)] == 0.5843
    assert not any(4 in k for k in got)
    both = pairs_of(sim.item_pairs(train), "product_id", "other_product_id", "cos")
    assert both == got


def test_popularity(train):
    got = [(r["product_id"], r["score"], r["rank"]) for r in popular(train, 10).orderBy("rank").collect()]
    assert got == [(1, 10.0, 1), (3, 9.0, 2), (2, 6.0, 3), (4, 1.0, 4)]


def test_user_and_item_based(train):
    lists = cf.ranked_lists(cf.cf_scores(train, sim.item_pairs(train)), 40, 40, 10)
    ub = {(r["user_id"], r["product_id"]): r["score"] for r in cf.single_list(lists, "user", 10).collect()}
    ib = {(r["user_id"], r["product_id"]): r["score"] for r in cf.single_list(lists, "item", 10).collect()}
    assert ub == {(1, 3): 3.9192, (3, 1): 4.1073}
    assert ib == {(1, 3): 3.9617, (3, 1): 3.7205}
    blend = {(r["user_id"], r["product_id"]): r["score"] for r in cf.cf_blend(lists, 10, k=40).collect()}
    # 0.5 * 3.9192 + 0.5 * 3.9617 = 3.94045 exactly: half-up in decimal
    assert blend == {(1, 3): 3.9405, (3, 1): 3.9139}


def test_user_based_rewrite_matches_direct_form(train):
    """H (H^T R) against the user x user form (H H^T) R."""
    lists = cf.ranked_lists(cf.cf_scores(train, sim.item_pairs(train)), 40, 40, 0)
    rewrite = {(r["user_id"], r["product_id"]): r["score"] for r in lists.filter("list = 'user'").collect()}
    us = sim.user_similarity(train)
    direct = (us.join(train.withColumnRenamed("user_id", "other_user_id"), "other_user_id")
              .groupBy("user_id", "product_id").agg(F.sum(F.col("similarity") * F.col("score")).alias("s"))
              .join(train.select("user_id", "product_id"), ["user_id", "product_id"], "left_anti")
              .filter("s > 0"))
    d = {(r["user_id"], r["product_id"]): r["s"] for r in direct.collect()}
    assert d.keys() == rewrite.keys()
    for k in d:
        assert abs(d[k] - rewrite[k]) < 1e-12


def test_cold_start_gets_popular(spark, train):
    users = spark.createDataFrame([(1,), (9,)], "user_id long")
    got = cold_start(users, train, 10).collect()
    assert {r["user_id"] for r in got} == {9}
    assert [r["product_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 3, 2, 4]


def test_sparsity(train):
    r = mx.matrix_stats(mx.user_item_scores(train)).first()
    assert (r["n_users"], r["n_products"], r["n_stored"], r["sparsity"]) == (4, 4, 8, 0.5)


@pytest.mark.parametrize("columns", [1, 2, 100])
def test_sparse_rows_and_their_cells(spark, train, columns):
    items = spark.createDataFrame([(1, 3), (2, 0), (3, 1), (4, 2)], "product_id long, idx long")
    rows = mx.matrix_rows(mx.user_item_scores(train), items, columns)
    got = {}
    for r in rows.collect():
        assert r["n"] == len(r["idx"]) <= columns and list(r["idx"]) == sorted(r["idx"])
        assert {i // columns for i in r["idx"]} == {r["chunk"]}
        got.setdefault(r["user_id"], {}).update(zip(r["idx"], r["scores"]))
    place = {1: 3, 2: 0, 3: 1, 4: 2}
    want = {}
    for u, j, s in TRAIN:
        want.setdefault(u, {})[place[j]] = s
    assert got == want
    asked = [(u, j) for u in (1, 2, 3, 4, 9) for j in (1, 2, 3, 4, 9)]
    cells = mx.matrix_cells(rows, items, spark.createDataFrame(asked + asked, "user_id long, product_id long"), columns).collect()
    assert sorted(map(tuple, cells)) == [(u, j, want[u].get(place[j], 0.0)) for u, j in asked if u != 9 and j != 9]


def test_ranking_metrics(spark, train):
    lists = cf.ranked_lists(cf.cf_scores(train, sim.item_pairs(train)), 40, 40, 10)
    recs = cf.cf_blend(lists, 10, k=40)
    test = spark.createDataFrame([(1, 3), (3, 1), (3, 4), (9, 1)], "user_id long, product_id long")
    r = cf.ranking_metrics(recs, test, train, 10).first()
    assert r["users_evaluated"] == 2
    assert r["precision"] == pytest.approx(0.1)
    assert r["recall"] == pytest.approx(0.75)
    assert r["hit_rate"] == pytest.approx(1.0)


def test_full_blend_pads_with_zero_items(train):
    lists = cf.ranked_lists(cf.cf_scores(train, sim.item_pairs(train)), 40, 40, 10)
    got = cf.cf_blend_full(lists, train, 3).collect()
    per_user = {}
    for r in got:
        per_user.setdefault(r["user_id"], []).append((r["rank"], r["product_id"], r["score"]))
    # user 1: item 3 positive, then zero-score items in id order (seen items included)
    assert sorted(per_user[1])[0][1] == 3
    assert [p for _, p, s in sorted(per_user[1])[1:]] == [1, 2]
    assert all(len(v) == 3 for v in per_user.values())


def test_hybrid_routes(spark, train):
    """Known user: normalised blend; cold user: 0.6 x normalised popularity; nothing to say: popularity."""
    from cartlens.operators import hybrid as hy
    from cartlens.operators.popularity import popular_list_column
    cf_list = spark.createDataFrame([(1, 3, 2.0, 1), (1, 4, 1.0, 2)], "user_id long, product_id long, score double, rank int")
    cb_list = spark.createDataFrame([(1, 4, 0.5, 1)], "user_id long, product_id long, score double, rank int")
    users = spark.createDataFrame([(1,), (4,), (9,)], "user_id long")
    got = hy.hybrid(users, train, cf_list, cb_list, popular_list_column(train, 20), popular_list_column(train, 10), 10)
    rows = {(r["user_id"], r["product_id"]): r["score"] for r in got.collect()}
    # user 1: item 3 = 0.6 * 1.0; item 4 = 0.6 * 0.5 + 0.4 * 1.0
    assert rows[(1, 3)] == 0.6 and rows[(1, 4)] == 0.7
    # user 9 is not in train: CF list = popularity (10, 9, 6, 1), normalised by 10, times 0.6
    assert [rows[(9, p)] for p in (1, 3, 2, 4)] == [0.6, 0.54, 0.36, 0.06]
    # user 4 is known but has no list at all: plain popularity
    assert [rows[(4, p)] for p in (1, 3, 2, 4)] == [10.0, 9.0, 6.0, 1.0]


def test_blend_refuses_lists_cut_too_short(train):
    lists = cf.ranked_lists(cf.cf_scores(train, sim.item_pairs(train)), 40, 40, 10)
    with pytest.raises(ValueError):
        cf.cf_blend(lists, 21, k=40)


@pytest.mark.parametrize("plan", ["join", "blocked"])
def test_pair_plans_agree(train, plan, monkeypatch):
    from cartlens.operators import pair_blocks
    monkeypatch.setattr(pair_blocks, "EXPANSION_CHUNK", 2)  # force many NumPy steps per group
    got = pairs_of(sim.item_pairs(train, plan), "product_id", "other_product_id", "cos")
    assert got == {(1, 2): 0.7559, (2, 1): 0.7559, (1, 3): 0.4417, (3, 1): 0.4417, (2, 3): 0.5843, (3, 2): 0.5843}
    users = pairs_of(sim.cosine_pairs(train, "user_id", "product_id", "other_user_id", plan),
                     "user_id", "other_user_id", "similarity")
    assert users[(1, 2)] == 0.741 and users[(3, 2)] == 0.6304 and len(users) == 6
