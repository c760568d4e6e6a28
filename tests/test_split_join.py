"""The degree-split join: same rows as a plain join, bounded cells, and the scorers on top of it under heavy skew."""

import pytest
from pyspark.sql import functions as F

from cartlens.operators import cf
from cartlens.operators import similarity as sim
from cartlens.operators import split_join as sj


@pytest.fixture(scope="module")
def skewed(spark):
    """One item in the history of every user, and one user with every item: about half of all rows each."""
    rows = [(0, j, 1.0 + j % 3) for j in range(300)] + [(u, 0, 1.0 + u % 4) for u in range(1, 300)]
    rows += [(u, 1 + u % 7, 2.0) for u in range(1, 20)]
    return spark.createDataFrame(rows, "user_id long, product_id long, score double").cache()


@pytest.mark.parametrize("bound", [1, 7, 100, 4096])
def test_same_rows_as_a_plain_join(spark, skewed, bound):
    left = skewed.select("product_id", F.col("user_id").alias("a"), F.col("score").alias("x")).unionByName(
        spark.createDataFrame([(None, 1, 1.0), (0, 1, 2.0), (0, 1, 2.0)], "product_id long, a long, x double"))
    right = skewed.select("product_id", F.col("user_id").alias("b")).where("b < 40 or b % 3 = 0")
    got = sorted(map(tuple, sj.split_join(left, right, "product_id", bound).select("product_id", "a", "x", "b").collect()))
    assert got == sorted(map(tuple, left.join(right, "product_id").select("product_id", "a", "x", "b").collect()))


def test_cells_are_bounded_in_rows(skewed):
    bound = 32
    a, b = sj.dealt(skewed.select("product_id", F.col("user_id").alias("a")), skewed.select("product_id", F.col("user_id").alias("b")),
                    "product_id", bound)
    for side in (a, b):
        largest = side.groupBy("product_id", sj._ROW, sj._COL).count().agg(F.max("count")).first()[0]
        # strips are dealt by hash, so they are even up to chance
        assert largest <= 2 * bound
    rows = skewed.count()
    assert a.count() <= rows + 300 * (300 // bound + 1)


def test_empty_sides(skewed):
    none = skewed.limit(0)
    assert sj.split_join(none, skewed.select("product_id", F.col("score").alias("s")), "product_id").count() == 0


def test_scores_under_skew(skewed, monkeypatch):
    """Pair tables and scores with every hot key split, against the same sums by hand."""
    monkeypatch.setattr(sj.split_join, "__defaults__", (16,))
    rows = [tuple(r) for r in skewed.collect()]
    by_user, un, inorm = {}, {}, {}
    for u, j, r in rows:
        by_user.setdefault(u, {})[j] = r
        un[u] = un.get(u, 0) + r * r
        inorm[j] = inorm.get(j, 0) + r * r
    cos, gram = {}, {}
    for u, own in by_user.items():
        for j, a in own.items():
            for i, b in own.items():
                if i != j:
                    cos[j, i] = cos.get((j, i), 0) + a * b / (inorm[j] * inorm[i]) ** 0.5
                    gram[j, i] = gram.get((j, i), 0) + a * b / un[u] ** 0.5
    pairs = sim.item_pairs(skewed, "join").cache()
    got = {(r["product_id"], r["other_product_id"]): (r["cos"], r["gram"]) for r in pairs.collect()}
    assert got.keys() == cos.keys()
    assert all(abs(c - cos[k]) < 1e-9 and abs(g - gram[k]) < 1e-9 for k, (c, g) in got.items())
    users = sim.cosine_pairs(skewed, "user_id", "product_id", "other_user_id", "join")
    assert users.where("user_id = 0").count() == 299
    want = {}
    for u, own in by_user.items():
        for j, r in own.items():
            for i in by_user[0]:
                if i not in own and (j, i) in cos:
                    s = want.setdefault((u, i), [0, 0])
                    s[0] += r / un[u] ** 0.5 * gram[j, i]
                    s[1] += r * cos[j, i]
    scores = {(r["user_id"], r["product_id"]): (r["score_user"], r["score_item"]) for r in cf.cf_scores(skewed, pairs).collect()}
    assert scores.keys() == want.keys()
    assert all(abs(a - want[k][0]) < 1e-9 and abs(b - want[k][1]) < 1e-9 for k, (a, b) in scores.items())
