"""Groups that read a written table past their own rows: nothing is exchanged, and the parts that kernels are made of."""

import numpy as np
import pytest

from cartlens.operators import blocks, cf_lists, similarity, streamed


def train(spark):
    rows = [(u, (u * 7 + k * k) % 60, 1.0 + (u + k) % 5) for u in range(40) for k in range(7)]
    return spark.createDataFrame([(u, j, s) for (u, j), s in {(u, j): s for u, j, s in rows}.items()], "user_id long, product_id long, score double")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cf_lists_exchange_nothing(spark):
    lists = cf_lists.neighbour_lists(train(spark), 5, 5, 3, user_groups=3)
    assert "CartesianProduct" in plan_of(lists) and "Exchange" not in plan_of(lists)
    got = lists.collect()
    assert {r["list"] for r in got} == {"user", "item", "blend"} and max(r["rank"] for r in got) == 5


@pytest.mark.parametrize("step", [1, 2 ** 40])
def test_places_of_near_and_far_ids(step):
    ids = np.arange(-5, 40) * step
    places = streamed.Places(ids)
    assert (places.table is None) == (step > 1)
    asked = np.array([-6 * step, -5 * step, 0, 39 * step, 40 * step, 10 ** 18, -10 ** 18, 7 * step])
    assert places.of(asked).tolist() == [-1, 0, 5, 44, -1, -1, -1, 12]


def test_best_keeps_ties_in_id_order(monkeypatch):
    monkeypatch.setattr(streamed, "BUFFERED", 50)
    rng = np.random.default_rng(3)
    row, other = rng.integers(0, 4, 3_000), rng.permutation(3_000)
    score = rng.integers(-2, 6, 3_000) / 4 + rng.integers(0, 3, 3_000) * 1e-12
    best = streamed.Best(5, 7, lambda r, o: o % 3 == 0)
    for lo in range(0, 3_000, 37):
        best.offer(*(x[lo:lo + 37] for x in (row, other, score)))
    got = list(zip(*(x.tolist() for x in best.lists())))
    want = []
    for r in range(4):
        mine = sorted((-np.rint(s * 1e10), o, s) for a, o, s in zip(row, other, score) if a == r and s > 0 and o % 3)
        want += [(r, o, s, i) for i, (_, o, s) in enumerate(mine[:7], 1)]
    assert got == want


def sums(found):
    return {(r[0], r[1]): tuple(r)[2:] for r in found.collect()}


@pytest.mark.parametrize("step", [1_000_000, 15])
def test_streamed_pairs_equal_the_join(spark, monkeypatch, step):
    held = similarity._pairs_kernel

    def small(*how):
        run = held(*how)

        def stepped(batches):
            before, similarity.STEP = similarity.STEP, step  # the worker process outlives the test
            try:
                yield from run(batches)
            finally:
                similarity.STEP = before
        return stepped
    monkeypatch.setattr(similarity, "_pairs_kernel", small)
    rows = train(spark).unionByName(spark.createDataFrame([(None, 3, 9.0), (5, None, 2.0), (None, None, 1.0)], train(spark).schema))
    for got, want in ((similarity.item_pairs(rows), similarity.item_pairs(rows, "join")),
                      (similarity.user_similarity(rows), similarity.cosine_pairs(rows, "user_id", "product_id", "other_user_id", "join"))):
        assert "Exchange" not in plan_of(got)
        got, want = sums(got), sums(want)
        assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))
    best = similarity.similar(similarity.user_similarity(rows, by_entity=True, top=3), "user_id", "other_user_id", 3)
    plain = similarity.similar(similarity.cosine_pairs(rows, "user_id", "product_id", "other_user_id", "join"), "user_id", "other_user_id", 3)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, plain.collect()))


def test_written_tables_writes_the_pair_table_once(spark, monkeypatch):
    from cartlens import plans
    from cartlens.plans import context
    context.forget()
    assert plans.queries()["written_tables"](spark, "/root/testdata/sf0.001").where("table_name = 'item_pairs'").first()["n_rows"] > 0
    assert "cf_pairs" not in context.inputs(spark, "/root/testdata/sf0.001").__dict__


@pytest.mark.parametrize("chunk,cells", [(4_000_000, 32_000_000), (60, 32_000_000), (60, 0)])
def test_streamed_products_copy_no_row(spark, monkeypatch, chunk, cells):
    from test_blocks import expected, lists, rows
    monkeypatch.setattr(blocks, "LEAST_ROWS", 1)
    held = blocks._streamed_kernel

    def small(*how):
        run = held(*how)

        def stepped(batches):
            names = ("CHUNK_ENTRIES", "TILE_LEFT", "TILE_RIGHT", "TILE_BOUND", "BOUND_ROWS", "DENSE_CELLS")
            before = [getattr(blocks, n) for n in names]  # the worker process outlives the test
            try:
                for n, x in zip(names, (chunk, 7, 9, 9, 13, cells)):
                    setattr(blocks, n, x)
                yield from run(batches)
            finally:
                for n, x in zip(names, before):
                    setattr(blocks, n, x)
        return stepped
    monkeypatch.setattr(blocks, "_streamed_kernel", small)
    left, right = rows(60, 1), rows(100, 2)
    schema = "id long, idx array<int>, val array<double>"
    l, r = spark.createDataFrame(left, schema).coalesce(2), spark.createDataFrame(right, schema).coalesce(3)
    gone = {(left[n % 60][0], right[(n * 7) % 100][0]) for n in range(300)}
    ex = spark.createDataFrame(sorted(gone), "id long, right_id long")
    got = blocks.top_k_dot(l, r, 40, 5, left_excl=ex)
    assert "Exchange" not in plan_of(got) and lists(got) == expected(left, right, 5, gone)
    own = {(i, i) for i, *_ in right}
    assert lists(blocks.top_k_dot(r, r, 40, 5, exclude_self=True)) == expected(right, right, 5, own)
    both = blocks.top_k_dot(r, None, 40, 5, exclude_self=True)
    assert "Exchange" not in plan_of(both) and lists(both) == expected(right, right, 5, own)
