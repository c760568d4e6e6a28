"""Cells of users outside the matrix end before any exchange."""

from cartlens.operators import matrix as mx


def test_matrix_cells_of_unknown_and_repeated_cells(spark):
    scores = spark.createDataFrame([(1, 10, 2.0), (1, 11, 3.0), (2, 11, 4.0)], "user_id long, product_id long, score double")
    items = spark.createDataFrame([(10, 0), (11, 1)], "product_id long, idx long")
    rows = mx.matrix_rows(scores, items, 1)
    wanted = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (3, 10), (2, 12), (None, 10), (-1, 10)], "user_id long, product_id long")
    got = mx.matrix_cells(rows, items, wanted, 1)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10, 2.0), (2, 10, 0.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Aggregate")  # the filter by user lies below the distinct
