"""The rows of the cleaning job stay where they are: short id lists are broadcast, and the split is a condition."""

import datetime as dt
import glob
import os

from cartlens.operators import interactions as ix
from cartlens.sources import tables

SCHEMA = "interaction_id long, user_id long, product_id long, event_time timestamp_ntz"


def _log(spark, n=3000):
    """Users and products of very different activity, some null ids, days that repeat."""
    rows = [(i, None if i % 97 == 0 else (i * i) % 61 % 40, None if i % 89 == 0 else (i * 7) % (1 + i % 53),
             dt.datetime(2024, 1, 1 + i % 20, i % 24)) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def _shuffled_joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin")


def _count(rows, place):
    out = {}
    for r in rows:
        out[r[place]] = out.get(r[place], 0) + 1
    return out


def test_activity_filter_keeps_the_rows_in_place_and_drops_null_ids(spark):
    rows, df = _log(spark)
    users, products = _count(rows, 1), _count(rows, 2)
    for least_user, least_product in ((1, 1), (60, 30), (80, 400), (10 ** 6, 1)):
        got = ix.activity_filter(df, least_user, least_product)
        want = sorted(r[0] for r in rows if r[1] is not None and r[2] is not None
                      and users[r[1]] >= least_user and products[r[2]] >= least_product)
        assert sorted(r[0] for r in got.select("interaction_id").collect()) == want
        assert set(got.columns) == set(df.columns)
        assert _shuffled_joins(got) == 0


def test_warm_test_keeps_the_rows_in_place_and_drops_null_ids(spark):
    rows, df = _log(spark)
    train, test = df.filter("interaction_id < 40"), df.filter("interaction_id >= 40")
    seen_users, seen_products = ({r[k] for r in rows[:40]} - {None} for k in (1, 2))
    got = ix.warm_test(train, test)
    assert sorted(r[0] for r in got.select("interaction_id").collect()) == [
        r[0] for r in rows[40:] if r[1] in seen_users and r[2] in seen_products]
    assert _shuffled_joins(got) == 0


def test_the_split_is_not_written_again(spark):
    from conftest import SF0001
    from cartlens.session import ensure_checkpoint_dir
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cartlens-{spark.conf.get('spark.app.id')}"
    before = set(glob.glob(f"{base}/*"))
    got = ix.run(tables.order_log(spark, SF0001), tables.products(spark, SF0001))
    total = got.clean.count()
    assert got.train.count() == int(total * 0.8)
    wide = [p for p in set(glob.glob(f"{base}/*")) - before if not os.path.basename(p).startswith(("activity", "ids", "ranged", "boundary"))
            and spark.read.parquet(p).count() >= total]
    assert sorted(os.path.basename(p).split("-")[0] for p in wide) == ["clean", "dedup"]
