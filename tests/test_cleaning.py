"""Cleaning edge cases (expected values by reading the reference's rules)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartlens.operators import catalogue as cg
from cartlens.operators import interactions as ix

SCHEMA = ("interaction_id long, user_id long, product_id long, event_type string, rating double, "
          "session_id long, event_time timestamp_ntz")


def ts(day):
    return dt.datetime(2024, 1, day)


def products(spark, ids):
    return spark.createDataFrame([(i, 1, 3.0) for i in ids], "product_id long, category_id long, avg_rating double")


def cleaned(spark, data, min_user=1, min_product=1):
    df = spark.createDataFrame(data, SCHEMA)
    pids = sorted({r[2] for r in data})
    return ix.clean(df, products(spark, pids), min_user, min_product)


def test_purchase_beats_rating_and_view(spark):
    got = cleaned(spark, [(1, 1, 1, "view", None, None, ts(1)), (2, 1, 1, "purchase", None, None, ts(2)),
                          (3, 1, 1, "rating", 2.0, None, ts(3))]).collect()
    assert len(got) == 1 and got[0]["event_type"] == "purchase" and got[0]["score"] == 5.0


def test_rating_beats_cart_even_with_lower_score(spark):
    got = cleaned(spark, [(1, 1, 1, "add_to_cart", None, None, ts(1)),
                          (2, 1, 1, "rating", 2.0, None, ts(2))]).first()
    assert got["event_type"] == "rating" and got["score"] == 2.0


def test_rating_event_without_rating(spark):
    got = cleaned(spark, [(1, 1, 1, "rating", None, None, ts(1))]).first()
    assert got["score"] == 4.0 and got["rating"] == 0.0 and got["session_id"] == -1
    assert got["score_norm"] == pytest.approx(0.8)


def test_unknown_event_loses_and_scores_one(spark):
    got = cleaned(spark, [(1, 1, 1, "signup", None, None, ts(1)), (2, 1, 2, "signup", None, None, ts(1)),
                          (3, 1, 2, "view", None, None, ts(2))]).collect()
    by_p = {r["product_id"]: r for r in got}
    assert by_p[1]["score"] == 1.0 and by_p[2]["event_type"] == "view"


def test_activity_filter_is_one_pass(spark):
    # user 2 has 3 rows, but product 9 has only 1: after dropping it user 2 has 2 rows and stays (no k-core)
    data = [(i, 1, p, "view", None, None, ts(1)) for i, p in enumerate([1, 2, 3], 1)]
    data += [(10, 2, 1, "view", None, None, ts(1)), (11, 2, 2, "view", None, None, ts(1)),
             (12, 2, 9, "view", None, None, ts(1)), (13, 3, 1, "view", None, None, ts(1)),
             (14, 3, 2, "view", None, None, ts(1)), (15, 3, 3, "view", None, None, ts(1)),
             (16, 4, 3, "view", None, None, ts(1))]
    got = cleaned(spark, data, 3, 3)
    assert rows_of(got) == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)}


def rows_of(df):
    return {(r["user_id"], r["product_id"]) for r in df.collect()}


def test_split_seven_rows(spark):
    data = [(i, i, i, "view", None, None, ts(i)) for i in range(1, 8)]
    c = cleaned(spark, data)
    flagged = ix.flag_train(c, 0.2).collect()
    train = sorted(r["event_time"] for r in flagged if r["is_train"])
    test = sorted(r["event_time"] for r in flagged if not r["is_train"])
    assert len(train) == 5 and len(test) == 2 and max(train) <= min(test)


def test_split_breaks_ties_inside_one_timestamp(spark):
    # all rows share one timestamp: the order falls back to (user_id, product_id)
    data = [(i, 10 - i, i, "view", None, None, ts(1)) for i in range(1, 11)]
    flagged = ix.flag_train(cleaned(spark, data), 0.2).collect()
    train_users = sorted(r["user_id"] for r in flagged if r["is_train"])
    assert train_users == list(range(0, 8))


def test_catalogue_parsing(spark):
    raw = spark.createDataFrame([
        (0, " Steel Pan ", "Rs 1,299.50", None, "No rating available", None, '["A >> B >> C"]', None),
        (1, "Other Pan", None, "abc", "7", "  text  ", '["A"]', " Acme "),
        (2, None, None, None, "2.5", None, None, "x"),
        (3, "Steel Pan", "10", None, "4", None, None, None),
    ], "source_ord long, product_name string, discounted_price string, retail_price string, "
       "product_rating string, description string, product_category_tree string, brand string")
    got = {r["source_ord"]: r for r in cg.clean_catalogue(raw).collect()}
    assert got[0]["price"] == 1299.5 and got[0]["product_rating"] == 3.5
    assert (got[0]["main_category"], got[0]["sub_category"]) == ("A", "B")
    assert got[1]["price"] == 999.0 and got[1]["product_rating"] == 5.0 and got[1]["description"] == "text"
    assert (got[1]["main_category"], got[1]["sub_category"], got[1]["brand"]) == ("A", "A", "Acme")
    assert got[2]["product_name"] == "Unknown Product"
    assert (got[2]["main_category"], got[2]["sub_category"]) == ("nan", "nan")
    assert 3 not in got  # duplicate name: the first in file order wins


def test_catalogue_csv_roundtrip(spark, tmp_path):
    path = tmp_path / "cat.csv"
    path.write_text('product_name,discounted_price,retail_price,product_rating,description,product_category_tree,brand\n'
                    '"Big ""Red"" Pan","1,000",,4.5,"line one\nline two","[""Kitchen >> Pans""]",Acme\n')
    df = cg.read_catalogue_csv(spark, str(path))
    r = cg.clean_catalogue(df).first()
    assert r["product_name"] == 'Big "Red" Pan' and r["price"] == 1000.0
    assert r["description"] == "line one\nline two" and r["sub_category"] == "Pans"


def test_broken_csv_rows_are_kept_apart(spark, tmp_path):
    head = "product_name,discounted_price,retail_price,product_rating,description,product_category_tree,brand\n"
    good = 'Pan,1,2,3,"a, b\nc","[""K >> P""]",Acme\n'
    (tmp_path / "a.csv").write_text(head + good + "only,two\n" + good + ",".join("123456789") + "\n")
    (tmp_path / "b.csv").write_text(head)
    rows = cg.read_catalogue_csv(spark, str(tmp_path)).orderBy("source_ord").collect()
    assert [r["description"] for r in rows] == ["a, b\nc"] * 2 and "_corrupt_record" not in rows[0].asDict()
    broken = cg.broken_rows(spark, str(tmp_path)).orderBy("source_ord").collect()
    assert [r["record"].strip() for r in broken] == ["only,two", "1,2,3,4,5,6,7,8,9"]
    assert [r["source_ord"] for r in rows] + [r["source_ord"] for r in broken] == [0, 2, 1, 3]


def test_tags_and_dimensions(spark):
    clean = spark.createDataFrame([
        (0, "Pan one", "Kitchen", "Pans", "Acme"), (1, "Pan two", "Kitchen", "Kitchen", "Unknown"),
        (2, "Mug one", "Home", "Mugs", "nan"), (3, "Mug two", "Home", "Kitchen", "Zed")],
        "source_ord long, product_name string, main_category string, sub_category string, brand string")
    dims = {r["name"]: (r["category_id"], r["parent_id"]) for r in cg.category_dim(clean).collect()}
    assert dims == {"Kitchen": (1, None), "Home": (2, None), "Pans": (3, 1), "Mugs": (4, 2)}
    tags = clean.withColumn("product_id", F.col("source_ord") + 1)
    got = {(r["product_id"], r["tag"]) for r in cg.product_tags(tags).collect()}
    assert got == {(1, "acme"), (1, "kitchen"), (1, "pans"), (2, "kitchen"), (3, "home"), (3, "mugs"),
                   (4, "zed"), (4, "home"), (4, "kitchen")}


def test_defaults_and_cascade(spark):
    import datetime as _dt
    from cartlens.operators import quality as qa
    p = spark.createDataFrame([(1, "a", None, 2.0, None, None, None, None)],
                              "product_id long, name string, description string, price double, category_id long, "
                              "avg_rating double, review_count long, created_at timestamp_ntz")
    now = _dt.datetime(2025, 1, 1)
    r = qa.apply_defaults(p, "products", now).first()
    assert r["avg_rating"] == 0.0 and r["review_count"] == 0 and r["created_at"] == now
    tags = spark.createDataFrame([(10, 1, "x"), (20, 2, "y")], "tag_id long, product_id long, tag string")
    assert [t["tag_id"] for t in qa.restrict_to_parents(tags, "product_id", p, "product_id").collect()] == [10]
    v = {(x["table_name"], x["rule"], x["column_name"]): x["violations"]
         for x in qa.violations({"products": p, "product_tags": tags}).collect()}
    assert v[("product_tags", "foreign_key", "product_id")] == 1
    assert v[("products", "not_null", "name")] == 0


def test_recommend_switch(spark):
    from cartlens.operators import hybrid as hy
    df = spark.createDataFrame([(1, 2, 0.5, 1)], "user_id long, product_id long, score double, rank int")
    assert hy.recommend("CF", hybrid_list=df, cf_list=df, content_list=df).first()["algo_used"] == "CF"
    with pytest.raises(ValueError):
        hy.recommend("nope", hybrid_list=df, cf_list=df, content_list=df)


def test_split_puts_null_times_last(spark):
    from cartlens.operators.ordering import first_k_flag
    df = spark.createDataFrame([(1, 1, ts(1)), (2, 2, None), (3, 3, ts(2)), (4, 4, None)],
                               "user_id long, product_id long, event_time timestamp_ntz")
    got = {r["user_id"]: r["f"] for r in first_k_flag(df, "event_time", ["user_id", "product_id"], 3, "f").collect()}
    assert got == {1: True, 3: True, 2: True, 4: False}
    got = {r["user_id"]: r["f"] for r in first_k_flag(df, "event_time", ["user_id", "product_id"], 1, "f").collect()}
    assert got == {1: True, 3: False, 2: False, 4: False}


@pytest.mark.parametrize("rank_rows", [1, 3, 1000])
def test_split_descends_buckets_like_a_global_sort(spark, rank_rows):
    """Forcing tiny boundary buckets walks day -> hour -> minute -> second; result equals a plain global order."""
    from pyspark.sql import Window
    from cartlens.operators.ordering import first_k_flag
    base = spark.range(0, 400).select(
        (F.col("id") % 37).alias("user_id"), F.col("id").alias("product_id"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(F.col("id") % 3, F.col("id") % 5, F.col("id") % 7,
                                                            F.col("id") % 2)).alias("event_time"))
    for k in (1, 57, 200, 399, 400):
        got = {(r["user_id"], r["product_id"]) for r in
               first_k_flag(base, "event_time", ["user_id", "product_id"], k, "f", rank_rows=rank_rows)
               .filter("f").collect()}
        w = Window.orderBy("event_time", "user_id", "product_id")
        want = {(r["user_id"], r["product_id"]) for r in
                base.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).collect()}
        assert got == want, k


@pytest.mark.parametrize("log, raw, deduped, users, products, score_sum", [
    ("order", 6000, 5382, 150, 200, 13901.5),
    ("event", 1000, 739, 15, 100, 2252.0),
])
def test_driver_mapping_matches_fixture_table(spark, log, raw, deduped, users, products, score_sum):
    """FIXTURES.md section 2 lists these sf0.001 figures for both interaction views."""
    from conftest import SF0001
    from cartlens.sources import tables
    src = tables.order_log(spark, SF0001) if log == "order" else tables.event_log(spark, SF0001)
    prods = tables.products(spark, SF0001)
    assert ix.enrich(src, prods).count() == raw
    c = ix.clean(src, prods)
    r = c.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("u"),
              F.countDistinct("product_id").alias("p"), F.sum("score").alias("s")).first()
    assert (r["n"], r["u"], r["p"], r["s"]) == (deduped, users, products, score_sum)


def test_split_is_time_zone_proof(spark):
    from pyspark.sql import Window
    from cartlens.operators.ordering import first_k_flag
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        base = spark.range(0, 300).select(
            (F.col("id") % 11).alias("user_id"), F.col("id").alias("product_id"),
            (F.lit(dt.datetime(2024, 3, 10)) + F.make_dt_interval(F.lit(0), F.col("id") % 48, F.col("id") % 60,
                                                                  F.lit(0))).alias("event_time"))
        base = base.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
        for rank_rows in (1, 1000):
            got = {(r["user_id"], r["product_id"]) for r in
                   first_k_flag(base, "event_time", ["user_id", "product_id"], 123, "f", rank_rows=rank_rows)
                   .filter("f").collect()}
            w = Window.orderBy("event_time", "user_id", "product_id")
            want = {(r["user_id"], r["product_id"]) for r in
                    base.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 123).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_source_positions_follow_the_files(spark, tmp_path):
    """Spark takes larger files first; positions still go by path, and "keep first" with them."""
    from cartlens.sources.schemas import RAW_CATALOGUE
    cols = [f.name for f in RAW_CATALOGUE.fields]
    line = lambda name: ",".join(name if c == "product_name" else "x" for c in cols)
    (tmp_path / "a.csv").write_text("\n".join([",".join(cols), line("first"), line("second")]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([",".join(cols)] + [line(f"b{i}") for i in range(500)]) + "\n")
    got = [r["product_name"] for r in cg.read_catalogue_csv(spark, str(tmp_path)).orderBy("source_ord").collect()]
    assert got == ["first", "second"] + [f"b{i}" for i in range(500)]


def test_sample_hash_takes_any_position(spark):
    df = spark.createDataFrame([(2**60 + i,) for i in range(5)], "source_ord long")
    keys = [r[0] for r in df.select(cg.sample_key(F.col("source_ord"), 42)).collect()]
    assert len(set(keys)) == 5 and all(len(k) == 32 for k in keys)


def test_pair_ids_never_collide(spark):
    from cartlens.functions.numeric import pair_id
    df = spark.range(3).crossJoin(spark.range(40).withColumnRenamed("id", "pos"))
    assert df.select(pair_id(F.col("id"), F.col("pos"))).distinct().count() == 120
    with pytest.raises(Exception, match="does not fit"):
        spark.range(1).select(pair_id(F.lit(1), F.lit(1 << 20))).collect()
