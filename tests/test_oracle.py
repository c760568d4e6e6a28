"""Every registered query against its DuckDB oracle at sf0.001 (the driver repeats this at sf0.01)."""

import math

import duckdb
import pytest

from conftest import SF0001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


import __spark_entry__ as _entry  # noqa: E402


@pytest.mark.parametrize("name", sorted(_entry.oracle_sql()))
def test_matches_oracle(spark, con, name):
    df = _entry.queries()[name](spark, SF0001)
    res = con.execute(_entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(dcols, res.fetchall())


def test_every_library_query_has_an_oracle():
    """The training-data queries beside them have brute-force tests where SQL can't express them."""
    from cartlens import plans
    assert set(plans.queries()) == set(plans.oracle_sql())


@pytest.mark.parametrize("name", ["temporal_split", "catalog_clean", "recommendations_table", "rating_histogram"])
def test_matches_oracle_with_ansi_off_and_local_time_zone(spark, con, name):
    """Results must not depend on ANSI mode or the session time zone (fresh inputs via a distinct path)."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.ansi.enabled", "spark.sql.session.timeZone")}
    spark.conf.set("spark.sql.ansi.enabled", "false")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = _entry.queries()[name](spark, SF0001 + "/.")
        got = _canon(df.columns, [tuple(r) for r in df.collect()])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    res = con.execute(_entry.oracle_sql()[name])
    assert got == _canon([d[0] for d in res.description], res.fetchall())
