"""Counts that take one exchange or a bound: the vocabulary (T6) and the cleaning diagnostics."""

import random
from collections import Counter

import pytest

from cartlens.operators import content as ct
from cartlens.operators import interactions as ix


def _corpora():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    skewed = [" ".join(rng.choices(words, [2 ** -i for i in range(12)], k=rng.randrange(0, 30))) for _ in range(40)]
    even = [" ".join(rng.choices(words, k=8)) for _ in range(20)]
    return [skewed, even, ["aa bb aa bb aa bb", "cc dd", "dd cc", "ee", None, ""], [None, ""], []]


def _counted(texts, ngram_max):
    out = Counter()
    for t in texts:
        w = (t or "").split()
        out.update(w)
        if ngram_max > 1:
            out.update(f"{a} {b}" for a, b in zip(w, w[1:]))
    return out


@pytest.mark.parametrize("tied", [16, 0])
def test_top_terms_are_those_of_all_terms(spark, monkeypatch, tied):
    monkeypatch.setattr(ct, "TIED_WORDS", tied)
    for texts in _corpora():
        docs = spark.createDataFrame(list(enumerate(texts)), "product_id long, corpus string")
        words = ct.words_of(docs, stop_words=False)
        for n, k in ((2, 3), (2, 9), (2, 1000), (1, 4)):
            want = sorted(_counted(texts, n).items(), key=lambda x: (-x[1], x[0]))[:k]
            assert [tuple(r) for r in ct.top_terms(words, k, n).collect()] == want
            chosen = [t for t, _ in want]
            got = {(r["product_id"], r["term"]): r["tf"] for r in ct.counts_of_terms(words, chosen, ngram_max=n).collect()}
            assert got == {(i, t): c for i, x in enumerate(texts) for t, c in _counted([x], n).items() if t in chosen}


def _events(spark, rows):
    return spark.createDataFrame(rows, "interaction_id long, user_id long, product_id long, event_type string, rating double, "
                                       "session_id long, event_time timestamp_ntz, category_id long, product_avg_rating double, "
                                       "score double, score_norm double")


def test_diagnostics_count_nulls_and_empty_stages(spark):
    from datetime import datetime
    at = datetime(2024, 1, 1)
    some = _events(spark, [(1, 1, 10, "view", None, 1, at, 1, 3.0, 1.0, 0.2), (2, 1, 11, "view", None, 1, at, 1, 3.0, 2.0, 0.4),
                           (3, None, 11, "view", None, 1, at, 1, 3.0, 5.0, 1.0)])
    none = some.limit(0)
    products = spark.createDataFrame([(10, 1, 3.0), (11, 1, 3.0)], "product_id long, category_id long, avg_rating double")
    raw = some.drop("category_id", "product_avg_rating")
    got = ix.diagnostics(raw, products, ix.CleanResult(clean=some, train=some, test=none, deduped=some))
    rows = {r["stage"]: tuple(r)[1:] for r in got.collect()}
    assert rows == {"loaded": (1, 3, 1, 2, None, None), "dedup": (2, 3, 1, 2, None, None), "filtered": (3, 3, 1, 2, None, None),
                    "scored": (4, 3, 1, 2, 1.0, 5.0), "train": (5, 3, 1, 2, 1.0, 5.0), "test": (6, 0, 0, 0, None, None)}


def test_diagnostics_of_written_stages_take_two_exchanges_beside_their_joins(spark):
    from conftest import SF0001
    from cartlens.plans.context import inputs
    i = inputs(spark, SF0001)
    r = i.cleaned
    only_tables = ix.CleanResult(clean=r.clean, train=r.train, test=r.train, deduped=r.deduped)
    plan = ix.diagnostics(i.interactions, i.products, only_tables)._jdf.queryExecution().executedPlan().toString()
    join = ix.enrich(i.interactions, i.products)._jdf.queryExecution().executedPlan().toString()
    count = lambda p: sum("Exchange hashpartitioning" in x for x in p.splitlines())
    assert count(plan) - count(join) == 2
