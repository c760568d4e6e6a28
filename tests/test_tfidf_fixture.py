"""TF-IDF fixture: unigrams, no stop words -- 1 "red pan", 2 "red pan pan", 3 "blue pan"."""

import pytest

from cartlens.operators import content as ct
from cartlens.functions.text import ENGLISH_STOP_WORDS


@pytest.fixture(scope="module")
def model(spark):
    corpus = spark.createDataFrame(
        [(1, "red pan", "a", "c", 1.0, 3.0), (2, "red pan pan", "b", "c", 2.0, 3.0), (3, "blue pan", "c", "c", 3.0, 4.0)],
        "product_id long, corpus string, name string, category string, price double, avg_rating double")
    return ct.fit(corpus, ngram_max=1, stop_words=False)


def test_idf(model):
    idf = {r["term"]: round(r["idf"], 6) for r in model.vocab.collect()}
    assert idf == {"pan": 1.0, "red": 1.287682, "blue": 1.693147}


def test_similar_products(model):
    got = {(r["product_id"], r["other_product_id"]): r["similarity"]
           for r in ct.similar_products(model, 10).collect()}
    assert got[(1, 2)] == 0.9433 and got[(2, 1)] == 0.9433
    assert got[(1, 3)] == 0.3119 and got[(2, 3)] == 0.4276
    assert (1, 1) not in got


def test_search(spark, model):
    q = spark.createDataFrame([(7, "red blue")], "query_id long, text string")
    got = [(r["product_id"], r["score"]) for r in ct.search(q, model, 10).orderBy("rank").collect()]
    assert got == [(3, 0.6854), (1, 0.4781), (2, 0.3277)]


def test_unknown_query_terms_give_nothing(spark, model):
    q = spark.createDataFrame([(8, "green teapot")], "query_id long, text string")
    assert ct.search(q, model, 10).count() == 0


def test_stop_list_is_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_bigrams_after_stop_words(spark):
    from pyspark.sql import functions as F
    from cartlens.functions.text import terms
    df = spark.createDataFrame([("The Red pan and a blue-pan x",)], "t string")
    got = df.select(terms(F.col("t")).alias("g")).first()["g"]
    assert got == ["red", "pan", "blue", "pan", "red pan", "pan blue", "blue pan"]
