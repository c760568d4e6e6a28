"""Ids beyond 2^53 beside null ids, in every operator that hands rows to Python."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from cartlens.llm import (bitsliced_topk, ngram_jaccard, packing, quality_classifier, secret_grammar, suffix_repetition, toxicity)
from tests.llm.helpers import docs

BIG = 2 ** 60
IDS = [None, BIG + 1, BIG + 2, -BIG - 3]
TEXTS = ["one text of its own with some more words in it", "password=abcdefgh12345 stands here", "", None]
ROWS = [(i, t, "en", "s", n) for i, t, n in zip(IDS, TEXTS, [None, BIG + 1, 0, 7])]


def ids(df, name="doc_id"):
    return sorted((r[0] for r in df.select(name).collect()), key=lambda x: (x is not None, x or 0))


WANT = sorted(IDS, key=lambda x: (x is not None, x or 0))


def test_ids_stay_whole(spark, tmp_path):
    df = docs(spark, ROWS).coalesce(1)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert ids(packing.tokenized_pieces(df, public_tokenizers.path("byte_bpe_50k.json"))) == WANT
    assert ids(toxicity.op5_nnpu_toxicity(spark, str(tmp_path))) == WANT
    assert ids(quality_classifier.op6_pu_quality(spark, str(tmp_path))) == WANT
    assert ids(suffix_repetition.op7_suffix_repetition(spark, str(tmp_path))) == WANT
    assert ids(secret_grammar.op8_secret_grammar(spark, str(tmp_path))) == WANT
    got = ngram_jaccard.similar_groups(df)
    assert ids(got) == WANT and ids(got, "component_id") == WANT


def test_redaction_keeps_ids_and_counts(spark):
    got = {r["doc_id"]: r for r in corpus_pipeline.redact_secrets(spark, docs(spark, ROWS).coalesce(1), "").collect()}
    assert got.keys() == set(IDS)
    assert got[BIG + 1]["text"] == "[SECRET] stands here" and got[BIG + 1]["n_chars"] == len("[SECRET] stands here")
    assert [got[i]["n_chars"] for i in (None, BIG + 2, -BIG - 3)] == [None, 0, 7]
    assert [got[i]["text"] for i in (None, BIG + 2, -BIG - 3)] == [TEXTS[0], "", None]


def test_queries_with_one_id_keep_their_own_results(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-9, 9, 4).tolist()) for i in [BIG, BIG, *range(1, 30)]]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    got = bitsliced_topk.search(df, df.where(F.col("vec_id") == BIG)).collect()
    want = []
    for _, q in rows[:2]:
        best = sorted((-int(np.dot(q, v)), i) for i, v in rows if i != BIG)[:5]
        want += [(BIG, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_of_rows_with_one_id_the_least_stays(spark):
    rows = [(5, "first words of one text that has enough of them", "en", "b", 1), (5, "other words of one text that has enough", "de", "a", 2)]
    got = [corpus_pipeline.drop_near_copies(spark, docs(spark, r), "").collect() for r in (rows, rows[::-1])]
    assert got[0] == got[1] and [tuple(r) for r in got[0]] == [rows[0]]
