import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as cp
from cartlens.llm import ngram_jaccard, secret_grammar
from cartlens.llm.common import stored
from tests.llm.helpers import EDGE, SF0001, clashing, docs
from tests.llm.test_packing import _check
from tests.llm.test_rules_and_search import _groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_by_hand(spark):
    d = spark.read.parquet(f"{SF0001}/documents.parquet")
    good = stored(cp.keep_good(spark, d, SF0001), "t")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF0001}/labels.parquet").collect()}
    left = {r.doc_id for r in good.collect()}
    clean = [i for i, q in quality.items() if q == 1]
    assert good.columns == COLUMNS and sum(i in left for i in clean) >= 0.97 * len(clean)

    once = stored(cp.drop_near_copies(spark, good, SF0001), "t")
    want = _groups([(r.doc_id, r.text) for r in good.collect()])
    assert once.columns == COLUMNS and sorted(r.doc_id for r in once.collect()) == sorted(i for i, (_, c) in want.items() if c == i)

    safe = stored(cp.redact_secrets(spark, once, SF0001), "t")
    assert safe.columns == COLUMNS and safe.count() == once.count()
    old = {r.doc_id: r for r in once.collect()}
    for r in safe.collect():
        assert secret_grammar.base_matches(r.text) == []
        assert r.text == old[r.doc_id].text or ("[SECRET]" in r.text and r.n_chars == len(r.text))

    mixed = stored(cp.mix_sources(spark, safe, SF0001), "t")
    from cartlens.llm import mixing
    taken = {r.doc_id: r.taken for r in mixing.mix(safe).collect()}
    words = mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.n_words.__globals__["WORD"]))).alias("n")).collect()
    assert mixed.columns == COLUMNS and {r.doc_id: r.n for r in words} == {i: t for i, t in taken.items() if t}

    packed = cp.pack_sequences(spark, safe, SF0001).collect()
    _check(packed, [(r.doc_id, r.text) for r in safe.collect()])


def test_rows_without_an_id_have_plans_of_their_own(spark):
    from cartlens.llm import mixing
    rows = [(None, f"s{s} r{k} " + "w " * (5 + 40 * (k % 3)), "en", f"s{s}", None) for s in range(3) for k in range(12)]
    rows += [(i, f"id{i} " + "w " * 30, "en", f"s{i % 3}", None) for i in range(9)]
    table = stored(docs(spark, rows), "t")
    words = {r.source: r.n for r in cp.mix_sources(spark, table, SF0001).groupBy("source").agg(
        F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    sizes = table.select("source", mixing.n_words(F.col("text")).alias("size"))
    targets = {r.source_name: int(r.target + 0.5) for r in mixing.source_targets(sizes, "source", "size").collect()}
    assert words == targets


def test_run_is_the_stages_one_after_the_other(spark):
    d = spark.read.parquet(f"{SF0001}/documents.parquet")
    for _, stage in cp.STAGES:
        d = stored(stage(spark, d, SF0001), "t")
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(cp.run(spark, SF0001)) == key(d)
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES][1] == "n-gram Jaccard join"


def test_stages_on_edge_rows(spark):
    table = clashing(docs(spark))
    n = len(EDGE)
    assert cp.keep_good(spark, table, SF0001).columns == table.columns
    once = cp.drop_near_copies(spark, table, SF0001)
    assert once.columns == table.columns and sorted(r.doc_id for r in once.collect()) == [1, 2, 3, 4, 5, 7]
    assert cp.redact_secrets(spark, table, SF0001).count() == n
    mixed = cp.mix_sources(spark, table, SF0001)
    assert mixed.columns == table.columns and {r.doc_id for r in mixed.collect()} <= {4, 5, 6, 7}
    assert {r.doc_id for r in cp.pack_sequences(spark, table, SF0001).collect()} == set(range(1, 8))
    for _, stage in cp.STAGES:
        assert stage(spark, docs(spark, []), SF0001).collect() == []
    assert public_tokenizers.path("byte_bpe_50k.json") and ngram_jaccard.THRESHOLD == 80
