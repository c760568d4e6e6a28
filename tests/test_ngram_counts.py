"""TF-IDF counts in Arrow batches: one row of an id is exchanged and written, results against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from cartlens.operators import content as ct
from cartlens.operators import ngram_counts as ng

SCHEMA = "product_id long, name string, category string, tags string, description string"


def _products():
    """Ids that repeat, one null id, a null name (null text), texts without words, accented and one-letter words."""
    rng = random.Random(11)
    words = ["pan", "red", "blue", "été", "x", "steel_pan", "42", "the", "lid"]
    text = lambda: " ".join(rng.choices(words, [2 ** -i for i in range(9)], k=rng.randrange(0, 25)))
    rows = [(rng.randrange(2 ** 60, 2 ** 60 + 25), text(), "", "", text()) for _ in range(50)]
    return [*rows, (None, "red pan", "", "", "lid"), (None, "red lid", "", "", ""), (7, None, "a", "b", "c"), (8, "", "", "", "")]


def _model_of(rows, k):
    counts, n_docs = defaultdict(Counter), len(rows)
    for i, *parts in rows:
        text = "" if None in parts else " ".join(parts)
        w = [x for x in text.split() if len(x) > 1 and x != "the"]
        counts[i].update([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])
    total = Counter()
    for c in counts.values():
        total.update(c)
    top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:k]
    df = {t: sum(t in c for c in counts.values()) for t, _ in top}
    idf = {t: math.log((1 + n_docs) / (1 + df[t])) + 1 for t in df}
    weights = {}
    for i, c in counts.items():
        w = {t: c[t] * idf[t] for t in idf if t in c}
        norm = math.sqrt(sum(x * x for x in w.values()))
        weights |= {(i, t): x / norm for t, x in w.items()}
    return [(t, n, df[t], j) for j, (t, n) in enumerate(top)], weights


@pytest.mark.parametrize("k", [6, 1000])
def test_model_equals_plain_python_and_exchanges_one_row_of_an_id(spark, monkeypatch, k):
    rows, made = _products(), {}
    real = ct.materialised

    def written(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        made[name] = plan, real(df, name)
        return made[name][1]

    monkeypatch.setattr(ct, "materialised", written)
    corpus = ct.with_corpus_text(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    model = ct.fit(corpus, max_features=k)
    vocab, weights = _model_of(rows, k)
    got = model.vocab.orderBy("term_idx").select("term", "term_count", "doc_freq", "term_idx").collect()
    assert [tuple(r) for r in got] == vocab
    got = {(r["product_id"], r["term"]): r for r in model.weights.collect()}
    assert model.weights.count() == len(got) and got.keys() == weights.keys()
    assert all(math.isclose(got[x]["weight"], weights[x], rel_tol=1e-12) for x in weights)
    assert all(vocab[r["term_idx"]][0] == t for (_, t), r in got.items())
    assert made["term_counts"][1].count() == len({i for i, _ in weights})
    assert "Exchange hashpartitioning" not in made["tfidf"][0] and made["term_counts"][0].count("Exchange hashpartitioning") == 1


def test_no_text_and_no_product_give_no_term(spark):
    for rows in ([], [(1, None, "a", "b", "c"), (2, "", "", "", "")]):
        model = ct.fit(ct.with_corpus_text(spark.createDataFrame(rows, SCHEMA)))
        assert model.vocab.count() == 0 and model.weights.count() == 0


def test_corpus_text_is_not_written_beside_its_parts(spark):
    from conftest import SF0001
    from cartlens.plans.context import inputs
    corpus = inputs(spark, SF0001).corpus
    files = spark.read.parquet(corpus.inputFiles()[0])
    assert "corpus" in corpus.columns and "corpus" not in files.columns
    r = corpus.orderBy("product_id").first()
    assert r["corpus"] == " ".join([r["name"], r["category"], r["tags"], r["description"]])


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_rows_of_an_id_are_merged_across_batches(size):
    rows = [(None, [1, 3], [1, 1]), (None, [0], [2]), (4, [0, 2], [1, 5]), (5, [2], [1]), (5, [1, 2], [1, 2]), (5, [2], [9]), (6, [0], [1])]
    schema = pa.schema([("id", pa.int64()), ("idx", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i:i + size]], schema) for i in range(0, len(rows), size)]
    got = [tuple(r.values()) for b in ng._merge(iter([batches[0].slice(0, 0), *batches]), 4) for r in b.to_pylist()]
    assert got == [(None, [0, 1, 3], [2, 1, 1]), (4, [0, 2], [1, 5]), (5, [1, 2], [1, 12]), (6, [0], [1])]


def test_slices_hold_all_rows_in_order():
    texts = ["a" * n for n in (0, 3, 9, 40, 0, 1, 2)] + [None, "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    for most in (1, 5, 10, 1000):
        parts = [b.column(0).to_pylist() for b in ng._slices(iter([batch, batch.slice(0, 0)]), 0, most)]
        assert sum(parts, []) == texts and all(parts)
    assert len(parts) == 1


def test_distinct_keys_are_counted_alike_dense_or_not(monkeypatch):
    import numpy as np
    keys = np.array([5, 0, 5, 9, 0, 5])
    for dense in (100, 0):
        monkeypatch.setattr(ng, "DENSE", dense)
        assert [x.tolist() for x in ng._tally(keys, 10)] == [[0, 5, 9], [2, 3, 1]]
