"""Operator 11 against slow versions of its counts, probabilities and gradient."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.llm import lm_scoring as lm
from tests.llm.helpers import EDGE, SF0001, clashing, docs

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def counted(texts):
    c = Counter()
    for t in texts:
        c.update(lm.tokens(t))
        c[b""] += 1
    return c


def outcome_probability(model, counts, history, word):
    """P(word | history) by the definition; ``history`` are the two codes before."""
    v = model.vocabulary
    codes, classes = lm.Codes(v.words), np.append(v.classes(), 0)
    key, k = codes.keys_and_classes(np.array([*history, codes[word]]), classes)
    z = v.shares().astype(np.float64) + model.weights[lm.feature_rows(key, np.array([2]))[:, 0]].astype(np.float64).sum(axis=0)
    p = np.exp(z - z.max())
    return (p / p.sum())[k[2]] * (counts[word] + 1) / v.mass[k[2]]


def test_counts_scores_and_gain_on_held_out_texts(spark):
    rows = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    c = counted([t for i, t in rows if not is_held_out(i)])
    n, v = sum(c.values()), len(c)
    df = spark.read.parquet(f"{SF0001}/documents.parquet")
    model, counts = lm.fit(df.select("doc_id", "text").where(~lm.held_out(F.col("doc_id"))), frequent=2_000)
    got = lm.op11_hashed_maxent(spark, SF0001).collect()
    assert got[0].asDict().keys() == set(COLUMNS) and len(got) == len(rows)
    # few frequent words, so that most words meet their counts in the join
    small = {r["doc_id"]: r for r in lm.score(df.select("doc_id", "text"), model, counts).collect()}
    texts = dict(rows)
    for r in got:
        ts = lm.tokens(texts[r["doc_id"]]) + [b""]
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)
        for own in (r, small[r["doc_id"]]):
            assert (own["n_tokens"], own["n_known"], own["train_tokens"]) == (len(ts), sum(t in c for t in ts), n)
            assert own["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == is_held_out(r["doc_id"])
    codes = lm.Codes(model.vocabulary.words)
    for i in sorted(texts)[:6]:
        code = codes.of(lm.tokens(texts[i]))
        words = lm.tokens(texts[i]) + [b""]
        want = sum(math.log10(outcome_probability(model, c, code[at:at + 2], w)) for at, w in enumerate(words))
        assert small[i]["score"] == pytest.approx(want, rel=1e-5)


def test_model_beats_counts_on_held_out_texts(spark):
    got = lm.op11_hashed_maxent(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_outcomes_have_probability_one(spark):
    texts = ["the cat sat on the mat", "a cat and a dog sat", "the dog ran"] * 5
    df = docs(spark, [(i, t + f" w{i}", "en", "a", 1) for i, t in enumerate(texts)])
    model, counts = lm.fit(df, frequent=6)
    assert np.abs(model.weights).max() > 0
    c = {r["word"].encode(): r["c"] for r in counts.collect()}
    seen, codes = Counter(c), lm.Codes(model.vocabulary.words)
    classes = np.append(model.vocabulary.classes(), 0)
    for history in (["the", "cat"], ["never", "w3"]):
        code = [codes[w.encode()] for w in history]
        total = sum(outcome_probability(model, seen, code, w) for w in c)
        # the unknown outcome of each class of rare words: any word of the class that was not counted
        unknown = {}
        for i in range(2_000):
            w = f"zz{i}q{i % 97}".encode()
            unknown.setdefault(int(codes.keys_and_classes(np.array([codes[w]]), classes)[1][0]), w)
        assert len(unknown) == lm.RARE_CLASSES
        total += sum(outcome_probability(model, seen, code, w) for w in unknown.values())
        # classes of frequent words without any word keep a share of next to nothing
        assert total == pytest.approx(1, abs=1e-4)


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    weights = rng.standard_normal((12, 5))
    shares, rows, classes = rng.standard_normal(5), rng.integers(0, 12, (3, 40)), rng.integers(0, 5, 40)

    def loss(w):
        return -lm.class_log_probability(w, shares, rows, classes).sum()

    touched, g, times = lm.gradient(weights, shares, rows, classes)
    assert (times == np.bincount(rows.ravel(), minlength=12)[touched]).all()
    for i, r in enumerate(touched):
        for k in range(5):
            up, down = weights.copy(), weights.copy()
            up[r, k] += 1e-6
            down[r, k] -= 1e-6
            assert g[i, k] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_summed_by_group():
    sizes = np.array([1, 7, 2, 1, 64, 33])
    x = np.arange(sizes.sum() * 2, dtype=np.float64).reshape(-1, 2)
    want = np.add.reduceat(x, np.cumsum(sizes) - sizes, axis=0)
    assert (lm.summed_by_group(x, sizes) == want).all()


def test_edge_cases(spark):
    big = [(None, "words without an id", None, None, 1), (2 ** 60 + 1, "one", None, None, 1), (2 ** 60 + 2, "two \x1c\x85 x", None, None, 1)]
    df = clashing(docs(spark, EDGE + big), ("rid", "n", "given", "frequent", "rare", "word", "C", "c0", "n_rare"))
    model, counts = lm.fit(df.select("doc_id", "text").where(~lm.held_out(F.col("doc_id"))), frequent=5)
    got = lm.score(df.select("doc_id", "text", "rid", "n", "rare", "word", "C", "c0", "n_rare"), model, counts).collect()
    assert len(got) == len(EDGE) + 3
    by = {r["doc_id"]: r for r in got}
    assert by.keys() == {1, 2, 3, 4, 5, 6, 7, None, 2 ** 60 + 1, 2 ** 60 + 2}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[4]["n_tokens"] == 30_001
    # words end at the six ASCII characters only
    assert by[2 ** 60 + 2]["n_tokens"] == 4 and by[1]["score"] == by[2]["score"]
    assert by[5]["rid"] == by[5]["word"] == "other"
    c = counted([r[1] for r in EDGE + big if not is_held_out(r[0])])
    for i, t, *_ in EDGE + big:
        want = sum(math.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w in lm.tokens(t) + [b""])
        assert by[i]["base_score"] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("rows", [[], [(2, None, "en", "a", 1)], [(i, "some text", "en", "a", 1) for i in range(60) if is_held_out(i)]])
def test_nothing_to_learn_from(spark, tmp_path, rows):
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = lm.op11_hashed_maxent(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    if got and got[0]["held_out"]:
        assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in got} == {(0, 0, 0.0)}
