import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.llm import pu_learning, quality_classifier, secret_grammar, toxicity
from tests.llm.helpers import EDGE, SF0001, clashing, docs

SF001 = "/root/testdata/sf0.01"


def _auc(y, s):
    rank = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1.0
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n, m = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * m)


@pytest.mark.parametrize("job, label, least, cut", [(toxicity.op5_nnpu_toxicity, "toxic", 0.9, 0.5),
                                                    (quality_classifier.op6_pu_quality, "quality", 0.95, 0.3)])
def test_held_out_rows_are_told_apart(spark, job, label, least, cut):
    sf = SF001 if label == "quality" else "/root/testdata/sf0.1"
    rows = job(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows["doc_id"]] == rows["held_out"].tolist()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= cut) == (rows["predicted"] == 1)).all()
    own = rows[rows["held_out"]].merge(labels, on="doc_id")
    assert _auc(own[label].to_numpy(), own["score"].to_numpy()) >= least


def test_labels_of_the_held_out_fold_are_not_used(spark):
    d = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF0001}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(pu_learning.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(d, labels) == toxicity.fit(d, turned)


def _few_positives(spark):
    """10 000 documents, every 20th toxic; of those outside the held-out fold, the first seven say zork."""
    outside = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 5]
    toxic = [i for i in outside if i % 20 == 0]
    texts = [" ".join(["plain words"] * (1 + i % 37) + ["nasty"] * (i % 20 == 0)) for i in range(10_000)]
    for i in toxic[:7]:
        texts[i] += " zork"
    labels = spark.createDataFrame([(i, int(i % 20 == 0), int(i % 20 != 0)) for i in range(10_000)], "doc_id bigint, toxic int, quality int")
    return docs(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]), labels, toxic, [texts[i] for i in outside]


def test_positives_are_drawn_by_themselves_and_the_prior_counts_all(spark):
    d, labels, toxic, outside = _few_positives(spark)
    rows, prior = pu_learning.learning_rows(d, labels, "toxic", 500, 100)
    assert sorted(r.doc_id for r in rows.where("positive").collect()) == toxic and rows.where("unlabelled").count() == 100
    assert prior == len(toxic) / len(outside)
    assert pu_learning.learning_rows(d, labels, "toxic", 50, 100)[0].where("positive").count() == 50


def test_statistics_come_from_all_rows_and_rare_terms_count(spark, monkeypatch):
    d, labels, toxic, outside = _few_positives(spark)
    assert 7 < 0.02 * len(toxic)
    for bound, most in ((50, 1_000_000), (12_000, 0)):
        monkeypatch.setattr(pu_learning, "MOST_BROADCAST", most)
        weights, _ = toxicity.fit(d, labels, max_unlabelled=bound)
        assert weights.keys() == {"nasty", "nast-", "zork"} and weights["zork"] > 0
    edges = [quality_classifier.fit(d, labels, max_unlabelled=n).edges for n in (30, 1000)]
    assert all(map(np.array_equal, *edges))
    x = np.sort(quality_classifier._shapes(outside), axis=0)
    at = np.ceil(np.array(quality_classifier.QUANTILES) * len(x)).astype(int) - 1
    for k, e in enumerate(edges[0]):
        assert np.array_equal(e, np.unique(quality_classifier._rounded_up(x[at, k])))
        assert np.allclose(quality_classifier._rounded_up(x[at, k]), x[at, k], rtol=0.002)


def test_nonnegative_risk_finds_the_positives():
    rng = np.random.default_rng(0)
    prior = 0.2
    draw = lambda n, p: [list(np.flatnonzero(rng.random(20) < (np.r_[[0.6] * 5, [0.1] * 15] if y else np.full(20, 0.1)))) for y in rng.random(n) < p]
    pos, unl = pu_learning.Rows.of(draw(800, 1.0), 20), pu_learning.Rows.of(draw(4000, prior), 20)
    w, b = pu_learning.fit_nnpu(pos, unl, prior)
    assert w[:5].min() > 1.5 * np.abs(w[5:]).max()  # the five telling features stand out
    told = pu_learning.sigmoid(unl.dot(w) + b) >= 0.5
    assert 0.12 < told.mean() < 0.28


def test_edge_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (5, 1, 1), (7, 0, 0), (None, 1, 1), (4, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    for table in (docs(spark), docs(spark, [])):
        for lab in (labels, labels.limit(0)):
            one = toxicity.score(table, toxicity.fit(table, lab)).collect()
            two = quality_classifier.score(clashing(table, ("q", "shape")), quality_classifier.fit(table, lab)).collect()
            assert len(one) == len(two) == table.count()
            assert all(0 <= r.score <= 1 for r in one + two)
            by_id = {}
            for r in one:
                by_id.setdefault(r.doc_id, set()).add(r.score)
            assert all(len(s) == 1 for s in by_id.values())
    assert quality_classifier.shape(None) == quality_classifier.shape(" \n") == [0.0] * len(quality_classifier.FEATURES)


# secrets

def _base(text):
    """The base spans, letter by letter as the patterns read."""
    out = []
    low = text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)
    names = ["password", "passwd", "secret", "token", "apikey", "api_key"]
    ok = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        end = None
        for name in names:
            if low.startswith(name, i):
                j = i + len(name)
                for quote in ((1, 0) if text[j:j + 1] in ("'", '"') and j < len(text) else (0,)):
                    k = j + quote
                    while text[k:k + 1] == " ":
                        k += 1
                    if text[k:k + 1] not in (":", "=") or k >= len(text):
                        continue
                    k += 1
                    while text[k:k + 1] == " ":
                        k += 1
                    if k < len(text) and text[k] in "'\"":
                        k += 1
                    e = k
                    while e < len(text) and text[e] in ok:
                        e += 1
                    if e > k:
                        end = (k, e)
                        break
                if end:
                    break
        if end:
            if end[1] - end[0] >= 6:
                out.append((0, i, end[1]))
            i = end[1]
        else:
            i += 1
    for kind, first, ok2, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            e = i
            if text.startswith(first, i):
                e = i + len(first)
                while e < len(text) and text[e] in ok2:
                    e += 1
            if e > i + len(first):
                if e - i >= least:
                    out.append((kind, i, e))
                i = e
            else:
                i += 1
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_base_spans_equal_a_plain_reading():
    rng = random.Random(2)
    parts = ["token", "Secret", "API_KEY", "passwd", "ſecret", "toKen", "=", ":", " ", '"', "'", "abc", "deadbeef" * 3,
             "AKIA", "ABCDEFGH12345678", "é", "\n", ".", "0123456789abcdef01234567", "x"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        got = sorted([m[:3] for m in secret_grammar.base_matches(text)], key=lambda x: (x[1], x[0]))
        assert got == _base(text), text


def test_automaton_learns_a_format_and_leaves_words_alone():
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(18)) for _ in range(300)]
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(300)]
    a, b = secret_grammar.Automaton(hexes[:200]), secret_grammar.Automaton(keys[:200])
    assert sum(map(a.accepts, hexes[200:])) >= 98 and sum(map(b.accepts, keys[200:])) >= 90
    assert b.start == "AKIA" and len(a.states) < 50
    words = ["internationalisation", "404189497460879512", "supercalifragilistic", "deadbeefdeadbeef", "mail.example.com"]
    assert not any(x.accepts(w) for x in (a, b) for w in words)
    text = f"see {hexes[250]} and password={hexes[251]}, not {words[0]}"
    spans = secret_grammar.scan(text, [a, b])
    assert [(k, text[s:e]) for s, k, e in spans] == [(3, hexes[250]), (0, f"password={hexes[251]}")]
    assert secret_grammar.redact(text, spans) == f"see [SECRET] and [SECRET], not {words[0]}"


def test_lengths_that_no_example_has_are_scored_too(spark):
    rng = random.Random(8)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda n: "".join(rng.choice(chars) for _ in range(n)) + "aG7x"
    odd = [n for n in range(40, 140) if n % 2]
    values = [draw(n) for n in odd for _ in range(6)]
    automata = secret_grammar.learn(docs(spark, [(i, f"token={v}", "en", "a", 1) for i, v in enumerate(values)]), max_examples=30)
    assert (automata[0].shortest, automata[0].longest) == (min(map(len, values)), max(map(len, values)))
    others = [draw(n) for n in range(45, 135, 2)] + [draw(n) for n in range(44, 136, 2)]
    found = sum(secret_grammar.scan(f"see {v} here", automata) == [(4, 3, 4 + len(v))] for v in others)
    assert found >= 0.9 * len(others)


def test_formats_with_dots_match_bare_occurrences():
    rng = random.Random(9)
    part = lambda n: "".join(rng.choice("ABCDEFGHghijklmnopqr23456789") for _ in range(n)) + "Ag7"
    values = [f"{part(9)}.{part(12)}.{part(15)}" for _ in range(220)]
    dotted, plain = secret_grammar.Automaton(values[:200]), secret_grammar.Automaton([part(30) for _ in range(200)])
    likely = [v for v in values[200:] if dotted.accepts(v)]
    assert len(likely) >= 18
    for v in likely:
        for before, after in (("see ", " here"), ("see ", "."), ("... ", "..."), ("see x=", ". So"), ("", "")):
            text = before + v + after
            assert secret_grammar.scan(text, [dotted, plain]) == [(len(before), 3, len(before) + len(v))], text
    one = next(x for x in (part(30) for _ in range(50)) if plain.accepts(x))
    for text in (f"x={one}", f"end.{one}.", f"a.b={one}.c", f"{one}=={one}"):
        assert text.find(one) in {a for a, _, _ in secret_grammar.scan(text, [dotted, plain])}, text


def test_states_with_unlike_continuations_stay_apart():
    strings = [[0, 0, 1]] * 200 + [[1, 0]] * 200
    states = secret_grammar.merge_states(secret_grammar.prefix_tree(strings))
    assert 3 <= len(states) <= 6
    assert states[0].arrivals >= 400 and sum(s.ends for s in states) == 400


def test_secrets_of_edge_rows(spark):
    automata = secret_grammar.learn(docs(spark))
    assert automata == []
    got = secret_grammar.find_secrets(clashing(docs(spark), ("kind", "hex")), automata).collect()
    assert len(got) == len(EDGE) and all(r.spans == [] for r in got)
    assert secret_grammar.find_secrets(docs(spark, []), secret_grammar.learn(docs(spark, []))).collect() == []
    twice = docs(spark, [(1, "token=abcdef12", "en", "a", 1)] * 2)
    assert [len(r.spans) for r in secret_grammar.find_secrets(twice, []).collect()] == [1, 1]


def test_secret_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    for r in secret_grammar.op8_secret_grammar(spark, SF0001).collect():
        base = _base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for k, _, _ in base) for i in range(3))
        said = ",".join(f"{secret_grammar.KINDS[k]}:{a}:{b}" for k, a, b in base)
        import hashlib
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("format")] == [s for s in said.split(",") if s]


# class prior and risk of positive-unlabelled learning

def _drawn(rng, n, share):
    feature = lambda y: list(np.flatnonzero(rng.random(20) < (np.r_[[0.6] * 5, [0.1] * 15] if y else np.full(20, 0.1))))
    return pu_learning.Rows.of([feature(y) for y in rng.random(n) < share], 20)


@pytest.mark.parametrize("share", [0.1, 0.4, 0.85])
def test_prior_is_found_from_positives_and_unlabelled_rows(share):
    rng = np.random.default_rng(int(share * 100))
    pos, unl = _drawn(rng, 3000, 1.0), _drawn(rng, 6000, share)
    got = pu_learning.estimate_prior(pos, unl, np.arange(pos.n) % 2, np.arange(unl.n) % 2)
    assert abs(got - share) < 0.08
    assert pu_learning.estimate_prior(pos.only(np.arange(pos.n) < 1), unl, np.zeros(1), np.arange(unl.n) % 2) == 0.5


def test_best_bin_equals_a_plain_search():
    rng = np.random.default_rng(5)
    pos, unl = rng.integers(0, 40, 300) / 4, rng.integers(-20, 30, 700) / 4
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(700) + 1 / np.sqrt(300))
    ratios = {t: (unl >= t).mean() / (pos >= t).mean() for t in pos}
    least = min(ratios, key=lambda t: ratios[t] + slack / (pos >= t).mean())
    assert np.isclose(pu_learning.best_bin(pos, unl)[0], ratios[least])


def test_fitted_weights_have_the_least_risk():
    rng = np.random.default_rng(6)
    pos, unl, prior, reach, l2 = _drawn(rng, 400, 1.0), _drawn(rng, 900, 0.3), 0.3, 5.0, 1e-5
    w, b = pu_learning.fit_nnpu(pos, unl, prior, l2=l2, reach=reach)

    def risk(w, b):
        def mean_loss(rows, y):
            z = np.full(rows.n, b)
            for r, c in zip(rows.rows, rows.cols):
                z[r] += w[c]
            return sum(np.log1p(np.exp(-y * min(reach, max(-reach, x)))) for x in z) / rows.n
        return (prior * mean_loss(pos, 1) + max(0.0, mean_loss(unl, -1) - prior * mean_loss(pos, -1)) + l2 / 2 * (w @ w))

    best = risk(w, b)
    assert best < risk(np.zeros(20), np.log(prior / (1 - prior))) - 0.05
    for size in (0.3, 0.1, 0.03):
        for _ in range(15):
            # near the bend at 0 the steps that leave out the second term move it to and fro a little
            assert best <= risk(w + rng.normal(0, size, 20), b + rng.normal(0, size)) + 1e-3


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_rows_labelled_0_are_not_needed(spark, module, label):
    texts = [("nasty vile words of hate " if i % 2 else "calm plain words of peace ") + f"{'abcdefgh'[i % 8]} " * (i % 5) for i in range(400)]
    if label == "quality":
        texts = [t if i % 2 == 0 else "$$ ## !!! " * (3 + i % 7) for i, t in enumerate(texts)]
    mine = lambda i: (i % 2 == 1) == (label == "toxic")
    d = docs(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    both = spark.createDataFrame([(i, int(mine(i))) for i in range(400)], f"doc_id bigint, {label} int")
    got = {r.doc_id: r.score for r in module.score(d, module.fit(d, both.where(f"{label} = 1"))).collect()}
    assert got == {r.doc_id: r.score for r in module.score(d, module.fit(d, both)).collect()}
    assert min(s for i, s in got.items() if mine(i)) > 0.5 > max(s for i, s in got.items() if not mine(i))


def test_examples_are_the_first_by_digest_and_lie_in_no_stored_table(spark, tmp_path, monkeypatch):
    import hashlib
    rng = random.Random(12)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 26, 40]))) for _ in range(300)]
    table = docs(spark, [(i, f"{v} and {values[(i * 7) % 300]}", "en", "a", 1) for i, v in enumerate(values)])
    monkeypatch.setattr(secret_grammar, "MIN_EXAMPLES", 5)
    stored = []
    monkeypatch.setattr("cartlens.llm.common.stored", lambda df, name: stored.append(name) or df)
    seen = []
    real = secret_grammar.Automaton
    monkeypatch.setattr(secret_grammar, "Automaton", lambda examples, **kw: seen.append((examples, kw)) or real(examples, **kw))
    secret_grammar.learn(table.repartition(7), max_examples=20)
    first = sorted(set(values), key=lambda v: (hashlib.md5(v.encode()).hexdigest(), v))[:20]
    assert seen == [(first, {"lengths": (24, 40)})] and not stored
    assert not hasattr(secret_grammar, "stored")
