import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cartlens.llm import bitsliced_topk, ngram_jaccard, suffix_repetition
from tests.llm.helpers import EDGE, SF0001, clashing, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# suffix arrays

def _repeats(w):
    n = len(w)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def test_longest_repeats_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        made = [[rng.randint(0, rng.choice([0, 1, 2, 9])) for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(1, 5))]
        words = np.array([x for d in made for x in d], np.int64)
        doc = np.repeat(np.arange(len(made)), [len(d) for d in made])
        assert suffix_repetition.longest_repeats(words, doc).tolist() == [x for d in made for x in _repeats(d)]


def _plain(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside),
            n < 10 or 100 * len(inside) > 20 * n)


def test_rules_of_edge_rows(spark):
    looped = "a b c d e f g " * 40
    once = " ".join(f"x{i}" for i in range(60))
    far = once + " " + " ".join(f"y{i}" for i in range(1500)) + " " + once
    rows = EDGE + [(8, looped, None, None, None), (9, far, None, None, None), (10, "dup\ndup\n\n\ndup x", None, None, None)]
    got = suffix_repetition.rate(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _plain(text[r.doc_id])
    by_id = {r.doc_id: r for r in got}
    assert not by_id[8].kept and by_id[8].longest_repeat == 273 and by_id[8].repeat_spans == [[0, 280]]
    assert by_id[9].longest_repeat == 60 and by_id[9].repeat_spans == [[0, 60], [1560, 1620]] and by_id[9].kept
    assert [by_id[i].kept for i in (1, 2, 3, 5, 7)] == [False, False, False, True, True]
    assert suffix_repetition.rate(docs(spark, [])).collect() == []


def test_rules_query(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    for r in suffix_repetition.op7_suffix_repetition(spark, SF0001).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _plain(text[r.doc_id])
        assert not (r.kept and r.base_failed)


# bit slices

def test_index_selects_the_top_rows():
    rng = np.random.default_rng(0)
    for trial in range(150):
        n, d, size = rng.integers(1, 200), rng.integers(1, 8), rng.choice([1, 3, 300, 100_000])
        rows = rng.integers(-size, size + 1, (n, d))
        if trial % 3 == 0:
            rows[rng.integers(0, n, n // 2)] = rows[0]
        q, among = rng.integers(-size, size + 1, d), rng.random(n) < 0.8
        places = bitsliced_topk.BitSlicedIndex(rows).top(q, 5, bitsliced_topk._pack(among))
        order = lambda at: sorted((-int(rows[i] @ q), i) for i in at)[:5]
        assert order(places) == order(np.flatnonzero(among)) and among[places].all()


def _nearest(vectors):
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = np.floor(256 * np.array(v, np.float64)).astype(np.int64)
    out = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q)[:5]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_query(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()]
    assert sorted(map(tuple, bitsliced_topk.op9_bitsliced_topk(spark, SF0001).collect())) == _nearest(vectors)


def test_search_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (50, [-0.25, 3.0]), (51, None), (52, [nan, 1.0]),
               (53, [inf, 1.0]), (54, [None, 1.0]), (None, [1.0, 1.0]), (55, [0.0, 0.0])]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    rows = bitsliced_topk.whole_numbers(clashing(table, ("row_block", "rank", "vector2")))
    got = sorted(map(tuple, bitsliced_topk.search(rows, rows.where("vec_id % 50 = 0")).collect()))
    assert got == _nearest(vectors) and len(got) == 8  # four candidates each
    assert bitsliced_topk.search(rows.limit(0), rows.limit(0)).collect() == []


# Jaccard groups

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _groups(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(_LOWER))
        sets[d] = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    having, root = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for g in s:
            having[g].append(d)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for e, both in Counter(e for g in s for e in having[g] if e < d).items():
            if 100 * both >= 80 * (len(s) + len(sets[e]) - both):
                a, b = top(d), top(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def _found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.similar_groups(df).collect()}


@pytest.mark.parametrize("often", [3, 16])
def test_groups_equal_brute_force(spark, monkeypatch, often):
    """Near copies in groups up to a few dozen, frequent passages, very short and cut texts; few and many frequent shingles."""
    monkeypatch.setattr(ngram_jaccard, "FREQUENT_FROM", often)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for _ in range(50):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 8, 12, 30, 80, 200, 600]))]
        if rng.random() < 0.4:
            base = base[:len(base) // 8] + passage + base[len(base) // 8:]
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.2:
                w = w[:len(w) - rng.randint(0, len(w) // 6)]
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.1 else "\n ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = _groups(rows)
    assert len({c for _, c in want.values()}) < len(rows)
    assert _found(df) == want


def test_common_counts_equal_set_sizes():
    rng = random.Random(7)
    sets = [sorted(rng.sample(range(500), rng.randint(1, 200))) for _ in range(30)]
    packed = [np.array(s, np.uint64) for s in sets]
    got = ngram_jaccard.common_counts(packed[:18], packed[12:], step=64)
    assert got.tolist() == [[len(set(s) & set(t)) for t in sets[12:]] for s in sets[:18]]
    assert ngram_jaccard.common_counts([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0.0]]


def test_large_group_of_loosely_similar_documents(spark, monkeypatch):
    """Most pairs of the group share frequent combinations and fall short of the threshold; blocks of few shingles."""
    monkeypatch.setattr(ngram_jaccard, "FREQUENT_FROM", 4)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SHINGLES", 1500)
    rng = random.Random(11)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 3, 6, 10, 14])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = _groups(rows)
    sizes = Counter(c for _, c in want.values())
    assert 1 < len(sizes) < 90 and max(sizes.values()) > 5
    assert _found(spark.createDataFrame(rows, "doc_id bigint, text string")) == want


def test_signatures_meet_for_every_similar_pair():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.choice([1, 2, 4, 5, 6, 7, 9, 20, 60, 127, 128, 140, 300])
        pool = [rng.getrandbits(64) for _ in range(2 * n)]
        x = set(pool[:n])
        y = set(rng.sample(sorted(x), len(x) - rng.randint(0, n // 5))) | set(pool[n:n + rng.randint(0, n // 8)])
        if not y or 100 * len(x & y) < 80 * len(x | y):
            continue
        count = {t: rng.choice([0, 0, 20, 50]) if rng.random() < 0.5 else 30 for t in x | y}
        if rng.random() < 0.3:
            count = dict.fromkeys(x | y, 40)
        signs = []
        for s in (x, y):
            tokens = np.array(sorted(s), np.uint64)
            signs.append(set(ngram_jaccard.signatures(tokens, np.array([count[int(t)] for t in tokens])).tolist()))
        assert signs[0] & signs[1]
        a, b = (ngram_jaccard.parity(np.array(sorted(s), np.uint64)) for s in (x, y))
        assert ngram_jaccard.may_be_similar(a, b, len(x), len(y))


def test_groups_of_edge_rows(spark):
    rows = EDGE + [(8, "Three Short words", None, None, None), (9, "three short WORDS", None, None, None), (10, "three words", None, None, None)]
    got = _found(clashing(docs(spark, rows), ("n", "rep", "one", "sign", "label")))
    assert got == _groups([r[:2] for r in rows])
    assert got[6][1] == 5 and got[9][1] == 8 and got[10][1] == 10 and got[1] == (0, 1)
    assert ngram_jaccard.similar_groups(docs(spark, [])).collect() == []
    lone = ngram_jaccard.similar_groups(docs(spark, [(None, "a b c", None, None, None)] * 2)).collect()
    assert [r.component_id for r in lone] == [None, None]


def test_groups_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = ngram_jaccard.op10_combination_prefixes(spark, SF0001).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _groups(rows) and len(got) == len(rows)
