import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartlens.llm import packing
from tests.llm.helpers import EDGE, LONG, SF0001, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_those_of_the_tokenizer():
    rng = random.Random(5)
    parts = [" ", " ", "a", "B", "é", "\n", ".", ",", "'s", "'", "1", "_", "²", "\t", "|", "ª", "\0", "日本", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(3000)] + ["", "  ", LONG]
    encode = packing._encoder(PATH)
    assert [encode(t) for t in texts] == [np.array(i, "<u4").tobytes() for i in _ids(texts)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_uses_every_piece_once(histogram):
    plan = packing.plan_packing(histogram, 64)
    used = {}
    for pattern, copies in plan:
        assert sum(pattern) <= 64 and copies > 0
        for x in pattern:
            used[x] = used.get(x, 0) + copies
    assert used == histogram


def test_plan_is_close_to_the_least_number():
    rng = random.Random(1)
    histogram = {}
    for _ in range(20_000):
        x = min(2048, int(rng.lognormvariate(5.5, 1)) + 1)
        histogram[x] = histogram.get(x, 0) + 1
    total = sum(k * v for k, v in histogram.items())
    assert sum(n for _, n in packing.plan_packing(histogram)) <= -(-total // 2048) + 1


def test_exact_combinations_are_taken_first():
    assert dict(packing.plan_packing({60: 1, 30: 1, 20: 1, 10: 1}, 100)) in ({(60, 30, 10): 1, (20,): 1},)
    assert packing.plan_packing({50: 4}, 100) == [((50, 50), 2)]
    with pytest.raises(ValueError):
        packing.plan_packing({0: 1}, 10)


def _check(rows, texts):
    pieces = {}
    for r in rows:
        pieces.setdefault(r.sequence_id, []).append(r)
    for own in pieces.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    whole = {d: i + [0] for (d, _), i in zip(texts, _ids([t or "" for _, t in texts]))}
    for d, ids in whole.items():
        got = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d})
        assert [g[0] for g in got] == list(range(len(got))) and sum(g[2] for g in got) == len(ids)
        assert all(g[2] == 2048 for g in got[1:])
        for _, start, length, crc in got:
            assert crc == zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())


def test_edge_texts_pack(spark, tmp_path):
    from cartlens.llm.common import stored
    pieces = stored(packing.tokenized_pieces(docs(spark), PATH), "pieces")
    rows = packing.pack(pieces).collect()
    assert len(rows) == pieces.count()
    _check(rows, [r[:2] for r in EDGE])
    empty = stored(packing.tokenized_pieces(docs(spark, []), PATH), "pieces")
    assert packing.pack(empty).collect() == []


def test_query(spark):
    rows = packing.op2_complement_packing(spark, SF0001).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    _check(rows, texts)
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 2


def test_short_cut_ids_equal_the_tokenizers_own(spark):
    """Every piece of real texts, and pieces of all kinds of characters, against the tokenizer by itself."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r[0]]
    odd = ["don't I'll we've 'S", "x1y2 3.14 a_b", "ÀÉ żółć Ελλάδα Привет", "日本語 テスト", "a b c d", "tab\tand\r\nline\x1c\x85end", "é soft­hyphen",
           "\n\n a\n\n\nb \n", "١٢٣ ½ ²", "ʼn ǅ ª º", "😀 ok 👩‍👩‍👧", "'re 're're", "ԱԲ ӿ ԯ", "".join(map(chr, range(32, 0x530)))]
    odd += [f"a {chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}" for c in range(33, 0x600)]
    encode = packing._encoder(PATH)
    assert [encode(t) for t in texts + odd] == [np.array(i, "<u4").tobytes() for i in _ids(texts + odd)]


def test_an_added_token_has_its_own_id():
    encode = packing._encoder(PATH)
    for text in ("a<|endoftext|>b", "see <|endoftext|> here", "<|endoftext|>", "<|endoftext", "one <|endoftext|><|endoftext|> two"):
        assert encode(text) == np.array(_ids([text])[0], "<u4").tobytes()
    assert np.frombuffer(encode("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]
