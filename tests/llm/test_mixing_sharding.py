import re
import zlib

import numpy as np
import pytest

from cartlens.llm import mixing, sharding
from tests.llm.helpers import EDGE, SF0001, clashing, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _targets(size_of, weights=(1, 2, 3), most=3):
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(size_of.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * size_of[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= most * size_of[s]}
        if not over:
            return share | {s: most * size_of[s] for s in capped}
        capped |= over
        if len(capped) == len(names):
            return {s: most * size_of[s] for s in names}


def _check(rows, texts):
    size = {d: len(WORD.findall(t or "")) for d, t, _ in texts}
    size_of = {}
    for d, _, s in texts:
        size_of[s] = size_of.get(s, 0) + size[d]
    target = _targets(size_of)
    source = {d: s for d, _, s in texts}
    taken = {}
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == size_of[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"]
        assert (r.position is None) == (r.passes == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    where = [r.position for r in rows if r.position is not None]
    assert where == sorted(where)


def test_query_and_reruns(spark):
    texts = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    rows = mixing.op3_curriculum_mix(spark, SF0001).collect()
    assert len(rows) == len(texts)
    _check(rows, texts)
    assert rows == mixing.op3_curriculum_mix(spark, SF0001).collect()


def test_edge_rows(spark):
    once = [r for i, r in enumerate(EDGE) if r not in EDGE[:i]]
    rows = mixing.mix(clashing(docs(spark, once))).collect()
    _check(rows, [(r[0], r[1], r[3]) for r in once])
    assert len(mixing.mix(docs(spark)).collect()) == len(EDGE)  # a repeated row is a row
    assert mixing.mix(docs(spark, [])).collect() == []
    nothing = mixing.mix(docs(spark, [(1, None, None, None, None)])).collect()
    assert (nothing[0].taken, nothing[0].target) == (0, 0.0)


def test_inverse_of_the_demand(spark):
    from pyspark.sql import functions as F
    for knots in (*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0))):
        got = spark.range(101).select((F.col("id") / 100).alias("q"), mixing.inverse_demand(F.col("id") / 100, knots).alias("t")).collect()
        for r in got:  # integrate the schedule up to the position
            t = np.linspace(0, r.t, 4001)
            w = np.interp(t, *zip(*knots))
            everything = np.trapezoid(np.interp(s := np.linspace(0, 1, 4001), *zip(*knots)), s)
            assert np.trapezoid(w, t) / everything == pytest.approx(r.q, abs=2e-4)
    with pytest.raises(ValueError):
        mixing.segments(((0.0, 1.0), (0.5, 1.0)))


def _jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_plain_walk_and_moves_little():
    keys = np.random.default_rng(0).integers(0, 2**63, 4000).astype(np.uint64)
    for n in (1, 2, 16, 17):
        assert sharding.jump(keys, n).tolist() == [_jump(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(b[a != b]) == {16} and 0.03 < (a != b).mean() < 0.09
    with pytest.raises(ValueError):
        sharding.jump(keys, 0)


def test_shard_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    rows = sharding.op4_jump_sharding(spark, SF0001).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_edge_rows(spark):
    df = clashing(docs(spark, EDGE + [(None, "x", None, None, None)]))
    got = sharding.assign_shards(df, ["doc_id"]).collect()
    assert len(got) == len(EDGE) + 1 and set(df.columns) <= set(got[0].asDict())
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())
    assert sharding.assign_shards(docs(spark, []), ["doc_id"]).collect() == []
    same = sharding.assign_shards(docs(spark, EDGE), ["text"]).where("doc_id in (5, 6)").select("shard").distinct().count()
    assert same == 1  # equal keys share a shard
