"""Operators 12 and 13 against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.llm import embedding_whitening as ew
from cartlens.llm import merkle_manifest as mm
from tests.llm.helpers import EDGE, SF0001, clashing, docs

BIG = [(None, "x y", "en", "a", 1), (2 ** 60 + 1, "One", "en", "a", 1), (2 ** 60 + 2, "Two", None, "", 2), (-3, "Ü A", "de", "é", None)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            first = i // 16 * 16
            run = level[first:first + 16]
            out.append(("".join(run[:i - first]), "".join(run[i - first + 1:])))
            i //= 16
        return out

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            p = path(trees[s], i) + path(top, k)
            t = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                t = r[:4] + ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]),)
            at = leaf(t)
            for a, b in p:
                at = sha(a + at + b)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, sha("".join(a + b for a, b in p)), at, at == root))
    return out


def as_sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


def fields(df):
    return [tuple(r) for r in df.select(*mm.FIELDS).collect()]


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_brute_force(spark, levels):
    df = spark.read.parquet(f"{SF0001}/documents.parquet")
    df = df.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.concat("source", F.col("doc_id") % 40)))
    assert as_sorted(mm.manifest(df, levels).collect()) == as_sorted(brute(fields(df)))


def test_manifest_of_edge_cases(spark):
    df = clashing(docs(spark, EDGE + BIG), ("n", "place", "tree", "digest", "Section", "other", "height", "task"))
    got = mm.manifest(df).collect()
    assert as_sorted(got) == as_sorted(brute(fields(df)))
    assert {r["doc_id"] for r in got} >= {None, 2 ** 60 + 1, 2 ** 60 + 2}


def test_manifest_of_one_row_and_of_none(spark):
    one = mm.manifest(docs(spark, EDGE[4:5])).collect()
    assert as_sorted(one) == as_sorted(brute([(5, None, "en", 50, EDGE[4][1])]))
    assert one[0]["leaf"] == one[0]["root"] and one[0]["proof_sha256"] == sha("")
    assert mm.manifest(docs(spark, [])).collect() == []


def test_tampering_is_found(spark):
    df = docs(spark, [(i, "Text " + "A" * (i % 2), "en", "s", i) for i in range(300)])
    for r in mm.manifest(df).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def reference(x, components=8):
    n, mean = len(x), x.sum(axis=0) / len(x)
    centred = (x - np.floor(mean).astype(np.int64)) - (mean - np.floor(mean))
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_equals_full_eigendecomposition(spark):
    rows = spark.read.parquet(f"{SF0001}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(np.int64) + 100_000
    ids = {r[0]: i for i, r in enumerate(rows)}
    whitened, explained = reference(x)
    deviation = ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)
    got = ew.op13_chebyshev_whitening(spark, SF0001).toPandas()
    assert len(got) == 8 * len(x) and (got["n"] == len(x)).all() and (got["identity_error"] < 1e-9).all()
    for k, own in got.groupby("component"):
        at = own["vec_id"].map(ids)
        assert (own["deviation"].to_numpy() == deviation[at]).all()
        want = whitened[at, k - 1]
        assert min(np.abs(own["whitened"] - want).max(), np.abs(own["whitened"] + want).max()) < 1e-8
        assert np.allclose(own["explained"], explained[k - 1], rtol=1e-9)


@pytest.mark.parametrize("spectrum", [1 / np.arange(1.0, 101) ** 2, np.r_[np.linspace(3, 1.5, 60), np.zeros(40)], np.ones(64),
                                      np.r_[1.0, np.zeros(63)], np.ones(1), np.array([2.0, 1.0])])
def test_eigenpairs_of_many_spectra(spectrum):
    d = len(spectrum)
    turn = np.linalg.qr(np.random.default_rng(5).standard_normal((d, d)))[0]
    v = (turn * spectrum) @ turn.T
    values, vectors = ew.leading_eigenpairs(lambda q: v @ q, d)
    assert np.allclose(values, spectrum[:8], atol=1e-10) and len(values) == min(8, d)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def test_whitening_edge_cases(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.standard_normal(3)], 0) for i in range(40)]
    rows += [rows[0], (None, rows[1][1], 0), (2 ** 60 + 1, rows[2][1], 0), (2 ** 60 + 2, rows[3][1], 0)]
    bad = [(90, None, 0), (91, [1.0, None, 2.0], 0), (92, [1.0, float("nan"), 2.0], 0), (93, [float("inf"), 1.0, 2.0], 0), (94, [], 0),
           (95, [1.0, 2.0], 0)]
    spark.createDataFrame(rows + bad, VECTORS).withColumn("whitened", F.lit("x")).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = ew.op13_chebyshev_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 3 * 44 and {r["n"] for r in got} == {44}
    assert {r["vec_id"] for r in got} == set(range(40)) | {None, 2 ** 60 + 1, 2 ** 60 + 2}
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float32).astype(np.float64)).astype(np.int64) + 100_000
    want = sorted(int(v) for v in ((44 * x - x.sum(axis=0)) ** 2).sum(axis=1))
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == want
    assert abs(sum(r["explained"] for r in got) - 44) < 1e-6


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    spark.createDataFrame(rows, VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert ew.op13_chebyshev_whitening(spark, str(tmp_path)).collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [2.0 ** 40])], "vec_id bigint, v array<double>")
    out = ew.whiten(df, ew.fit(df, "v"), "v").collect()
    assert [r["deviation"] for r in out] == [None, None]
