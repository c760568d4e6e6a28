"""Blocked top-k products: blocks as large as a group may hold, tiles in single precision that lose no entry."""

import numpy as np
import pandas as pd
import pytest

from cartlens.operators import blocks


def rows(n, seed, dim=40):
    """(id, idx, val): few to many entries; every fifth row equals the one before, so that scores tie."""
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        if i % 5 == 4:
            out.append((1000 * seed + i, *out[-1][1:]))
            continue
        idx = np.sort(rng.choice(dim, rng.integers(1, 4 if i % 2 else 20), replace=False))
        out.append((1000 * seed + i, [int(x) for x in idx], [float(x) for x in rng.random(idx.size) + 0.01]))
    return out


def expected(left, right, k, gone, dim=40):
    def dense(rs):
        m = np.zeros((len(rs), dim))
        for r, (_, idx, val) in enumerate(rs):
            m[r, idx] = val
        return m
    s, got = dense(left) @ dense(right).T, {}
    for r, (i, *_) in enumerate(left):
        able = sorted((-round(x, 10), j[0]) for j, x in zip(right, s[r]) if x > 0 and (i, j[0]) not in gone)
        got[i] = [j for _, j in able[:k]]
    return {i: js for i, js in got.items() if js}


def lists(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["left_id"], r["rank"])):
        got.setdefault(r["left_id"], []).append(r["right_id"])
    return got


@pytest.mark.parametrize("tiles,block_rows", [((7, 11), 1000), ((1024, 4096), 30), ((16, 16), 50)])
@pytest.mark.parametrize("rechecked", [0, 40, 10_000])
def test_lists_equal_brute_force(monkeypatch, tiles, block_rows, rechecked):
    monkeypatch.setattr(blocks, "TILE_LEFT", tiles[0])
    monkeypatch.setattr(blocks, "TILE_RIGHT", tiles[1])
    monkeypatch.setattr(blocks, "RECHECKED", rechecked)
    left, right = rows(90, 1), rows(130, 2)
    frame = lambda rs, side: pd.DataFrame(rs, columns=["id", "idx", "val"]).assign(a=0, b=side % 2, side=side)
    gone = {(i, j) for n, (i, *_) in enumerate(left) for j, *_ in right[n % 7:n:3]}
    seen = pd.DataFrame([(i, [j for a, j in gone if a == i]) for i in {a for a, _ in gone}], columns=["id", "excl"])
    out = blocks._kernel(40, 4, False, False)(pd.concat([frame(left, 0), frame(right, 1), seen.assign(a=0, b=1, side=2)]))
    out["rank"] = out.sort_values("score", ascending=False, kind="stable").groupby("left_id").cumcount()
    got = {i: list(g.assign(key=-g["score"].round(10)).sort_values(["key", "right_id"])["right_id"]) for i, g in out.groupby("left_id")}
    assert got == expected(left, right, 4, gone)
    # one block against another, both ways
    a = frame(left, 0).assign(b=1)
    b = frame(right, 1).assign(b=1)
    out = blocks._kernel(40, 4, True, True)(pd.concat([a, b]))
    got = {i: list(g.assign(key=-g["score"].round(10)).sort_values(["key", "right_id"])["right_id"]) for i, g in out.groupby("left_id")}
    assert got == expected(left, right, 4, set()) | expected(right, left, 4, set())


def test_top_k_dot_with_many_blocks(spark):
    left, right = rows(60, 1), rows(100, 2)
    schema = "id long, idx array<int>, val array<double>"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    gone = {(left[n % 60][0], right[(n * 7) % 100][0]) for n in range(300)}
    ex = spark.createDataFrame(sorted(gone), "id long, right_id long")
    assert lists(blocks.top_k_dot(l, r, 40, 5, left_excl=ex, block_rows=25)) == expected(left, right, 5, gone)
    own = {(i, i) for i, *_ in right}
    assert lists(blocks.top_k_dot(r, None, 40, 5, exclude_self=True, block_rows=30)) == expected(right, right, 5, own)


def test_copies_follow_what_a_group_holds():
    """60 times the rows meant 586 copies of each row in blocks of 2 048; now as many as bounded groups need."""
    n = (1_200_000, 60_000_000)
    nl, nr = blocks.grid(n, n, 48)
    assert max(nl, nr) <= 10 and 2 * n[1] / nl <= blocks.GROUP_ENTRIES * 1.01
    assert blocks.grid((500, 5000), (700, 7000), 48) == (1, 1)
    nl, nr = blocks.grid((100, 1000), (400_000, 4_000_000), 48)
    assert nl == 1 and nr == 48
