"""Exact top-k dot products between two sets of short dense vectors, in blocks.

Used where every row of one side must be scored against every row of the
other (all products against all products, every user profile against every
product, every search query against every product).  The vectors live in the
vocabulary space (at most ``max_features`` dimensions), so a block pair is a
small dense matrix product.

Plans: where the left rows are enough for all tasks, groups of them read the written
right rows past their own, chunk by chunk (``streamed``), and no row is copied.
Else each side is split into hash blocks.  A row is replicated once per block
of the other side (``explode`` over the block count), the pairs are grouped by
(left block, right block) and each group runs in ``applyInPandas``.  Copies are
what this plan writes, so blocks are as large as a group may hold: at most
``GROUP_ENTRIES`` vector entries for both, dealt so that the fewest entries are
copied (``grid``), and more only where the tasks would not suffice.  A group
keeps its rows sparse and multiplies tile by tile, so beside the two blocks it
holds one tile of scores and k entries a row, whatever the data size.  The
lists are merged with ``row_number() <= k`` per left row, which keeps the
result exact.  Exclusions (self, already-seen items) are applied before the
cut, so no candidate is lost.

A tile is multiplied in single precision over the dimensions that both sides
have; a score that can reach its row's k-th best, by the bound of the rounding
error, is computed again in double precision (the whole tile, where many can).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartlens.functions.numeric import tie_key
from cartlens.operators import streamed as st
from cartlens.session import materialised

#: Rows of a block, and vector entries of the two blocks of a group, at most.
BLOCK_ROWS = 131_072
GROUP_ENTRIES = 16_000_000
#: Blocks are not cut below so many rows for the sake of more tasks.
LEAST_ROWS = 1_024
#: Rows of a tile on the left and on the right, and single scores of a tile that are computed again one by one.
TILE_LEFT, TILE_RIGHT = 512, 2_048
RECHECKED = 8_192
#: A streamed group bounds tiles of so many right rows, for so many left rows at a time, if its left rows fit this many dense cells.
TILE_BOUND, BOUND_ROWS = 256, 2_048
DENSE_CELLS = 32_000_000
#: Entries of the right rows that a streamed group takes at a time.
CHUNK_ENTRIES = 4_000_000
OUT_SCHEMA = "left_id long, right_id long, score double"


def block_count(n_rows: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(1, math.ceil(n_rows / block_rows))


def grid(left: tuple[int, int], right: tuple[int, int], tasks: int, block_rows: int = BLOCK_ROWS,
         group_entries: int | None = None) -> tuple[int, int]:
    """(left blocks, right blocks) for sides of (rows, entries): bounded groups, few copied entries, about ``tasks`` groups.

    With half of a group's entries on each side the copies cost left entries x right blocks + right entries x left
    blocks, the least for groups of this size.
    """
    half = max(1, (group_entries or GROUP_ENTRIES) // 2)
    nl, nr = (max(block_count(rows, block_rows), math.ceil(entries / half)) for rows, entries in (left, right))
    while nl * nr < tasks:
        able = [(cost, side) for cost, side, rows, n in ((right[1], 0, left[0], nl), (left[1], 1, right[0], nr))
                if rows >= 2 * LEAST_ROWS * n]
        if not able:
            break
        nl, nr = (nl + 1, nr) if min(able)[1] == 0 else (nl, nr + 1)
    return nl, nr


def _block_of(id_col: str, n_blocks: int):
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blocks)).cast("int")


def _flat(lists: pd.Series, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every entry of a column of lists; null lists are empty."""
    own = [np.asarray(x, kind) if x is not None else np.zeros(0, kind) for x in lists]
    values = np.concatenate(own) if own else np.zeros(0, kind)
    return np.repeat(np.arange(len(own)), [len(x) for x in own]), values


def topk_positive(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) of the k best positive entries of each row of ``s``.

    Order: round(score, 10) desc, then column asc (callers keep columns in id
    order).  ``np.partition`` finds each row's k-th key in linear time; only
    the entries at or above it (ties included) are sorted.
    """
    key = -np.round(s, 10)
    key[s <= 0] = np.inf
    n = s.shape[1]
    kk = min(k, n)
    if kk <= 0:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    if n > kk:
        kth = np.partition(key, kk - 1, axis=1)[:, kk - 1:kk]
        r, c = np.nonzero((key <= kth) & np.isfinite(key))
    else:
        r, c = np.nonzero(np.isfinite(key))
    kv = key[r, c]
    order = np.lexsort((c, kv, r))
    r, c = r[order], c[order]
    rank = np.arange(r.size) - np.searchsorted(r, r, "left")
    keep = rank < kk
    return r[keep], c[keep]


class _Rows:
    """The rows of a block, sparse, those with few entries first; ``dense`` gives a tile over some dimensions."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        at, dims = _flat(pdf["idx"], np.int64)
        n = np.bincount(at, minlength=len(pdf))
        self._keep(pdf["id"].to_numpy(np.int64), at, dims, _flat(pdf["val"], np.float64)[1], n, np.argsort(n, kind="stable"), dim)

    @classmethod
    def of(cls, ids: np.ndarray, dims: np.ndarray, val: np.ndarray, dim: int) -> _Rows:
        """Rows of flat entries, those of an id side by side; rows with the same heaviest dimensions lie together."""
        got = cls.__new__(cls)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        at = np.repeat(np.arange(first.size), np.diff(np.append(first, ids.size)))
        n = np.bincount(at, minlength=first.size)
        heavy = np.lexsort((dims, -val, at))
        tops = []
        for i in range(4):
            tops.append(np.where(n > i, dims[heavy][np.minimum(first + i, ids.size - 1)], -1))
        got._keep(ids[first], at, dims, val, n, np.lexsort((n, *tops[::-1])), dim)
        return got

    def _keep(self, ids, at, dims, val, n, order, dim) -> None:
        place = np.empty(n.size, np.int64)
        place[order] = np.arange(n.size)
        entry = np.argsort(place[at], kind="stable")
        self.dim, self.order, self.place = dim, order, place
        self.ids = ids[order]
        self.dims, self.val = dims[entry].astype(np.int32), val[entry]
        self.start = np.concatenate([[0], np.cumsum(n[order])])

    def __len__(self):
        return len(self.ids)

    def used(self, lo: int, hi: int) -> np.ndarray:
        got = np.zeros(self.dim, bool)
        got[self.dims[self.start[lo]:self.start[hi]]] = True
        return got

    def dense(self, lo: int, hi: int, cols: np.ndarray, kind: type) -> np.ndarray:
        col = np.full(self.dim, -1)
        col[cols] = np.arange(cols.size)
        at = slice(self.start[lo], self.start[hi])
        r = np.repeat(np.arange(hi - lo), np.diff(self.start[lo:hi + 1]))
        c = col[self.dims[at]]
        mat = np.zeros((hi - lo, cols.size), kind)
        mat[r[c >= 0], c[c >= 0]] = self.val[at][c >= 0]
        return mat


    def times(self, rows: np.ndarray, other: np.ndarray, of: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Exact products of rows with rows ``of`` of the tile ``other`` over the dimensions ``cols``."""
        col = np.full(self.dim, -1)
        col[cols] = np.arange(cols.size)
        n = np.diff(self.start)[rows]
        pos = st.spread(self.start[rows], n)
        at, c = np.repeat(np.arange(rows.size), n), col[self.dims[pos]]
        return np.bincount(at, weights=np.where(c >= 0, self.val[pos] * other[of[at], c], 0.0), minlength=rows.size)


class _Best:
    """The k best entries seen so far of each row, best first (round(score, 10) desc, id asc); empty places score 0."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.zeros((n, k)), np.zeros((n, k), np.int64)

    def bound(self, lo: int, hi: int) -> np.ndarray:
        """What a new entry of each row must reach, but for ties on the grid: the last kept score."""
        return self.score[lo:hi, -1]

    def add(self, row: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        if row.size == 0:
            return
        rows, at = np.unique(row, return_inverse=True)
        old = self.score[rows]
        r, c = np.nonzero(old > 0)
        at, other = np.concatenate([r, at]), np.concatenate([self.id[rows[r], c], other])
        score = np.concatenate([old[r, c], score])
        order = np.lexsort((other, -np.round(score, 10), at))
        at, other, score = at[order], other[order], score[order]
        rank = np.arange(at.size) - np.searchsorted(at, at, "left")
        keep = rank < self.k
        self.score[rows[at[keep]], rank[keep]] = score[keep]
        self.id[rows[at[keep]], rank[keep]] = other[keep]

    def found(self, ids: np.ndarray) -> pd.DataFrame:
        r, c = np.nonzero(self.score > 0)
        return pd.DataFrame({"left_id": ids[r], "right_id": self.id[r, c], "score": self.score[r, c]})


def _meet(left: _Rows, right: _Rows, k: int, both: bool, gone: tuple[np.ndarray, np.ndarray], so_far: _Best | None = None) -> list[_Best]:
    """The best lists of the left rows, with ``both`` also of the right ones; ``gone``: places (left, right) that do not count.

    ``so_far``: the left rows' lists from other right rows; the new entries are added to them.
    """
    for_left, for_right = so_far or _Best(len(left), k), _Best(len(right) if both else 0, k)
    by_row = np.argsort(gone[0], kind="stable")
    gone_l, gone_r = gone[0][by_row], gone[1][by_row]
    least = min((x.val.min() for x in (left, right) if x.val.size), default=0.0)
    single = least > 1e-12  # sums of products of positive numbers that single precision holds
    for l0 in range(0, len(left), TILE_LEFT):
        l1 = min(l0 + TILE_LEFT, len(left))
        l_used = left.used(l0, l1)
        mine = slice(*np.searchsorted(gone_l, [l0, l1]))
        for r0 in range(0, len(right), TILE_RIGHT):
            r1 = min(r0 + TILE_RIGHT, len(right))
            cols = np.flatnonzero(l_used & right.used(r0, r1))
            if cols.size == 0:
                continue
            here = (gone_r[mine] >= r0) & (gone_r[mine] < r1)
            out = gone_l[mine][here] - l0, gone_r[mine][here] - r0
            lm, rm = left.dense(l0, l1, cols, np.float64), right.dense(r0, r1, cols, np.float64)
            low_l = for_left.bound(l0, l1)
            if single and not both and not (lm @ rm.max(0) >= low_l - 1e-8).any():
                continue  # no row of the tile can score so much, whatever its entries
            low_r = for_right.bound(r0, r1) if both else None
            r = None
            if single:
                s = lm.astype(np.float32) @ rm.astype(np.float32).T
                s[out] = 0.0
                # |error| of a product of m entries: at most (m + 2) roundings of 2**-24, each of the norms' product
                err = (cols.size + 4) * 2.0 ** -23 * np.sqrt((lm * lm).sum(1).max() * (rm * rm).sum(1).max()) + 1e-9
                able = s >= np.maximum(low_l - err, 1e-30).astype(np.float32)[:, None]
                if both:
                    able |= s >= np.maximum(low_r - err, 1e-30).astype(np.float32)[None, :]
                if np.count_nonzero(able) <= RECHECKED:
                    r, c = np.divmod(np.flatnonzero(able), r1 - r0)
                    exact = np.empty(r.size)
                    for i in range(0, r.size, 16_384):
                        exact[i:i + 16_384] = np.einsum("ij,ij->i", lm[r[i:i + 16_384]], rm[c[i:i + 16_384]])
                    in_left = in_right = slice(None)
                    if both:
                        in_left, in_right = exact >= low_l[r] - 1e-9, exact >= low_r[c] - 1e-9
                    for_left.add(r[in_left] + l0, right.ids[c[in_left] + r0], exact[in_left])
                    if both:
                        for_right.add(c[in_right] + r0, left.ids[r[in_right] + l0], exact[in_right])
            if r is None:
                s = lm @ rm.T
                s[out] = 0.0
                _add_tile(for_left, l0, s, right.ids[r0:r1])
                if both:
                    _add_tile(for_right, r0, s.T, left.ids[l0:l1])
    return [for_left, for_right] if both else [for_left]


def _meet_chunk(left: _Rows, dense: np.ndarray, right: _Rows, best: _Best, gone: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds a chunk of right rows to the lists of all left rows; ``dense``: the left rows in single precision.

    All values are positive, so a row's product with the greatest values of a tile bounds its products with the tile's
    rows.  Only left rows whose bound reaches their k-th best meet the tile, those with the greatest bounds first.
    """
    cuts = np.append(np.arange(0, len(right), TILE_BOUND), len(right))
    tops = np.zeros((cuts.size - 1, right.dim), np.float32)
    np.maximum.at(tops, (np.repeat(np.arange(cuts.size - 1), np.diff(right.start[cuts])), right.dims), right.val.astype(np.float32))
    length = np.sqrt(np.einsum("ij,ij->i", dense, dense, dtype=np.float64))
    # |error| of a product of m entries: at most (m + 2) roundings of 2**-24, each of the norms' product
    slack = (right.dim + 4) * 2.0 ** -23 * length
    wide = np.sqrt((tops.astype(np.float64) ** 2).sum(1))
    by_row = np.argsort(gone[1], kind="stable")
    gone_l, gone_r = gone[0][by_row], gone[1][by_row]
    for l0 in range(0, len(left), BOUND_ROWS):
        l1 = min(l0 + BOUND_ROWS, len(left))
        bound = dense[l0:l1] @ tops.T
        for t in np.argsort(-bound.sum(0), kind="stable"):
            r0, r1 = cuts[t], cuts[t + 1]
            low = best.bound(l0, l1)
            rows = np.flatnonzero(bound[:, t] >= low - slack[l0:l1] * wide[t] - 1e-9)
            if rows.size == 0:
                continue
            cols = np.flatnonzero(tops[t])
            rm = right.dense(r0, r1, cols, np.float64)
            lm = dense[l0 + rows][:, cols]
            s = lm @ rm.astype(np.float32).T
            out = slice(*np.searchsorted(gone_r, [r0, r1]))
            mine = np.flatnonzero((gone_l[out] >= l0) & (gone_l[out] < l1))
            if mine.size:
                at = np.minimum(np.searchsorted(rows, gone_l[out][mine] - l0), rows.size - 1)
                hit = rows[at] == gone_l[out][mine] - l0
                s[at[hit], gone_r[out][mine][hit] - r0] = 0.0
            norm = np.sqrt((rm * rm).sum(1).max())
            able = s >= np.maximum(low[rows] - slack[l0 + rows] * norm - 1e-9, 1e-30).astype(np.float32)[:, None]
            r, c = np.divmod(np.flatnonzero(able), r1 - r0)
            for i in range(0, r.size, 16_384):
                at, of = r[i:i + 16_384], c[i:i + 16_384]
                exact = left.times(l0 + rows[at], rm, of, cols)
                keep = exact >= best.bound(l0, l1)[rows[at]] - 1e-9
                best.add(l0 + rows[at[keep]], right.ids[r0 + of[keep]], exact[keep])


def _add_tile(best: _Best, lo: int, s: np.ndarray, ids: np.ndarray) -> None:
    order = np.argsort(ids, kind="stable")
    r, c = topk_positive(s[:, order], best.k)
    best.add(r + lo, ids[order[c]], s[r, order[c]])


def _places(rows: np.ndarray, wanted: np.ndarray, right: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """(row, place on the right) of every wanted right id that the right block holds."""
    order = np.argsort(right.ids, kind="stable")
    lo, hi = (np.searchsorted(right.ids[order], wanted, side) for side in ("left", "right"))
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(rows, n), order[at]


def _kernel(dim: int, k: int, symmetric: bool, exclude_self: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        left = _Rows(pdf[side == 0], dim)
        # diagonal block: the block against itself
        right = left if symmetric and pdf["a"].iloc[0] == pdf["b"].iloc[0] else _Rows(pdf[side == 1], dim)
        if len(left) == 0 or len(right) == 0 or k <= 0:
            return pd.DataFrame({"left_id": pd.Series(dtype="int64"), "right_id": pd.Series(dtype="int64"),
                                 "score": pd.Series(dtype="float64")})
        gone = []
        if exclude_self:
            gone.append(_places(np.arange(len(left)), left.ids, right))
        if (side == 2).any():
            seen = pdf[side == 2]
            row, what = _flat(seen["excl"], np.int64)
            pair, at = _places(np.arange(row.size), seen["id"].to_numpy(np.int64)[row], left)
            gone.append(_places(at, what[pair], right))
        none = np.zeros(0, np.int64)
        gone = tuple(np.concatenate([none, *[g[i] for g in gone]]) for i in (0, 1))
        both = symmetric and right is not left
        lists = _meet(left, right, k, both, gone)
        return pd.concat([best.found(rows.ids) for best, rows in zip(lists, (left, right))], ignore_index=True)
    return run


def _streamed_kernel(dim: int, k: int, exclude_self: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, gone, left, best, held, dense = [], [], None, None, [], None

        def meet() -> None:
            nonlocal held
            ids, dims, val = (np.concatenate(x) for x in zip(*held))
            held = []
            right = _Rows.of(ids, dims, val, dim)
            out = _places(gone[0], gone[1], right)
            if exclude_self:
                own = _places(np.arange(len(left)), left.ids, right)
                out = tuple(np.concatenate(x) for x in zip(out, own))
            if dense is not None and right.val.min() > 1e-12:
                _meet_chunk(left, dense, right, best, out)
            else:
                _meet(left, right, k, False, out, best)

        for kind, (ids, key, p, _) in st.runs(batches):
            if kind == st.OWN:
                parts.append((ids, key, p))
                continue
            if left is None:
                if not parts:
                    continue  # no left row fell into this group
                left = _Rows.of(*(np.concatenate(x) for x in zip(*parts)), dim)
                parts, best = [], _Best(len(left), k)
                # single precision holds sums of products of such numbers
                if left.val.min() > 1e-12 and len(left) * dim <= DENSE_CELLS:
                    dense = left.dense(0, len(left), np.arange(dim), np.float32)
            if kind == st.NEAR:
                gone.append((ids, key))
                continue
            if isinstance(gone, list):
                ids_out, right_out = (np.concatenate(x) for x in zip(*gone)) if gone else (np.zeros(0, np.int64),) * 2
                pair, at = _places(np.arange(ids_out.size), ids_out, left)
                gone = at, right_out[pair]
            held.append((ids, key, p))
            if sum(x[0].size for x in held) >= CHUNK_ENTRIES:
                meet()
        if left is not None:
            if held:
                meet()
            row, place = np.nonzero(best.score > 0)
            yield pd.DataFrame({"left_id": left.ids[row], "right_id": best.id[row, place], "score": best.score[row, place],
                                "rank": (place + 1).astype(np.int32)})
    return run


def _streamed(left: DataFrame, right: DataFrame, n_left: tuple[int, int], dim: int, k: int, left_excl: DataFrame | None,
              exclude_self: bool) -> DataFrame:
    """``top_k_dot`` of many left rows: groups of them read all right rows past their own, and no row is copied."""
    flat = lambda df: df.where("size(idx) > 0").select("id", F.col("idx").cast("array<bigint>").alias("keys"), "val")
    own = materialised(flat(left), "left_rows")
    all_right = own if right is left else materialised(flat(right), "right_rows")
    if left_excl is None:
        gone = own.where(F.lit(False)).select("id", "keys", "val")
    else:
        gone = materialised(left_excl.where("id IS NOT NULL AND right_id IS NOT NULL").groupBy("id").agg(F.collect_list("right_id").alias("keys"))
                            .select("id", "keys", F.transform("keys", lambda x: F.lit(0.0)).alias("val")), "seen_rows")
    slots = left.sparkSession.sparkContext.defaultParallelism
    groups = max(slots, block_count(n_left[0]), math.ceil(n_left[1] / max(1, GROUP_ENTRIES // 2)), math.ceil(1.1 * n_left[0] * dim / DENSE_CELLS))
    return st.each_group(own, ("val", "val"), [(gone, "val", "val"), (all_right, "val", "val")], groups,
                         _streamed_kernel(dim, k, exclude_self), OUT_SCHEMA + ", rank int", ["left_id", "right_id", "score", "rank"],
                         with_own=(st.NEAR,))


def _sized(df: DataFrame) -> tuple[int, int]:
    """(rows, entries)."""
    got = df.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size("idx"), F.lit(0)))).first()
    return got[0], got[1] or 0


def top_k_dot(left: DataFrame, right: DataFrame | None, dim: int, k: int,
              left_excl: DataFrame | None = None, exclude_self: bool = False,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top-k right rows per left row by dot product (> 0 only).

    ``left``/``right``: (id long, idx array<int>, val array<double>), sparse
    vectors over ``dim`` dimensions.  ``right=None`` means right = left; of few
    rows only block pairs a <= b are computed (the product is symmetric).
    ``left_excl``: optional (id, right_id) pairs that must not be returned
    (for example items a user has already seen); they are grouped per (left
    row, right block), so each list is bounded by the block size, and join the
    one exchange as rows of their own.
    Where the left rows alone give every task enough, nothing is copied: see ``_streamed``.
    Result: (left_id, right_id, score, rank).
    """
    symmetric = right is None
    # each side is read twice (its size picks the block count, then the rows are
    # shipped), so it is materialised once
    left = materialised(left.select("id", "idx", "val"), "vectors")
    n_left = _sized(left)
    if k > 0 and n_left[0] >= LEAST_ROWS * left.sparkSession.sparkContext.defaultParallelism:
        return _streamed(left, left if symmetric else right, n_left, dim, k, left_excl, exclude_self)
    if not symmetric:
        right = materialised(right.select("id", "idx", "val"), "vectors")
    tasks = 2 * left.sparkSession.sparkContext.defaultParallelism
    nb_l, nb_r = grid(n_left, n_left if symmetric else _sized(right), 2 * tasks if symmetric else tasks, block_rows)
    if symmetric:
        nb_l = nb_r = max(nb_l, nb_r)

    lrows = left.select("id", "idx", "val").withColumn("_blk", _block_of("id", nb_l))
    if symmetric:
        # block x meets every block: as the left side of (x, b) for b >= x, as the right side of (a, x) for a < x
        as_left = lrows.select(F.col("_blk").alias("a"), F.explode(F.sequence(F.col("_blk"), F.lit(nb_l - 1))).alias("b"),
                               F.lit(0).alias("side"), "id", "idx", "val")
        as_right = lrows.filter(F.col("_blk") > 0).select(
            F.explode(F.sequence(F.lit(0), F.col("_blk") - 1)).alias("a"), F.col("_blk").alias("b"),
            F.lit(1).alias("side"), "id", "idx", "val")
        pairs = as_left.unionByName(as_right)
    else:
        rrows = right.select("id", "idx", "val").withColumn("_blk", _block_of("id", nb_r))
        as_left = lrows.select(F.col("_blk").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(nb_r - 1))).alias("b"),
                               F.lit(0).alias("side"), "id", "idx", "val")
        as_right = rrows.select(F.explode(F.sequence(F.lit(0), F.lit(nb_l - 1))).alias("a"), F.col("_blk").alias("b"),
                                F.lit(1).alias("side"), "id", "idx", "val")
        pairs = as_left.unionByName(as_right)
        if left_excl is not None:
            ex = (left_excl.where("id IS NOT NULL").select(_block_of("id", nb_l).alias("a"), _block_of("right_id", nb_r).alias("b"),
                                                           F.lit(2).alias("side"), "id", "right_id")
                  .groupBy("a", "b", "side", "id").agg(F.collect_list("right_id").alias("excl")))
            pairs = pairs.unionByName(ex, allowMissingColumns=True)

    kernel = _kernel(dim, k, symmetric, exclude_self)
    cand = pairs.groupBy("a", "b").applyInPandas(kernel, schema=OUT_SCHEMA)
    w = Window.partitionBy("left_id").orderBy(tie_key(F.col("score")).desc(), F.col("right_id").asc())
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
