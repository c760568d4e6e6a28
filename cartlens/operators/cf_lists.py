"""CF lists of all users from neighbour histories, streamed: no item-pair table, nothing sent.

Same scores as ``cf.cohort_scores``, for everyone at once:

  user-based  score(u,i) = sum_v a(u,v) r(v,i)          a(u,v) = cos(u,v)
  item-based  score(u,i) = sum_v b(u,v) r(v,i) / |i|    b(u,v) = sum_j r(u,j) r(v,j) / |j|

Two sparse tables are written, a row per product and a row per user.  The task of a group of users reads its users'
rows, then all users' rows, which give its users' neighbours with both weights, then all products' rows: a product's row
has everyone who bought it, so each row gives the product's complete scores for the group, and only what can still be
among a user's top k is kept.  A task holds its users' neighbours (about ``NEIGHBOURS`` at most, users are dealt to
groups by that), and the disk holds the two tables: what grows with the number of groups is reading (``streamed``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.operators import streamed as st
from cartlens.session import materialised

NAMES = ["list", "user_id", "product_id", "score", "rank"]
OUT_SCHEMA = "list string, user_id long, product_id long, score double, rank int"
NEIGHBOURS = 16_000_000  # neighbours of a group's users that it keeps
STEP = 200_000  # products in one NumPy step, so that its arrays stay in the cache
CELLS = 1_048_576  # (product, user) cells of one step


class _Group:
    """The users of a group with their neighbours; ``add`` takes products' rows, ``lists`` has the result."""

    def __init__(self, own: st.Own, cuts: tuple):
        self.own, self.n = own, own.ids.size
        k_user, k_item, k_blend, self.uw, self.iw = cuts
        self.best = {name: st.Best(self.n, k, own.has) for name, k in (("user", k_user), ("item", k_item), ("blend", k_blend))}
        self.near = []
        self.mark = np.zeros(max(CELLS, self.n), np.int32)

    def neighbours(self, rows: tuple[np.ndarray, ...]) -> None:
        self.near += [(v, at.astype(np.int32), a, b) for v, at, a, b in self.own.meet(rows, STEP)]

    def close(self) -> None:
        """All neighbours are there: index them by id."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0))
        parts, self.near = list(zip(*self.near)) or [[x] for x in none], []
        v = np.concatenate(parts[0])
        ids, run = np.unique(v, return_inverse=True)
        order = np.argsort(run, kind="stable")
        self.ends = np.cumsum(np.bincount(run, minlength=ids.size))
        del v, run
        self.ids = st.Places(ids)
        self.at, self.a, self.b = (np.concatenate(x)[order] for x in parts[1:])

    def add(self, rows: tuple[np.ndarray, ...]) -> None:
        item, v, p, q = rows
        slot = self.ids.of(v)
        here = np.flatnonzero(slot >= 0)
        if here.size == 0:
            return
        item, p, q, slot = item[here], p[here], q[here], slot[here]
        start = np.where(slot > 0, self.ends[slot - 1], 0)
        n = self.ends[slot] - start
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        bounds = np.append(first, item.size)
        work = np.cumsum(np.add.reduceat(n, first))
        most = max(1, CELLS // self.n)
        lo = 0
        while lo < first.size:
            done = work[lo - 1] if lo else 0
            hi = min(lo + most, max(lo + 1, int(np.searchsorted(work, done + STEP, "right"))))
            e = slice(bounds[lo], bounds[hi])
            row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo:hi + 1]))
            self._offer(item[first[lo:hi]], *self._sums(row, start[e], n[e], p[e], q[e]))
            lo = hi

    def _sums(self, row, start, n, p, q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, user-based sum, item-based sum before the division); cell = row * users + user."""
        ends = np.cumsum(n)
        if ends[-1] > STEP:  # one product: a cell per user, summed in several steps
            su, si, lo = np.zeros(self.n), np.zeros(self.n), 0
            while lo < n.size:
                done = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + STEP, "right")))
                pos = st.spread(start[lo:hi], n[lo:hi])
                for total, w, x in ((su, self.a, p), (si, self.b, q)):
                    total += np.bincount(self.at[pos], weights=w[pos] * np.repeat(x[lo:hi], n[lo:hi]), minlength=self.n)
                lo = hi
            cells = np.flatnonzero((su > 0) | (si > 0))
            return cells, su[cells], si[cells]
        pos = st.spread(start, n)
        cell = np.repeat(row * self.n, n) + self.at[pos]
        place = np.arange(cell.size, dtype=np.int32)
        self.mark[cell] = place
        cell_of = self.mark[cell]
        first = np.flatnonzero(cell_of == place)
        su, si = (np.bincount(cell_of, weights=w[pos] * np.repeat(x, n), minlength=cell.size)[first]
                  for w, x in ((self.a, p), (self.b, q)))
        return cell[first], su, si

    def _offer(self, items, cells, x, y) -> None:
        row, user = np.divmod(cells, self.n)
        item = items[row]
        for name, s in (("user", x), ("item", y), ("blend", self.uw * x + self.iw * y)):
            self.best[name].offer(user, item, s)

    def lists(self) -> Iterator[pd.DataFrame]:
        for name, best in self.best.items():
            user, item, score, rank = best.lists()
            for lo in range(0, user.size, STEP):
                at = slice(lo, lo + STEP)
                yield pd.DataFrame({"list": name, "user_id": self.own.ids[user[at]], "product_id": item[at], "score": score[at], "rank": rank[at]})


def _kernel(*cuts):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, group, rest = [], None, []
        for kind, rows in st.runs(batches):
            if kind == st.OWN:
                parts.append(rows)
                continue
            if group is None:
                if not parts:
                    continue  # no user fell into this group
                group, parts = _Group(st.Own(parts), cuts), []
            if kind == st.NEAR:
                group.neighbours(rows)
                continue
            if group.near is not None:
                group.close()
                group.near = None
            # the last product may go on in the next batch
            if rest:
                rows = tuple(np.concatenate(x) for x in zip(rest, rows))
            others = np.flatnonzero(rows[0] != rows[0][-1])
            full = int(others[-1]) + 1 if others.size else 0
            if full:
                group.add(tuple(x[:full] for x in rows))
            rest = tuple(x[full:] for x in rows)
        if rest:
            group.add(rest)
        if group is not None:
            yield from group.lists()
    return run


def neighbour_lists(train: DataFrame, k_user: int, k_item: int, k_blend: int = 0, user_weight: float = 0.5,
                    item_weight: float = 0.5, users: DataFrame | None = None, history_rows: int | None = None,
                    user_groups: int | None = None) -> DataFrame:
    """(list, user_id, product_id, score, rank) with the same content as ``cf.ranked_lists``; ``users``: these only.

    ``history_rows``: neighbours' weights that a group keeps (default ``NEIGHBOURS``); ``user_groups``: so many groups.
    """
    slots = train.sparkSession.sparkContext.defaultParallelism
    t = train.select("user_id", "product_id", "score").where("user_id IS NOT NULL")
    by_item = materialised(st.keyed_rows(t, "product_id", "user_id"), "product_rows")
    by_user = materialised(st.entity_rows(by_item), "user_rows")
    by_item = by_item.where("id IS NOT NULL")
    n = by_item.agg(F.sum(F.size("keys")).alias("n"), F.sum(F.size("keys").cast("double") * F.size("keys")).alias("met")).first()
    own, share = by_user, 1.0
    if users is not None:
        own = materialised(by_user.join(users.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi"), "asked_rows")
        share = (own.agg(F.sum(F.size("keys"))).first()[0] or 0) / max(n["n"] or 0, 1)
    groups = user_groups or max(slots, math.ceil((n["met"] or 0) * share / (history_rows or NEIGHBOURS)))
    kernel = _kernel(k_user, k_item, k_blend, user_weight, item_weight)
    # own and near: p = score / |user|; own: q = score / |product|; products: q = score / |product|
    return st.each_group(own, ("r", "w"), [(by_user, "r", "r"), (by_item, "r", "r")], groups, kernel, OUT_SCHEMA, NAMES,
                         unit=((st.OWN, "p"), (st.NEAR, "p"), (st.LAST, "q")))
