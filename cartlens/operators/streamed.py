"""Sparse rows of one entity, and groups of tasks that each keep a few of them and read all others past these.

In a pair table or a neighbourhood score every row may meet every other one.  Sending what meets copies an entry once
for each partner, sending whole tables once for each task.  Here nothing is sent: the sparse rows are written once, and
the task of a group reads the written table, as a cartesian product whose right side is one row a group
(``each_group``).  Spark streams the left side of that product, so a task holds what its kernel keeps, and the disk
holds the table, however many groups there are; reading is what grows with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWN, NEAR, LAST = 0, 1, 2  # what a row is to a group: its own, read first; read past these; read when the second kind is over
GRID = 1e10  # scores are compared on this grid, as by ``functions.numeric.tie_key``
BUFFERED = 1_000_000  # entries that wait for the cut to the top k
SPAN = 16_000_000  # ids of so short a range are looked up by their distance from the least


def _length(entries: str) -> Column:
    return F.sqrt(F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.coalesce(e["r"] * e["r"], F.lit(0.0))))


def keyed_rows(t: DataFrame, key: str, entity: str) -> DataFrame:
    """(id, norm, keys, r) of every ``key``: its entities and their scores, and the length of that vector."""
    rows = t.groupBy(F.col(key).alias("id")).agg(F.collect_list(F.struct(F.col(entity).alias("k"), F.col("score").alias("r"))).alias("_e"))
    return rows.select("id", _length("_e").alias("norm"), F.col("_e.k").alias("keys"), F.col("_e.r").alias("r"))


def entity_rows(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed_rows`` turned round, each entry also divided by its key's length: (id, norm, keys, r, w).

    An entry without a key counts for the length only; an id of null has no row.
    """
    flat = keyed.select(F.col("id").alias("_k"), "norm", F.inline(F.arrays_zip("keys", "r"))).where("keys IS NOT NULL")
    rows = flat.groupBy(F.col("keys").alias("id")).agg(
        F.collect_list(F.struct(F.col("_k").alias("k"), "r", (F.col("r") / F.col("norm")).alias("w"))).alias("_e"))
    rows = rows.select("id", _length("_e").alias("norm"), F.filter("_e", lambda e: e["k"].isNotNull()).alias("_e")).where("size(_e) > 0")
    return rows.select("id", "norm", F.col("_e.k").alias("keys"), F.col("_e.r").alias("r"), F.col("_e.w").alias("w"))


def known_rows(keyed: DataFrame) -> DataFrame:
    """``keyed_rows`` without null ids and null keys; the lengths stay those of the whole vectors."""
    rows = keyed.where("id IS NOT NULL").select("id", "norm", F.filter(F.arrays_zip("keys", "r"), lambda e: e["keys"].isNotNull()).alias("_e"))
    return rows.where("size(_e) > 0").select("id", "norm", F.col("_e.keys").alias("keys"), F.col("_e.r").alias("r"))


def _told(rows: DataFrame, kind: int, p: str, q: str, group: Column) -> DataFrame:
    norm = F.col("norm") if "norm" in rows.columns else F.lit(1.0)
    return rows.select(F.lit(kind).alias("kind"), group.cast("int").alias("_own"), "id", norm.alias("norm"), "keys", F.col(p).alias("p"), F.col(q).alias("q"))


def _flat(batch: pa.RecordBatch, unit: tuple) -> pd.DataFrame:
    """One row for every entry (kind, id, key, p, q); ``unit``: (kind, p or q) columns that are divided by the row's length."""
    keys = batch.column("keys")
    n = np.diff(keys.offsets.to_numpy())
    wide = lambda c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)
    got = {"kind": wide("kind"), "id": wide("id"), "key": keys.flatten().to_numpy(zero_copy_only=False)}
    norm = None
    for c in ("p", "q"):
        x = batch.column(c).flatten().to_numpy(zero_copy_only=False)
        kinds = [k for k, name in unit if name == c]
        if kinds:
            norm = wide("norm") if norm is None else norm
            x = np.where(np.isin(got["kind"], kinds), x / norm, x)
        got[c] = x
    return pd.DataFrame(got)


def each_group(own: DataFrame, own_values: tuple[str, str], others: list[tuple[DataFrame, str, str]], groups: int,
               kernel: Callable, schema: str, names: list[str], unit: tuple = (), with_own: tuple = ()) -> DataFrame:
    """``kernel`` once for each of ``groups`` groups of ``own``, over flat frames: the group's own entries, then those of ``others``.

    All tables are written ones with rows (id, norm, keys, ...), entries of a row follow each other.  ``with_own``: kinds
    of others whose ids are those of ``own``, and go to their groups only.
    """
    at = F.pmod(F.xxhash64("id"), F.lit(groups))
    rows = _told(own, OWN, *own_values, at)
    for kind, (df, p, q) in enumerate(others, NEAR):
        rows = rows.unionByName(_told(df, kind, p, q, at if kind in with_own else F.lit(None)))
    # one partition a group on the right; the left one is streamed for each, in the order of the union
    group = own.sparkSession.range(0, groups, 1, groups).select(F.col("id").alias("_group"))
    met = rows.coalesce(1).hint("shuffle_replicate_nl").join(group, F.expr("_own IS NULL OR _own = _group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in kernel(_flat(b, unit) for b in batches):
            yield pa.RecordBatch.from_pandas(pdf[names], preserve_index=False)
    return met.drop("_own", "_group").mapInArrow(run, schema)


def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(kind, (id, key, p, q)) of the frames, cut where the kind changes; the kinds must come in their order."""
    last = OWN
    for pdf in batches:
        kind = pdf["kind"].to_numpy()
        if kind.size == 0:
            continue
        cuts = np.flatnonzero(np.diff(kind)) + 1
        columns = [pdf[c].to_numpy() for c in ("id", "key", "p", "q")]
        for lo, hi in zip([0, *cuts], [*cuts, kind.size]):
            if kind[lo] < last:
                raise RuntimeError("the rows of a group came out of order")
            last = int(kind[lo])
            yield last, tuple(c[lo:hi] for c in columns)


class Places:
    """Positions of known ids: a table over their range where that is short, else one over hashes of them."""

    def __init__(self, ids: np.ndarray):
        self.low = int(ids.min()) if ids.size else 0
        span = int(ids.max()) - self.low + 1 if ids.size else 1
        self.table = None
        if span <= max(SPAN, 8 * ids.size):
            self.table = np.full(span + 1, -1, np.int32)  # the last place stands for all ids out of range
            self.table[ids - self.low] = np.arange(ids.size, dtype=np.int32)
            return
        self.shift = np.uint64(64 - max(1, int(2 * ids.size).bit_length()))
        h = self._hash(ids)
        order = np.argsort(h, kind="stable")
        self.ids, self.place = ids[order], order
        self.first = np.searchsorted(h[order], np.arange((1 << (64 - int(self.shift))) + 1))

    def _hash(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> self.shift).astype(np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The position of each id, -1 where it is not known."""
        if self.table is not None:
            last = self.table.size - 1
            return self.table[np.where((x >= self.low) & (x < self.low + last), x - self.low, last)].astype(np.int64)
        got = np.full(x.size, -1, np.int64)
        h = self._hash(x)
        lo, hi = self.first[h], self.first[h + 1]
        live = np.flatnonzero(lo < hi)
        lo, hi = lo[live], hi[live]
        while live.size:
            hit = self.ids[lo] == x[live]
            got[live[hit]] = self.place[lo[hit]]
            lo = lo + 1
            on = ~hit & (lo < hi)
            live, lo, hi = live[on], lo[on], hi[on]
        return got


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (n[i] of them) for every i."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Own:
    """A group's own entries by key; ``ids``: its entities."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        who, key, p, q = (np.concatenate(x) for x in zip(*parts))
        self.ids, at = np.unique(who, return_inverse=True)
        keys, slot = np.unique(key, return_inverse=True)
        order = np.lexsort((at, slot))
        self.at, self.p, self.q = at[order], p[order], q[order]
        self.keys, self.ends = Places(keys), np.cumsum(np.bincount(slot, minlength=keys.size))
        self.cells = slot[order] * self.ids.size + self.at  # rising

    def has(self, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which entities (by place) have an entry of these keys."""
        slot = self.keys.of(key)
        cell = slot * self.ids.size + at
        found = np.minimum(np.searchsorted(self.cells, cell), self.cells.size - 1)
        return (slot >= 0) & (self.cells[found] == cell)

    def meet(self, other: tuple[np.ndarray, ...], step: int, above: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """(other id, own place, sum of p * p, sum of q * q), one for each pair; no pairs of an id with itself.

        The entries of an id follow each other.  ``above``: only where the other id is the greater one.
        """
        oid, key, p, q = other
        slot = self.keys.of(key)
        here = np.flatnonzero(slot >= 0)
        if here.size == 0:
            return
        slot, oid, p, q = slot[here], oid[here], p[here], q[here]
        start = np.where(slot > 0, self.ends[slot - 1], 0)
        n = self.ends[slot] - start
        total = np.append(0, np.cumsum(n))
        first = np.flatnonzero(np.append(True, oid[1:] != oid[:-1]))
        bounds = np.append(first, oid.size)
        lo = 0
        while lo < first.size:
            hi = max(lo + 1, int(np.searchsorted(total[bounds], total[bounds[lo]] + step, "right")) - 1)
            at = slice(bounds[lo], bounds[hi])
            ids = oid[first[lo:hi]]
            if total[bounds[hi]] - total[bounds[lo]] > step:  # one id with more products than a step has
                sums = [np.zeros(self.ids.size), np.zeros(self.ids.size)]
                met = np.zeros(self.ids.size, bool)
                cut = at.start
                while cut < at.stop:
                    to = min(at.stop, max(cut + 1, int(np.searchsorted(total, total[cut] + step, "right")) - 1))
                    pos = spread(start[cut:to], n[cut:to])
                    met[self.at[pos]] = True
                    for of, x, y in zip(sums, (p, q), (self.p, self.q)):
                        of += np.bincount(self.at[pos], weights=np.repeat(x[cut:to], n[cut:to]) * y[pos], minlength=self.ids.size)
                    cut = to
                mine = np.flatnonzero(met & (self.ids < ids[0] if above else self.ids != ids[0]))
                if mine.size:
                    yield np.full(mine.size, ids[0]), mine, sums[0][mine], sums[1][mine]
            else:
                pos = spread(start[at], n[at])
                mine, them = self.at[pos], np.repeat(oid[at], n[at])
                ok = np.flatnonzero(self.ids[mine] < them if above else self.ids[mine] != them)
                run = np.repeat(np.arange(hi - lo), np.diff(bounds[lo:hi + 1]))
                cell = np.repeat(run * self.ids.size, n[at])[ok] + mine[ok]
                cells, pair = np.unique(cell, return_inverse=True)
                if cells.size:
                    a, b = ((np.repeat(x[at], n[at]) * y[pos])[ok] for x, y in ((p, self.p), (q, self.q)))
                    run, mine = np.divmod(cells, self.ids.size)
                    yield ids[run], mine, np.bincount(pair, weights=a), np.bincount(pair, weights=b)
            lo = hi


class Best:
    """The k best positive entries of each of ``n`` rows (score on the grid desc, id asc), from entries offered in any order.

    ``gone``: which (row, other) do not count.  An entry may have further values, the same number in each offer.
    """

    def __init__(self, n: int, k: int, gone: Callable | None = None):
        self.n, self.k, self.gone = n, k, gone
        self.least = np.full(n, np.nextafter(0, 1))
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.held, self.size = [], 0

    def offer(self, row: np.ndarray, other: np.ndarray, score: np.ndarray, *more: np.ndarray) -> None:
        if self.k <= 0:
            return
        able = np.flatnonzero(score >= self.least[row])
        if able.size:
            self.held.append(tuple(x[able] for x in (row, other, score, *more)))
            self.size += able.size
            if self.size > max(BUFFERED, 2 * self.kept[0].size):
                self.cut()

    def cut(self) -> None:
        """Only what can be among a row's k best stays, by single precision; ``lists`` has the exact order."""
        if not self.held:
            return
        new = tuple(np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        stay = new[2] >= self.least[new[0]]
        if self.gone is not None:
            stay &= ~self.gone(*new[:2])
        new = tuple(x[stay] for x in new)
        if self.kept[0].size:
            new = tuple(np.concatenate(x) for x in zip(self.kept, new))
        row, score = new[0], new[2]
        # positive single-precision numbers are ordered as their bits; greatest first within a row
        bits = score.astype(np.float32).view(np.int32).astype(np.int64)
        key = np.sort((row << 32) | (0xFFFFFFFF - bits))
        n = np.bincount(row, minlength=self.n)
        last = (np.cumsum(n) - n + self.k - 1)[n >= self.k]
        kth = (0xFFFFFFFF - (key[last] & 0xFFFFFFFF)).astype(np.int32).view(np.float32).astype(np.float64)
        self.least[n >= self.k] = np.maximum(kth * (1 - 2.0 ** -22) - 10 / GRID, np.nextafter(0, 1))
        stay = score >= self.least[row]
        self.kept = tuple(x[stay] for x in new)

    def lists(self) -> tuple[np.ndarray, ...]:
        """(row, other, score, further values, rank from 1), by row and rank."""
        self.cut()
        row, other, score, *more = self.kept
        order = np.lexsort((other, -np.rint(score * GRID), row))
        row = row[order]
        rank = np.arange(row.size) - np.searchsorted(row, row, "left")
        stay = rank < self.k
        order = order[stay]
        return row[stay], other[order], score[order], *(x[order] for x in more), (rank[stay] + 1).astype(np.int32)
