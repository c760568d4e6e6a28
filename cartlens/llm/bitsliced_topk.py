"""Operator 9: exact top-k inner product by a bit-sliced index.

Vectors are whole numbers, held by block.  Each attribute of a block is cut into bit slices: one bitmap over the rows for
each binary digit of its leading digits.  For a query, the weighted sum over the attributes is formed for all rows at once by
bitmap arithmetic (full adders over the slices; negative weights take complements), and the rows with the largest sums
are selected from the most significant slice downward (O'Neil and Quass, 1997).  Digits left out bound the error of a sum;
rows that the bound leaves open are resolved with their exact products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.llm.common import stored, table

TOP = 5
ROWS_PER_BLOCK = 32_768
QUERIES_PER_BLOCK = 4_096
#: Leading binary digits of an attribute that have slices, and of a query's weights.
SLICES = 6
WEIGHT_DIGITS = 6


def _pack(bits: np.ndarray) -> np.ndarray:
    """Booleans over the rows as a bitmap of 64-bit words."""
    packed = np.packbits(bits, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


class BitSlicedIndex:
    """Slices of the leading digits of every attribute (column) of a block of whole-number rows."""

    def __init__(self, rows: np.ndarray, slices: int = SLICES):
        self.rows = rows
        n, width = rows.shape
        self.all = _pack(np.ones(n, bool))
        self.low = rows.min(axis=0) if n else np.zeros(width, np.int64)
        above = rows - self.low
        self.shift = max(0, int(above.max(initial=0)).bit_length() - slices)
        lead = above >> self.shift
        self.digits = int(lead.max(initial=0)).bit_length()
        self.slices = [[_pack((lead[:, d] >> s) & 1 == 1) for s in range(self.digits)] for d in range(width)]
        # what the leading digits say of a row, and by how much a row can differ from it
        middle = ((1 << self.shift) - 1) / 2
        coarse = self.low + (lead << self.shift) + middle
        self.middle = middle
        self.rest = float(np.sqrt(((rows - coarse) ** 2).sum(axis=1)).max(initial=0.0))
        self.norm = float(np.sqrt((coarse ** 2).sum(axis=1)).max(initial=0.0))

    def sums(self, weights: np.ndarray) -> tuple[list[np.ndarray], float, float]:
        """Slices of a whole number t per row, least significant first, with the scale and the error: the product of a row
        with ``weights`` is a constant plus scale * t, give or take the error."""
        drop = max(0, int(np.abs(weights).max(initial=0)).bit_length() - WEIGHT_DIGITS)
        kept = np.rint(weights / (1 << drop)).astype(np.int64)
        lost = weights - (kept << drop)
        piles: list[list[np.ndarray]] = []
        for d, w in enumerate(kept.tolist()):
            for p in range(abs(w).bit_length()):
                if abs(w) >> p & 1:
                    for s, bitmap in enumerate(self.slices[d]):
                        while len(piles) <= p + s:
                            piles.append([])
                        piles[p + s].append(bitmap if w > 0 else ~bitmap)
        out, p = [], 0
        while p < len(piles):
            pile = piles[p]
            if len(pile) > 1 and p + 1 == len(piles):
                piles.append([])
            while len(pile) > 2:  # three bits of a weight make one of it and a carry
                a, b, c = pile.pop(), pile.pop(), pile.pop()
                x = a ^ b
                pile.insert(0, x ^ c)
                piles[p + 1].append((a & b) | (x & c))
            if len(pile) == 2:
                a, b = pile
                piles[p + 1].append(a & b)
                out.append(a ^ b)
            else:
                out.append(pile[0] if pile else np.zeros_like(self.all))
            p += 1
        error = float(np.sqrt((weights.astype(float) ** 2).sum())) * self.rest + float(np.sqrt((lost.astype(float) ** 2).sum())) * self.norm
        return out, float(1 << (self.shift + drop)), error * (1 + 1e-9) + 1e-6

    def top(self, weights: np.ndarray, k: int, among: np.ndarray) -> np.ndarray:
        """Places of rows of the bitmap ``among`` that hold the ``k`` largest products, ties and open rows included."""
        if _count(among) <= k:
            return _places(among)
        slices, scale, error = self.sums(weights)
        sure, tied, value = np.zeros_like(among), among, 0
        for s in range(len(slices) - 1, -1, -1):
            ones = tied & slices[s]
            if _count(sure | ones) >= k:
                tied, value = ones, value + (1 << s)  # the k-th largest sum has this digit
            else:
                sure, tied = sure | ones, tied & ~slices[s]
        # the k-th largest sum is ``value``; rows with smaller sums can still win within the error
        return _places(among & self._at_least(slices, value - int(2 * error / scale) - 1))

    def _at_least(self, slices: list[np.ndarray], bound: int) -> np.ndarray:
        """Rows whose sum is at least ``bound``, from the most significant slice downward."""
        if bound <= 0:
            return self.all
        above, equal = np.zeros_like(self.all), self.all
        for s in range(len(slices) - 1, -1, -1):
            if bound >> s & 1:
                equal = equal & slices[s]
            else:
                above, equal = above | (equal & slices[s]), equal & ~slices[s]
        return above | equal


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def search(rows: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of largest inner product, ties to smaller ids.

    Both tables have vec_id and vector (array of whole numbers, products within 64 bits; shorter vectors count as filled up
    with 0).  A row with the query's own id doesn't compete; repeated ids are rows of their own.  With fewer rows than ``k``
    a query gets them all; each of several queries with one id gets its own; empty tables give an empty result.  All rows are indexed, block by block, and each block of
    queries meets each block of rows in a task of its own.
    """
    rows, queries = stored(rows.select("vec_id", "vector"), "rows"), stored(queries.select("vec_id", "vector", F.monotonically_increasing_id().alias("asked")), "queries")
    n_rows, n_queries = max(1, -(-rows.count() // ROWS_PER_BLOCK)), max(1, -(-queries.count() // QUERIES_PER_BLOCK))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))))

    def meet(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(block) and len(asked):
            width = max(block["vector"].map(len).max(), asked["vector"].map(len).max())
            ids = block["vec_id"].to_numpy(np.int64)
            index = BitSlicedIndex(_matrix(block["vector"], width))
            weights = _matrix(asked["vector"], width)
            for row, q, w in zip(asked["asked"].tolist(), asked["vec_id"].tolist(), weights):
                own = ids == q
                places = index.top(w, k, index.all & ~_pack(own) if own.any() else index.all)
                scores = index.rows[places] @ w
                best = np.lexsort((ids[places], -scores))[:k]
                found += zip([row] * len(best), [q] * len(best), ids[places][best].tolist(), scores[best].tolist())
        return pd.DataFrame(found, columns=["asked", "query_id", "vec_id", "score"]).astype("int64")

    both = ["row_block", "query_block"]
    near = (dealt(rows, "row_block", n_rows, "query_block", n_queries).groupBy(*both)
            .cogroup(dealt(queries, "query_block", n_queries, "row_block", n_rows).groupBy(*both))
            .applyInPandas(meet, "asked bigint, query_id bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def whole_numbers(vectors: DataFrame, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, vector) with floor(scale * x) of each component; vectors that are null or hold null, NaN or an infinity go."""
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select("vec_id", F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def op9_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every 50th vector, among all vectors."""
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))


OP9_SQL = """
WITH fine AS (SELECT row_number() OVER () AS asked, vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT q.asked, q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
           FROM fine q JOIN fine r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
