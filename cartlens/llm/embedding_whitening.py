"""Operator 13: whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance V of all vectors are found without V: every pass over the stored blocks
gives V Q for a thin block Q, as the sum of Xc' (Xc Q) over the tasks, Xc being the centred rows.  A sweep is a Chebyshev
polynomial in V, built by its three-term recurrence (one pass a degree) and small on the interval that holds the
unwanted eigenvalues; QR and Rayleigh-Ritz follow.  Sweeps end when the residual of each wanted pair, measured by a
pass of its own, certifies it.  The first sweep carries one more column, a Lanczos run, whose smallest Ritz value less
its error bound is the lower end of the interval from then on.

Rows: a vector that is null, or holds a null or non-finite entry, is left out; so is one whose length is not the commonest
(of equally common ones the greatest).  Repeated rows and ids count and come out as often as they stand.  An
empty table, or one whose vectors are all equal, gives no rows: there is no component of positive variance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import free_name, stored, table

COMPONENTS = 8
#: Columns of the block beside the wanted ones; they widen the gap that the filter works across.
GUARDS = 24
DEGREE = 12
MAX_SWEEPS = 60
#: A pair is certified by a residual below this share of the greatest eigenvalue, or, from ROUNDING down, when sweeps no
#: longer lower it.
RESIDUAL = 2e-14
ROUNDING = 1e-10
#: Eigenvalues below this share of the trace count as none.
NO_VARIANCE = 1e-12
BLOCK_ROWS = 2_048
SCALE, OFFSET = 1024, 100_000
#: 1024 times a component must be exact in a double.
MAX_COMPONENT = 2.0 ** 43


def usable(vector: Column) -> Column:
    """Whether a vector is given and all its entries are finite numbers."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def commonest_length(df: DataFrame, vector: str) -> int:
    """The length that most usable vectors have; 0 without any."""
    counts = df.where(usable(F.col(vector))).groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("length", F.struct("n", "length"))).first()[0] or 0


def in_fit(df: DataFrame, vector: str, length: int) -> DataFrame:
    return df.where(usable(F.col(vector)) & (F.size(vector) == length))


def quantised(rows: np.ndarray) -> np.ndarray:
    if rows.size and np.abs(rows).max() >= MAX_COMPONENT:
        raise ValueError("components must be smaller than 2^43")
    return np.floor(SCALE * rows).astype(np.int64) + OFFSET


@dataclass
class Blocks:
    """All vectors as stored blocks of longs, with their number and exact sums."""

    table: DataFrame
    n: int
    sums: list[int]

    @staticmethod
    def of(vectors: DataFrame, vector: str, length: int) -> "Blocks":
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(0)
                rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)
                for at in range(0, len(rows), BLOCK_ROWS):
                    x = quantised(rows[at:at + BLOCK_ROWS])
                    yield pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int64()), "x": pa.array([x.tobytes()], pa.binary()),
                                                      "sums": pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))})

        blocks = stored(vectors.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(
            packed, "n bigint, x binary, sums array<bigint>"), "vectors")
        total = blocks.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        got = {r["i"]: (r["n"], r["s"]) for r in total.collect()}
        return Blocks(blocks.select("x"), got[0][0] if got else 0, [got[i][1] for i in range(len(got))])

    def centred(self) -> Callable[[bytes], np.ndarray]:
        """Rows less the mean: the whole part is taken off in longs, so no digit of the rest is lost."""
        n, d = self.n, len(self.sums)
        whole = np.array([s // n for s in self.sums], np.int64)
        rest = np.array([(s % n) / n for s in self.sums])
        return lambda x: (np.frombuffer(x, np.int64).reshape(-1, d) - whole).astype(np.float64) - rest

    def summed(self, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Sum over all blocks of ``part`` of their centred rows: an array of ``size`` doubles."""
        centred = self.centred()

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for batch in batches:
                for x in batch["x"]:
                    total += part(centred(x)).ravel()
            yield pd.DataFrame({"at": np.arange(size), "v": total})

        got = self.table.mapInPandas(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(size)
        out[got["at"].to_numpy()] = got["v"].to_numpy()
        return out

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        """V Q by one pass."""
        return self.summed(lambda x: x.T @ (x @ q), q.size).reshape(q.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda x: np.array([(x * x).sum()]), 1)[0]) / self.n


def _chebyshev(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, first: np.ndarray, low: float, high: float,
               top: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of ``degree`` in V, applied to Q; ``first`` is V Q.

    It lies within 1 on [low, high] and would be 1 at ``top``, so nothing overflows.
    """
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = start = half / (top - centre)
    before, now = q, (first - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / start - sigma)
        before, now = now, (times(now) - centre * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


class _Lanczos:
    """A Lanczos run that rides along as one more column of the first sweep's passes."""

    def __init__(self, start: np.ndarray):
        self.basis, self.a, self.b = [start / np.linalg.norm(start)], [], []

    def take(self, image: np.ndarray) -> None:
        q = np.stack(self.basis, axis=1)
        self.a.append(float(self.basis[-1] @ image))
        rest = image - q @ (q.T @ image)
        rest -= q @ (q.T @ rest)
        self.b.append(float(np.linalg.norm(rest)))
        self.basis.append(rest / self.b[-1] if self.b[-1] > 0 else np.zeros_like(rest))

    def low(self) -> float:
        """Smallest Ritz value less its residual, 0 at least."""
        t = np.diag(self.a) + np.diag(self.b[:-1], 1) + np.diag(self.b[:-1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, float(values[0] - abs(self.b[-1] * vectors[-1, 0])))


def leading_eigenpairs(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = COMPONENTS, guards: int = GUARDS,
                       degree: int = DEGREE, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues (falling) of a covariance and their unit vectors (columns).

    ``times`` is the product with the covariance.  The last guard is drawn anew in each sweep, so that a direction
    which the first block missed comes in.  Raises if the pairs are not certified after ``MAX_SWEEPS`` sweeps.
    """
    rng = np.random.default_rng(seed)
    k = min(d, wanted + guards)
    wanted = min(wanted, d)
    q = np.linalg.qr(rng.standard_normal((d, k)))[0]
    lanczos, low, last = _Lanczos(rng.standard_normal(d)), 0.0, np.inf
    for sweep in range(MAX_SWEEPS):
        image = times(q)
        values, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = values[0]
        if top <= 0:
            return np.zeros(0), np.zeros((d, 0))
        residual = np.linalg.norm(image[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / top
        # a block that spans the whole space is exact; otherwise at least one filtered sweep must stand behind it
        if residual <= RESIDUAL or (residual <= ROUNDING and (k == d or residual > last / 4)):
            return values[:wanted], q[:, :wanted]
        last = residual
        high = max(values[-1], top * 1e-14)
        if low >= high:
            low = 0.0
        if sweep == 0:
            column = lanczos.basis[-1]

            def both(block: np.ndarray) -> np.ndarray:
                got = times(np.column_stack([block, lanczos.basis[-1]]))
                lanczos.take(got[:, -1])
                return got[:, :-1]

            lanczos.take(times(column[:, None])[:, 0])
            q = _chebyshev(both, q, image, low, high, top, min(degree, d - 1) if d > 2 else 2)
            low = lanczos.low()
        else:
            q = _chebyshev(times, q, image, low, high, top, degree)
        if k < d:
            q[:, -1] = rng.standard_normal(d) * np.linalg.norm(q[:, -1])
        q = np.linalg.qr(q / np.maximum(np.linalg.norm(q, axis=0), 1e-300))[0]
    raise RuntimeError(f"eigenpairs not certified: residual {last:.1e} of the greatest eigenvalue")


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, length: int | None = None) -> Whitening:
    """Mean, leading components and their check over all usable vectors of ``df``."""
    length = commonest_length(df, vector) if length is None else length
    blocks = Blocks.of(in_fit(df, vector, length), vector, length) if length else None
    if not blocks or not blocks.n:
        return Whitening(0, [0] * length, np.zeros(0), np.zeros((length, 0)), 0.0, 0.0)
    trace = blocks.trace()
    values, vectors = (leading_eigenpairs(blocks.covariance_times, length, components) if trace > 0
                       else (np.zeros(0), np.zeros((length, 0))))
    some = values > NO_VARIANCE * trace
    values, vectors = values[some], vectors[:, some]
    m, error = len(values), 0.0
    if m:
        scaled = vectors / np.sqrt(values)

        def moments(x: np.ndarray) -> np.ndarray:
            w = x @ scaled
            return np.vstack([w.sum(axis=0), w.T @ w])

        got = blocks.summed(moments, m * (m + 1)).reshape(m + 1, m) / blocks.n
        error = float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(m)).max())
    return Whitening(blocks.n, blocks.sums, values, vectors, trace, error)


def whiten(df: DataFrame, model: Whitening, vector: str, name: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """``df``, rows of the fit's length, with its whitened components (array) and exact deviation from the mean.

    The deviation is null where it is beyond a long.
    """
    n, sums, d = model.n, model.sums, len(model.sums)
    whole = np.array([s // n for s in sums] if n else [], np.int64)
    rest = np.array([(s % n) / n for s in sums] if n else [])
    scaled = model.vectors / np.sqrt(model.values)
    total = np.array(sums, object)

    @F.pandas_udf("deviation bigint, whitened array<double>")
    def of(v: pd.Series) -> pd.DataFrame:
        x = quantised(np.concatenate(v.to_numpy()).astype(np.float64).reshape(-1, d)) if len(v) else np.zeros((0, d), np.int64)
        w = ((x - whole).astype(np.float64) - rest) @ scaled
        reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
        if reach < 2 ** 62 and len(x):
            z = n * x - np.array(sums, np.int64)
            if d * int(np.abs(z).max()) ** 2 < 2 ** 63:
                return pd.DataFrame({"deviation": pd.array((z * z).sum(axis=1), "Int64"), "whitened": list(w)})
        exact = [int(((n * row.astype(object) - total) ** 2).sum()) for row in x]
        return pd.DataFrame({"deviation": pd.array([e if e < 2 ** 63 else None for e in exact], "Int64"), "whitened": list(w)})

    both = free_name(df, "whitened_row")
    return (df.withColumn(both, of(F.col(vector).cast("array<double>")))
            .withColumns({name: F.col(f"{both}.whitened"), deviation: F.col(f"{both}.deviation")}).drop(both))


def op13_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every embedding, with the exact deviation and the fit's check."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    length = commonest_length(rows, "embedding")
    model = fit(rows, "embedding", length=length)
    if not len(model.values):
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
                                         "explained double, identity_error double")
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    out = whiten(in_fit(rows, "embedding", length), model, "embedding")
    return (out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"),
                    F.lit(model.identity_error).alias("identity_error")))
