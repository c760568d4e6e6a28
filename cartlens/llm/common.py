"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cartlens.session import ensure_checkpoint_dir

#: White space is the six ASCII characters below; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors and lets later steps prune columns.  Everything an
    application writes lies under ``<spark.checkpoint.dir>/llm-<application id>`` and can be removed
    when the application has ended.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Hand tasks' rows to Python in batches of at most ``size`` bytes, for what is run inside the block.

    Two columns of whole shingle sets, say, are large; a few batches of them at a time would crowd an executor.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def map_rows(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str, *ids: str) -> DataFrame:
    """``mapInPandas`` that leaves whole numbers whole: the columns ``ids`` reach ``fn`` as text, null as None, and its results
    are turned back.

    pandas makes doubles of a column of whole numbers that holds a null, which rounds those above 2^53.
    """
    out = StructType.fromDDL(schema)
    as_text = StructType([StructField(f.name, StringType()) if f.name in ids else f for f in out])
    got = df.withColumns({c: F.col(c).cast("string") for c in ids}).mapInPandas(fn, as_text)
    return got.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in ids else F.col(f"`{f.name}`") for f in out])


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until no column of ``df`` has that name (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, name: str,
            rows_per_bucket: int = 100_000, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the rows that stand before a row among the rows of its keys.

    The order within a key is by (bucket, ``order``), where the bucket is the first 32 bits of the MD5 of the
    ``order`` columns (which must identify a row, or else ``ties`` must do so among rows equal in them) modulo the number of
    buckets.  No task sorts a whole key: each (key, bucket) is summed by itself and shifted by the totals of
    the buckets before it, so a key that holds a third of all rows is dealt to as many tasks as its buckets.  ``df``
    is read three times and should be a stored table.
    """
    buckets = max(8, -(-df.count() // rows_per_bucket))
    b, before, part = (free_name(df, x) for x in ("bucket", "before", "part"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(",", *order)), 1, 8), 16, 10).cast("long")
    dealt = df.withColumn(b, F.pmod(digest, F.lit(buckets)).cast("int")).withColumn(part, amount)
    by_bucket = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    ks = [f"{k}__key" for k in keys]
    totals = (
        dealt.groupBy(*keys, b).agg(F.sum(part).alias(part))
        .select(*[F.col(k).alias(x) for k, x in zip(keys, ks)], F.col(b).alias(f"{b}__key"),
                F.coalesce(F.sum(part).over(by_bucket), F.lit(0)).alias(before))
    )
    inside = Window.partitionBy(*keys, b).orderBy(*order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn(name, F.coalesce(F.sum(part).over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(x)) for k, x in zip([*keys, b], [*ks, f"{b}__key"])]
    joined = local.join(totals, on=_all(same), how="inner").withColumn(name, F.col(name) + F.col(before))
    return joined.drop(*ks, f"{b}__key", before, b, part)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def give_back_memory() -> None:
    """Return to the system what earlier tasks of this Python worker have freed; a worker outlives its tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def in_python_worker_single_threaded() -> None:
    """Keep native libraries to one thread: Spark already runs a task for each core."""
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
