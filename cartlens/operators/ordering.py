"""Global row positions without a single-partition window.

``row_number() over (order by ...)`` with no partition key pulls every row
into one task.  ``global_row_index`` does what ``RDD.zipWithIndex`` does, on
DataFrames: range-partition by the order key, sort within partitions, count
rows per partition (a table with one row per partition), turn the counts into
offsets, and add each row's position inside its partition.  One shuffle of
the data; the only extra state is the per-partition offset table, whose size
is the partition count, so broadcasting it is safe.

``first_k_flag`` uses a coarse histogram first (rows per time bucket,
one row per bucket) so that only the bucket that holds the split point is
ranked at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartlens.session import materialised

_POS_BITS = 33  # monotonically_increasing_id puts the partition index above bit 33
ROWS_PER_PARTITION = 1_000_000
BUCKET_FORMATS = {"hour": "yyyy-MM-dd HH", "minute": "yyyy-MM-dd HH:mm",
                  "second": "yyyy-MM-dd HH:mm:ss"}


def _as_cols(cols):
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_row_index(df: DataFrame, order_cols, index_col: str = "row_index", start: int = 0,
                     num_partitions: int | None = None) -> DataFrame:
    """Add a contiguous 0-based (or ``start``-based) position in ``order_cols`` order.

    ``order_cols`` must be a unique key of ``df``, otherwise equal keys get an
    arbitrary but fixed relative order.

    The range-partitioned, sorted rows are written once: the partition
    counts and the row positions must come from the same partitioning (range
    bounds are sampled), and a written copy also survives executor loss.
    """
    if num_partitions is None:
        num_partitions = max(1, math.ceil(df.count() / ROWS_PER_PARTITION))
    n = num_partitions
    ranged = df.repartitionByRange(n, *_as_cols(order_cols)).sortWithinPartitions(*_as_cols(order_cols))
    tagged = materialised(ranged.withColumn("_mid", F.monotonically_increasing_id()), "ranged")
    tagged = tagged.withColumn("_part", F.shiftright("_mid", _POS_BITS)) \
        .withColumn("_pos", F.col("_mid") - F.shiftleft(F.col("_part"), _POS_BITS))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a global running sum over it is cheap
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    offsets = offsets.select("_part", F.coalesce("_off", F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_part", "inner")
    return out.withColumn(index_col, (F.col("_off") + F.col("_pos") + F.lit(start)).cast("bigint")) \
        .drop("_mid", "_part", "_pos", "_off")


def first_k_flag(df: DataFrame, time_col: str, tie_cols, k: int, flag_col: str = "in_head",
                 bucket_units=("day", "hour", "minute", "second"), rank_rows: int = 2_000_000) -> DataFrame:
    """Flag the first ``k`` rows in (time_col, *tie_cols) order; null times sort last.

    Rows are bucketed by truncated time; a per-bucket count table (one row per
    bucket) locates the bucket holding position ``k``.  Earlier buckets are
    flagged, later ones not, and the search narrows to finer units inside the
    boundary bucket.  Only the rows of the final boundary bucket are ranked,
    and that ranking uses ``global_row_index`` (range partitioned), so even a
    bucket holding a large share of the data never lands in one task.
    """
    t = F.col(time_col)
    timed = df.filter(t.isNotNull())
    untimed = df.filter(t.isNull())
    if k <= 0:
        return df.withColumn(flag_col, F.lit(False))
    head_cond: Column = F.lit(False)
    inside: Column = F.lit(True)
    remaining = k
    row = None
    for unit in bucket_units:
        # buckets are dates, which are cheap to compare in each row, and inside a day fixed-width wall-clock
        # text (sorts like time); both go to the driver and back as text, without time-zone conversion
        bucket = t.cast("date") if unit == "day" else F.date_format(t, BUCKET_FORMATS[unit])
        hist = timed.filter(inside).groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        cum = hist.select("_b", "_n", F.sum("_n").over(w).alias("_cum"))
        row = cum.filter(F.col("_cum") >= remaining).orderBy("_b").select(F.col("_b").cast("string").alias("_b"), "_n", "_cum").first()
        if row is None:
            # every timed row is in the head; the rest of the head comes from the null-time rows
            n_timed = hist.agg(F.sum("_n")).first()[0] or 0
            if unit != bucket_units[0]:
                raise AssertionError("boundary bucket lost")  # cannot happen: the bucket holds >= remaining rows
            need = k - n_timed
            if need <= 0:
                return timed.withColumn(flag_col, F.lit(True)).unionByName(untimed.withColumn(flag_col, F.lit(False)))
            ranked = global_row_index(untimed, list(tie_cols), "_r", start=1)
            return timed.withColumn(flag_col, F.lit(True)).unionByName(
                ranked.withColumn(flag_col, F.col("_r") <= need).drop("_r"))
        before = row["_cum"] - row["_n"]
        found = F.lit(row["_b"]).cast("date") if unit == "day" else F.lit(row["_b"])
        head_cond = head_cond | (inside & (bucket < found))
        inside = inside & (bucket == found)
        remaining = remaining - before
        if remaining == row["_n"]:
            # the boundary bucket ends exactly at position k
            return timed.withColumn(flag_col, head_cond | inside).unionByName(
                untimed.withColumn(flag_col, F.lit(False)))
        if row["_n"] <= rank_rows:
            break  # small enough to rank directly
    # rank the rows of the final boundary bucket by the full order key; the
    # rest of the data is flagged by the bucket predicates alone (no join)
    order = [time_col, *tie_cols]
    boundary = timed.filter(inside)
    parts = max(1, math.ceil(row["_n"] / rank_rows))
    ranked = global_row_index(boundary, order, "_r", start=1, num_partitions=parts)
    # written, so that readers of the flag do not rank again
    boundary_flagged = materialised(ranked.withColumn(flag_col, F.col("_r") <= remaining).drop("_r"), "boundary")
    rest = timed.filter(~inside).withColumn(flag_col, head_cond)
    return rest.unionByName(boundary_flagged).unionByName(untimed.withColumn(flag_col, F.lit(False)))
