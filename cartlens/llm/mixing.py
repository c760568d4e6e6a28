"""Operator 3: mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], piecewise linear between knots.  Its integral up to t,
scaled so that it ends at the source's target, is the source's cumulative demand D(t) in words.  The mix takes a
source's documents one after the other, in passes over the source; the word at place q of that stream is due at the
time t with D(t) = q, so inverting D gives each taken document its training position, and a range sort by position puts
the whole mix in training order.  Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.llm.common import free_name, n_words, running, stored, table

#: (time, weight) knots; every time from 0 to 1, weights at least 0 and not all 0.
EARLY = ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5))
STEADY = ((0.0, 1.0), (1.0, 1.0))
LATE = ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0))
#: Schedules dealt out to the sources in order.
SCHEDULES = (EARLY, STEADY, LATE)
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(t0, t1, rate at t0, rate at t1, demand at t0) of each linear piece, with total demand 1."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if not t0 < t1 or min(w0, w1) < 0:
            raise ValueError("knots need rising times and weights of at least 0")
        pieces.append((t0, t1, w0, w1, total))
        total += (w0 + w1) / 2 * (t1 - t0)
    if not pieces or pieces[0][0] != 0.0 or pieces[-1][1] != 1.0 or total <= 0:
        raise ValueError("a schedule runs from time 0 to 1 with a positive integral")
    return [(t0, t1, w0 / total, w1 / total, d / total) for t0, t1, w0, w1, d in pieces]


def inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the cumulative demand reaches ``share`` (0 to 1) of its total.

    In a piece, demand is d + w0 u + s u^2 / 2 with u the time in it and s its slope; the root is taken in the form
    2 r / (w0 + sqrt(w0^2 + 2 s r)), which stays exact when s is 0.
    """
    found = []
    for t0, t1, w0, w1, d in reversed(segments(knots)):
        slope = (w1 - w0) / (t1 - t0)
        rest = share - F.lit(d)
        bottom = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * slope) * rest, F.lit(0.0)))
        inside = F.when(bottom > 0, F.lit(t0) + F.lit(2.0) * rest / bottom).otherwise(F.lit(t0))
        found.append(F.when(share >= F.lit(d), F.least(inside, F.lit(t1))))
    return F.coalesce(*found)


def _numbered(sources: DataFrame, name: str) -> DataFrame:
    """``sources`` with ``place`` from 0 by code point of ``name``, null last."""
    order = [F.col(name).isNull(), F.col(name)]
    return sources.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[int] = WEIGHTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: place (by code point, null last), weight, source_size, target.

    The targets share out the sum of all sizes by weight; a target stops at ``max_repeats`` times its source's size
    and the excess is shared again by weight among the others until none is above.  Two sums come to the driver for
    each round; shares are exact fractions up to the last division.
    """
    got = sizes.groupBy(F.col(source).alias("source_name")).agg(F.sum(size).cast("long").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    got = stored(_numbered(got, "source_name").withColumn("weight", weight.cast("long")), "sources")
    total = got.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * max_repeats
    over, level, done = F.lit(False), None, -1
    while True:
        n, held, free = got.agg(F.count_if(over), F.sum(F.when(over, cap).otherwise(0)),
                                F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if n == done or not free:
            break
        done, level = n, Fraction(total - held, free)
        # cap <= weight * level, in whole numbers of up to 38 digits
        over = (cap.cast("decimal(20,0)") * F.lit(level.denominator).cast("decimal(18,0)")
                <= F.col("weight").cast("decimal(5,0)") * F.lit(level.numerator).cast("decimal(33,0)"))
    if level is None:
        return got.withColumn("target", F.lit(0.0))
    share = F.col("weight").cast("double") * F.lit(float(level.numerator)) / F.lit(float(level.denominator))
    return got.withColumn("target", F.when(over, cap.cast("double")).otherwise(share))


def _due(knots: Sequence[tuple[float, float]]):
    def at(k: Column) -> Column:
        share = (F.col("start") + k * F.col("source_size")).cast("double") / F.col("whole").cast("double")
        return inverse_demand(F.least(share, F.lit(1.0)), knots)
    return at


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[int] = WEIGHTS, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS, row: str | None = None) -> DataFrame:
    """Plan of the mix: a row per document with size, source_size, target, taken, passes and position.

    ``taken`` words of a document are in the mix: a source's passes take whole documents, in an order by a hash of the
    id, and the last pass stops at the target rounded to a word, so at most one document per source is taken in part.
    ``position`` is the training time (0 to 1) at which the document is first due, null when it is never taken; one
    with ``passes`` above 1 comes again, one source length later in its source's stream (``positions`` lists them).
    Rows come range-sorted by position, ties by id.  Null text has size 0 and is taken 0 words; a null source is a
    source; ids are taken as unique, unless
    ``row`` names a column that identifies a row whatever its id; it is then the last column of the plan.  An empty table
    gives an empty plan.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source_name"), n_words(F.col(text)).alias("size"),
                      *([F.col(row).alias("row_key")] if row else []))
    if row:  # rows without an id are dealt to buckets by their own key, all others by their id as ever
        src = src.withColumn("no_id", F.when(F.col("doc_id").isNull(), F.col("row_key")))
    src = stored(src, "sizes")
    targets = source_targets(src, "source_name", "size", weights, max_repeats)
    order, ties = (["doc_id", "no_id"], ["row_key"]) if row else (["doc_id"], [])
    placed = running(src, ["source_name"], order, F.col("size"), "start", ties=ties)
    to = targets.select(F.col("source_name").alias("name_key"), "place", "source_size", "target")
    j = placed.join(to, F.col("source_name").eqNullSafe(F.col("name_key"))).drop("name_key")
    whole = F.least(F.round("target").cast("long"), F.col("source_size") * max_repeats)
    j = j.withColumn("whole", whole).withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("whole") / F.col("source_size"))).otherwise(0))
    part = F.col("whole") - F.col("full") * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), part - F.col("start")))
    j = j.withColumn("taken", F.when(F.col("size") > 0, F.col("full") * F.col("size") + last).otherwise(0).cast("long"))
    j = j.withColumn("passes", F.when(F.col("size") > 0, F.col("full") + (last > 0).cast("int")).otherwise(0).cast("int"))
    spot = F.lit(None).cast("array<double>")
    for i, knots in enumerate(schedules):
        spot = F.when(F.col("place") % len(schedules) == i,
                      F.transform(F.sequence(F.lit(0), F.col("passes") - 1), _due(knots))).otherwise(spot)
    j = j.withColumn("positions", F.when(F.col("passes") > 0, spot).otherwise(F.array().cast("array<double>")))
    j = j.withColumn("position", F.get("positions", F.lit(0)))
    return (j.select("doc_id", "source_name", "size", "source_size", "target", "taken", "passes", "position", "positions",
                     *([F.col("row_key").alias(row)] if row else []))
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 over the sources, in training order."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "passes", "position")


def _inverse_sql(share: str, knots) -> str:
    cases = []
    for t0, t1, w0, w1, d in reversed(segments(knots)):
        slope = (w1 - w0) / (t1 - t0)
        rest = f"({share} - {d!r}::DOUBLE)"
        bottom = f"({w0!r}::DOUBLE + sqrt(greatest({w0 * w0!r}::DOUBLE + {2.0 * slope!r}::DOUBLE * {rest}, 0.0::DOUBLE)))"
        cases.append(f"WHEN {share} >= {d!r}::DOUBLE THEN least(CASE WHEN {bottom} > 0 THEN {t0!r}::DOUBLE + 2.0::DOUBLE * {rest} / {bottom} "
                     f"ELSE {t0!r}::DOUBLE END, {t1!r}::DOUBLE)")
    return "CASE " + " ".join(cases) + " END"


#: Sources in order of the level at which each is capped; one is capped when that level is at most what is left for it.
OP3_SQL = f"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                      CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)
                        % greatest(8, (SELECT (count(*) + 99999) // 100000 FROM documents)) AS bucket FROM documents),
sources AS (SELECT source, CAST(sum(size) AS HUGEINT) AS total,
                   row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM sizes GROUP BY source),
weighed AS (SELECT *, [1, 2, 3][place % 3 + 1] AS weight, 3 * total AS cap FROM sources),
lined AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS weight_before,
                 (SELECT sum(total) FROM sources) AS everything, (SELECT sum(weight) FROM weighed) AS weights
          FROM weighed WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
told AS (SELECT *, cap * (weights - weight_before) <= weight * (everything - cap_before) AS capped FROM lined),
level AS (SELECT everything - coalesce(sum(cap) FILTER (capped), 0) AS rest, sum(weight) FILTER (NOT capped) AS free FROM told GROUP BY everything),
targets AS (SELECT source, place, CAST(total AS BIGINT) AS source_size,
                   CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * CAST(rest AS DOUBLE) / CAST(free AS DOUBLE) END AS target FROM told, level),
placed AS (SELECT s.doc_id, s.size, t.place, t.source_size, t.target, least(CAST(round(t.target) AS BIGINT), 3 * t.source_size) AS whole,
                  CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.bucket, s.doc_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
           FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passed AS (SELECT *, whole // greatest(source_size, 1) AS full_passes,
                  greatest(0, least(size, whole - whole // greatest(source_size, 1) * source_size - start)) AS last FROM placed),
due AS (SELECT *, CASE WHEN size > 0 THEN full_passes * size + last ELSE 0 END AS taken,
               CASE WHEN size > 0 THEN full_passes + CAST(last > 0 AS INTEGER) ELSE 0 END AS passes,
               least(CAST(start AS DOUBLE) / CAST(whole AS DOUBLE), 1.0::DOUBLE) AS share FROM passed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, CAST(passes AS INTEGER) AS passes,
       CASE WHEN passes > 0 THEN CASE place % {len(SCHEDULES)} {" ".join(f"WHEN {i} THEN {_inverse_sql('share', k)}" for i, k in enumerate(SCHEDULES))} END END AS position
FROM due
"""
