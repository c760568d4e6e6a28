"""Operator 5: toxicity by non-negative positive-unlabelled learning over words.

Confirmed toxic documents and unlabelled ones give a vocabulary of words and word beginnings that are far more or far
less frequent in the toxic ones; a linear numpy classifier over their presence is fitted with ``pu_learning.fit_nnpu``
and scores whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import stored, table
from cartlens.llm.pu_learning import (MAX_LABELLED, MAX_UNLABELLED, NOTHING_LEARNT, Rows, all_rows, drawn_rows, estimate_prior,
                                      fit_nnpu, held_out, sigmoid, usable)

#: The vocabulary: the most telling terms, how far apart their rates must be (in standard errors), and the least number
#: of positives that have a term.
VOCABULARY = 2_000
MIN_Z = 5.0
MIN_POSITIVES = 3
#: Terms that a task counts before it hands the counts on.
MOST_COUNTED = 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> set[str]:
    """Words in lower case, and the first four and five letters of longer ones with a hyphen."""
    words = set(LETTERS.findall((text or "").lower()))
    return words.union([w[:4] + "-" for w in words if len(w) > 4], [w[:5] + "-" for w in words if len(w) > 5])


def _counted_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number of positives and of all texts that have each term; the empty term is in every text."""
    p, u = Counter(), Counter()

    def counted() -> pd.DataFrame:
        return pd.DataFrame([(term, p[term], n) for term, n in u.items()], columns=["term", "p", "u"])

    for x in batches:
        for text, positive in zip(x["text"], x["positive"]):
            terms = terms_of(text)
            terms.add("")
            u.update(terms)
            if positive:
                p.update(terms)
            if len(u) > MOST_COUNTED:
                yield counted()
                p.clear()
                u.clear()
    yield counted()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED,
        max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> tuple[dict[str, float], float]:
    """Weight of each term of the vocabulary, and the intercept.

    Terms are counted in all documents outside the held-out fold; the weights are fitted on the bounded draws.  The class
    prior is ``prior``, or else estimated from positives and unlabelled rows.  Without any positive there are no weights
    and all scores are near 0; with positives but no telling term, all scores are the prior (0.5 if it is not given).
    """
    rows = drawn_rows(docs, labels, label, max_labelled, max_unlabelled)
    seen = all_rows(docs, labels, label).mapInPandas(_counted_terms, "term string, p bigint, u bigint")
    seen = seen.groupBy("term").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    seen = stored(seen.where((F.col("p") >= MIN_POSITIVES) | (F.col("term") == "")), "terms")
    n_pos, n_unl = seen.where("term = ''").select("p", "u").first() or (0, 0)
    if not usable(n_pos, n_unl):
        return {}, NOTHING_LEARNT
    rate_p, rate_u = F.col("p") / n_pos, F.col("u") / n_unl
    pooled = (F.col("p") + F.col("u") + 1) / (n_pos + n_unl + 2)
    telling = F.abs(rate_p - rate_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_pos + 1 / n_unl))
    top = (seen.where((F.col("term") != "") & (F.col("p") >= MIN_POSITIVES)).withColumn("z", telling).where(F.col("z") >= MIN_Z)
           .orderBy(F.desc("z"), "term").limit(VOCABULARY))
    index = {r[0]: i for i, r in enumerate(top.select("term").collect())}
    if not index:
        return {}, float(np.log(prior / (1 - prior))) if prior else 0.0

    def to_columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"positive": x["positive"], "unlabelled": x["unlabelled"],
                                "cols": [sorted(index[w] for w in terms_of(t) if w in index) for t in x["text"]]})

    got = rows.mapInPandas(to_columns, "positive boolean, unlabelled boolean, cols array<int>").toPandas()
    pos = Rows.of(list(got.loc[got["positive"], "cols"]), len(index))
    unl = Rows.of(list(got.loc[got["unlabelled"], "cols"]), len(index))
    if not usable(pos.n, unl.n):
        return {}, NOTHING_LEARNT
    if prior is None:
        halves = np.arange(len(got)) % 2
        prior = estimate_prior(pos, unl, halves[got["positive"].to_numpy(bool)], halves[got["unlabelled"].to_numpy(bool)])
    w, b = fit_nnpu(pos, unl, prior)
    return {term: float(w[i]) for term, i in index.items()}, b


def score(docs: DataFrame, model: tuple[dict[str, float], float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts get the intercept's score.  Only texts leave the JVM."""
    weights, intercept = model

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = weights.keys()
        for x in batches:
            z = [intercept + sum(map(weights.__getitem__, sorted(terms_of(t) & known))) for t in x]
            yield pd.Series(sigmoid(np.array(z)))

    return docs.select(F.col(doc_id).alias("doc_id"), scored.asNondeterministic()(F.col(text)).alias("score"))


def op5_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))
