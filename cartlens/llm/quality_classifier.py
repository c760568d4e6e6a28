"""Operator 6: quality classifier by positive-unlabelled learning.

Trusted good documents and unlabelled web text, described by shape features (repetition, symbols, case, lengths), each
cut at quantiles of the unlabelled rows.  The classifier over these steps has least non-negative unbiased risk for the
estimated share of good documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import WORD, stored, table
from cartlens.llm.pu_learning import (MAX_LABELLED, MAX_UNLABELLED, NOTHING_LEARNT, Rows, drawn_rows, estimate_prior, fit_nnpu,
                                      held_out, sigmoid, usable)

KEEP_FROM = 0.3
QUANTILES = (0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.25, 0.5, 0.75, 0.85, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995)
FEATURES = ("words", "word_length", "symbols", "upper", "marks", "digits", "distinct", "same_as_last", "commonest",
            "repeated_triples", "repeated_lines", "words_without_letters", "words_with_symbols", "line_length",
            "vowel_free")
_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>~^=+\\{}\[\]@]")
_DIGIT = re.compile(r"\d")


def shape(text: str | None) -> list[float]:
    """The features, all 0 for a text without words."""
    text = text or ""
    words = _WORD.findall(text)
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    triples = list(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    odd = {w for w in counts if _SYMBOL.search(w)}
    bare = {w for w in counts if not any(map(str.isalpha, w))}
    plain = text.encode("ascii", "ignore")
    upper = sum(map(str.isupper, text)) if len(plain) < len(text) else len(plain) - len(plain.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    mute = {w for w in counts if len(w) > 3 and w.isascii() and not set(w.lower()) & set("aeiouy")}
    return [
        np.log1p(n), sum(map(len, words)) / n, len(_SYMBOL.findall(text)) / chars, upper / chars,
        (text.count("!") + text.count("?")) / n, len(_DIGIT.findall(text)) / chars, len(counts) / n ** 0.9,
        sum(a == b for a, b in zip(words, words[1:])) / n, max(counts.values()) / n,
        1 - len(set(triples)) / len(triples) if triples else 0.0, 1 - len(set(lines)) / len(lines),
        sum(counts[w] for w in bare) / n, sum(counts[w] for w in odd) / n, np.log1p(len(text) / len(lines)),
        sum(counts[w] for w in mute) / n,
    ]


def _shapes(texts: pd.Series) -> np.ndarray:
    return np.array([shape(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def _rounded_up(x: np.ndarray) -> np.ndarray:
    """The next number with ten binary digits, so that any number of texts has a bounded number of values."""
    digits, power = np.frexp(x)
    return np.ldexp(np.ceil(digits * 1024) / 1024, power)


def described(docs: DataFrame, text: str = "text", name: str = "shape") -> DataFrame:
    """``docs`` with the features of its text, an array of doubles, in a column ``name`` at the end; null texts count as empty."""
    @F.pandas_udf("array<double>")
    def of_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(_shapes(x)), dtype=object)

    return docs.withColumn(name, of_text.asNondeterministic()(F.col(text)))


def _features(column: pd.Series) -> np.ndarray:
    """The features of a batch of rows, one row each."""
    return np.array(list(column), np.float64).reshape(-1, len(FEATURES))


def quantile_edges(shapes: DataFrame) -> list[np.ndarray]:
    """The quantiles of each feature over all documents outside the held-out fold, rounded up to ten binary digits."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [Counter() for _ in FEATURES]
        for x in batches:
            for own, values in zip(seen, _rounded_up(_features(x["shape"])).T):
                for value, n in zip(*np.unique(values, return_counts=True)):
                    own[float(value)] += int(n)
        yield pd.DataFrame([(k, v, n) for k, own in enumerate(seen) for v, n in own.items()], columns=["feature", "value", "n"])

    rows = shapes.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("shape")
    got = (rows.mapInPandas(counted, "feature int, value double, n bigint").groupBy("feature", "value").agg(F.sum("n").alias("n"))
           .toPandas().sort_values(["feature", "value"]))
    edges = []
    for _, own in got.groupby("feature"):
        upto = own["n"].cumsum().to_numpy()
        at = np.searchsorted(upto, np.array(QUANTILES) * upto[-1], side="left")
        edges.append(np.unique(own["value"].to_numpy()[at]))
    return edges


class Model:
    """Steps of the features and their summed weights: a score is the intercept plus one weight per feature."""

    def __init__(self, edges: list[np.ndarray], weights: list[np.ndarray], intercept: float):
        self.edges, self.weights, self.intercept = edges, weights, intercept

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, (e, w) in enumerate(zip(self.edges, self.weights)):
            z += np.append(0.0, np.cumsum(w))[np.searchsorted(e, x[:, k], side="left")]
        return sigmoid(z)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED,
        max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> Model:
    """``fit_shapes`` on the features of ``docs`` (doc_id, text), which are written once and then read as numbers."""
    shapes = stored(described(docs.select("doc_id", "text")).select("doc_id", "shape"), "shapes")
    return fit_shapes(shapes, labels, label, max_labelled, max_unlabelled, prior)


def fit_shapes(shapes: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED,
               max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> Model:
    """The classifier from (doc_id, shape) rows; without any trusted row a constant near 0.

    Quantiles are those of all documents outside the held-out fold; the weights are fitted on the bounded draws.  The
    class prior is ``prior``, or else estimated from trusted and unlabelled rows.  ``shapes`` is read several times and
    should be a stored table.
    """
    rows = drawn_rows(shapes, labels, label, max_labelled, max_unlabelled, "shape")
    got = rows.select("positive", "unlabelled", "shape").toPandas()  # at most both bounds together
    pos, unl = got["positive"].to_numpy(bool), got["unlabelled"].to_numpy(bool)
    if not usable(pos.sum(), unl.sum()):
        return Model([], [], NOTHING_LEARNT)
    x = _features(got["shape"])
    edges = quantile_edges(shapes)
    first = np.cumsum([0] + [len(e) for e in edges])
    steps = np.concatenate([x[:, [k]] > e for k, e in enumerate(edges)], axis=1)
    lists = [np.flatnonzero(s) for s in steps]
    trusted, web = (Rows.of([s for s, own in zip(lists, side) if own], first[-1]) for side in (pos, unl))
    if prior is None:
        halves = np.arange(len(lists)) % 2
        prior = estimate_prior(trusted, web, halves[pos], halves[unl])
    w, b = fit_nnpu(trusted, web, prior)
    return Model(edges, [w[a:z] for a, z in zip(first, first[1:])], b)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with its score (0 to 1) in a column ``name`` at the end; null texts count as empty.

    Only texts leave the JVM, and only scores come back.
    """
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.score(_shapes(x)))

    return docs.withColumn(name, scored.asNondeterministic()(F.col(text)))


def score_shapes(shapes: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``shapes``, rows with a ``shape``, with the score (0 to 1) in a column ``name`` at the end."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.score(_features(x)))

    return shapes.withColumn(name, scored.asNondeterministic()(F.col("shape")))


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned outside the held-out fold.  Each text is described once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shapes = stored(described(docs).select("doc_id", "shape"), "shapes")
    scored = score_shapes(shapes, fit_shapes(shapes, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
