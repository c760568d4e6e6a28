"""Positive-unlabelled learning with the non-negative risk estimator, shared by the operators 5 and 6.

Learnt from rows labelled 1 and documents drawn without regard to labels; the class prior is estimated from these two.

Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator" (2017): with class prior p, the risk is
p R+(positives) + max(0, R-(unlabelled) - p R-(positives)).  Where the second term would be negative, the classifier
has begun to fit the unlabelled rows too well; the term is then 0 and so is its part of the gradient.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fold of a row: CRC-32 of its id as text, modulo this; fold 0 is held out.
FOLDS = 5
#: Most positive and most unlabelled rows that a classifier is fitted on, first ones by MD5 of the id.
MAX_LABELLED = 12_000
MAX_UNLABELLED = 12_000
#: Up to so many ids of positives are broadcast to where the texts are; with more, the texts are shuffled to them.
MOST_BROADCAST = 1_000_000


@dataclass
class Rows:
    """Sparse 0/1 matrix by row: features of row i are ``cols[rows == i]``."""

    n: int
    width: int
    rows: np.ndarray
    cols: np.ndarray

    @staticmethod
    def of(lists, width: int) -> "Rows":
        sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        cols = np.concatenate([np.asarray(x, np.int64) for x in lists]) if sizes.sum() else np.zeros(0, np.int64)
        return Rows(len(lists), width, np.repeat(np.arange(len(lists)), sizes), cols)

    def only(self, keep: np.ndarray) -> "Rows":
        place = np.cumsum(keep) - 1
        stay = keep[self.rows]
        return Rows(int(keep.sum()), self.width, place[self.rows[stay]], self.cols[stay])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], minlength=self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(z, np.float64)))


def _adam(gradient, width: int, b: float, steps: int, rate: float, l2: float) -> tuple[np.ndarray, float]:
    """Weights and intercept (first 0 and ``b``) after full-batch Adam steps; ``gradient`` gives that of both."""
    w, m1, m2 = np.zeros(width), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        gw, gb = gradient(w, b)
        g = np.append(gw + l2 * w, gb)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.999 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit_nnpu(pos: Rows, unl: Rows, prior: float, l2: float = 1e-5, steps: int = 600, rate: float = 0.05,
             reach: float = 5.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear classifier of least non-negative risk (Adam, full batch).

    The loss is logistic up to a margin of ``reach`` either way and flat beyond, so that an error in the prior can't be
    amplified by a few very sure rows.
    """
    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        fp, fu = pos.dot(w) + b, unl.dot(w) + b
        sp, su = np.clip(fp, -reach, reach), np.clip(fu, -reach, reach)
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        # derivative of each mean loss by the score of each row
        inside_p, inside_u = (sp == fp) / pos.n, (su == fu) / unl.n
        gp, gu = -prior * sigmoid(-sp) * inside_p, np.zeros(unl.n)
        if negative >= 0:
            gp, gu = gp - prior * sigmoid(sp) * inside_p, sigmoid(su) * inside_u
        return pos.back(gp) + unl.back(gu), gp.sum() + gu.sum()

    return _adam(gradient, pos.width, float(np.log(prior / (1 - prior))), steps, rate, l2)


def best_bin(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> tuple[float, float]:
    """Share of positives among unlabelled scores, and an upper bound of its error, from scores of fresh positives.

    Garg et al., "Mixture Proportion Estimation and PU Learning: A Modern Approach" (2021): the share of the unlabelled rows
    at or above a threshold, over that of the positives, is the prior plus what others reach the threshold.  The
    threshold taken is the one with the least upper bound of that ratio.
    """
    cuts = np.unique(pos)
    above_p = 1 - np.searchsorted(np.sort(pos), cuts, side="left") / len(pos)
    above_u = 1 - np.searchsorted(np.sort(unl), cuts, side="left") / len(unl)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(unl)) + 1 / np.sqrt(len(pos))) / above_p
    at = np.argmin(above_u / above_p + slack)
    return float(above_u[at] / above_p[at]), float(slack[at])


def estimate_prior(pos: Rows, unl: Rows, halves_p: np.ndarray, halves_u: np.ndarray, l2: float = 1e-3,
                   steps: int = 200, rate: float = 0.05) -> float:
    """The class prior from positives and unlabelled rows alone; no row labelled 0 is needed or looked at.

    On each half (0 or 1 by row; one document is in one half only) a logistic classifier tells positives from unlabelled
    rows, and the other half gives ``best_bin``; the mean of the two is taken.  It lies between half a row and all
    but half a row of the unlabelled ones.  Where a half has no positive or no unlabelled row, it is 0.5.
    """
    found = []
    for half in (0, 1):
        p, u, fresh_p, fresh_u = pos.only(halves_p == half), unl.only(halves_u == half), pos.only(halves_p != half), unl.only(halves_u != half)
        if not min(p.n, u.n, fresh_p.n, fresh_u.n):
            return 0.5

        def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
            gp, gu = -sigmoid(-p.dot(w) - b) / p.n, sigmoid(u.dot(w) + b) / u.n
            return p.back(gp) + u.back(gu), gp.sum() + gu.sum()

        w, b = _adam(gradient, pos.width, 0.0, steps, rate, l2)
        found.append(best_bin(fresh_p.dot(w) + b, fresh_u.dot(w) + b)[0])
    least = 0.5 / unl.n
    return float(np.clip(np.mean(found), least, 1 - least))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def told(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of every labelled id outside fold 0: the largest label of each, null ones left out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    return own.groupBy("doc_id").agg(F.max(F.col(label)).alias("label"))


def all_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(text, positive) of every document outside fold 0."""
    ones = told(labels, label).where("label = 1").select("doc_id", F.lit(True).alias("positive"))
    if ones.count() <= MOST_BROADCAST:
        ones = F.broadcast(ones)
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")
    return rows.join(ones, "doc_id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"))


def drawn_rows(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int = MAX_LABELLED,
               max_unlabelled: int = MAX_UNLABELLED, column: str = "text") -> DataFrame:
    """(doc_id, ``column``, positive, unlabelled) of the rows to learn from.

    Only rows outside fold 0 count.  Positives are rows labelled 1; unlabelled ones are documents drawn whatever their
    label, which is not looked at; rows labelled 0 have no part of their own.  Null ids and null labels count as no
    label; of several labels of one id the largest holds.  Both draws are the first rows by MD5 of the id,
    ``max_labelled`` positives by themselves, and so bounded, and small enough to broadcast.
    """
    order = F.md5(F.col("doc_id").cast("string"))
    drawn = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id")
    drawn = drawn.orderBy(order, "doc_id").limit(max_unlabelled)
    drawn_ones = told(labels, label).where("label = 1").orderBy(order, "doc_id").limit(max_labelled)
    flags = (drawn_ones.select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
             .unionByName(drawn.select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u")))
             .groupBy("doc_id").agg((F.max("p") == 1).alias("positive"), (F.max("u") == 1).alias("unlabelled")))
    return docs.select("doc_id", column).join(F.broadcast(flags), "doc_id")


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int = MAX_LABELLED,
                  max_unlabelled: int = MAX_UNLABELLED) -> tuple[DataFrame, float]:
    """``drawn_rows`` and the share of 1 among all labelled rows, a prior to pass on where rows labelled 0 are to be trusted."""
    n, ones = told(labels, label).agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    return drawn_rows(docs, labels, label, max_labelled, max_unlabelled), (ones / n if n else 0.0)


def usable(pos: int, unl: int) -> bool:
    """Whether there is anything to learn: some positives and some unlabelled rows."""
    return pos > 0 and unl > 0


#: Intercept where there is nothing to learn from: no document is taken for positive.
NOTHING_LEARNT = float(np.log(1e-6))
