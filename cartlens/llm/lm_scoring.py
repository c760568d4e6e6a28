"""Operator 11: scoring of texts by a hashed maximum-entropy language model.

P(token | history) = P(class | history) * P(token | class).  The class level is a maximum-entropy model: a softmax over
classes of summed weights, one row of weights for each active feature (the last word, the last two words, and the word
skipped to), rows found by hashing.  It starts from the classes' own shares and is trained by gradient steps inside
tasks, whose changes are averaged between rounds by how often each task saw a row; the rounds take disjoint training texts, so
that every one is used once.  The token level has the one feature of the word itself, whose maximum-entropy solution
is (c + 1) over the class's sum, c being the word's count in training.

Classes: the commonest words have one each; the other frequent words and all rare ones are dealt to classes by the CRC-32 of
their last two bytes, so a word that was never counted has a class too.  Each class of rare words has one outcome, of mass
1, for all its unknown words.  The outcomes together have probability 1.

The frequent words (a bounded number, with exact counts) travel to the tasks.  The counts of all others stay a table and are
joined to the rare words of each text.

Null texts count as empty and hold only the end token.  Rows with a null id are not held out.  Repeated rows count as often as
they stand.  Without training texts N and V are 0, all words are unknown, and the model is that of equal classes.  Other columns than id
and text are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import stored, table

FOLDS, HELD_OUT = 7, 2
#: The end of a text; no word is empty.
END = b""
#: Words with a class of their own, classes of the other frequent words, classes of rare words.
SINGLE, FREQUENT_CLASSES, RARE_CLASSES = 32, 16, 16
CLASSES = SINGLE + FREQUENT_CLASSES + RARE_CLASSES
#: Words that travel to the tasks with their counts.
FREQUENT = 200_000
#: Rows of weights (a power of two), rounds of training, tokens of a gradient step, step size, tokens of a training task.
ROW_BITS = 14
ROUNDS = 3
STEP_TOKENS = 16_384
RATE = 0.25
#: Sum of squares that each row's past gradients start from: the larger, the less a row that was seen a few times moves.
PAST = 4.0
TASK_TOKENS = 4_000_000
#: Different words that a task counts, or remembers, before it hands them on.
MOST_WORDS = 400_000
#: Tokens of a softmax in scoring, few enough for the cache, and tokens that are encoded together.
SCORED_AT_ONCE = 2_048
SCORED_TOKENS = 65_536
#: Odd constants of the multiplicative hash.
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only): what stands between the six ASCII white-space characters."""
    return (text or "").encode().lower().split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def tail(word: bytes) -> int:
    return zlib.crc32(word[-2:])


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) of every different token of all texts, the end token (the empty word) included."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": pd.Series([w.decode() for w in seen], dtype=object), "c": list(seen.values())})

        for batch in batches:
            for t in batch["text"]:
                seen.update(tokens(t))
                seen[END] += 1
                if len(seen) > MOST_WORDS:
                    yield rows()
                    seen.clear()
        yield rows()

    got = docs.select(F.col(text).alias("text")).mapInPandas(counted, "word string, c bigint")
    return got.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Frequent words by falling count, sums over all words, and the mass of each class."""

    words: list[bytes]
    c: np.ndarray
    n: int
    v: int
    mass: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))

    def classes(self) -> np.ndarray:
        """Class of each frequent word."""
        dealt = [SINGLE + tail(w) % FREQUENT_CLASSES for w in self.words[SINGLE:]]
        return np.array([*range(min(SINGLE, len(self.words))), *dealt], np.int64)

    @staticmethod
    def of(counts: DataFrame, frequent: int = FREQUENT) -> "Vocabulary":
        """From the stored counts; the end token is always one of the frequent words, if it was counted."""
        n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        top = counts.where("word != ''").orderBy(F.desc("c"), "word").limit(frequent).unionByName(counts.where("word = ''"))
        got = top.toPandas().sort_values(["c", "word"], ascending=[False, True])
        own = Vocabulary([w.encode() for w in got["word"]], got["c"].to_numpy(np.int64), n, v)
        binary = F.encode("word", "UTF-8")
        last = F.when(F.octet_length("word") > 2, F.substring(binary, -2, 2)).otherwise(binary)
        sums = counts.groupBy((F.crc32(last) % RARE_CLASSES).alias("k")).agg(F.sum(F.col("c") + 1).alias("m")).collect()
        # all words by the class of their last bytes, less the frequent ones, plus one for the unknown ones
        mass = [0] * SINGLE + [0] * FREQUENT_CLASSES + [1] * RARE_CLASSES
        for k, m in sums:
            mass[SINGLE + FREQUENT_CLASSES + k] += m
        for w, c, k in zip(own.words, own.c.tolist(), own.classes().tolist()):
            mass[SINGLE + FREQUENT_CLASSES + tail(w) % RARE_CLASSES] -= c + 1
            mass[k] += c + 1
        own.mass = np.array(mass, np.float64)
        return own

    def shares(self) -> np.ndarray:
        """Logarithm of each class's share; a class without words has next to none."""
        return np.log(np.maximum(self.mass, 1e-6) / self.mass.sum()).astype(np.float32)


class Codes(dict):
    """Code of each word: its place among the frequent ones, or for rare ones a negative number of hash and class."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.start = len(words)
        self.room = len(words) + MOST_WORDS

    def __missing__(self, word: bytes) -> int:
        code = -1 - ((zlib.crc32(word) & 0xFFFFF) * RARE_CLASSES + tail(word) % RARE_CLASSES)
        if len(self) < self.room:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> list[int]:
        """Two marks of the start, the codes of the words, and the end."""
        return [self.start, self.start, *map(self.__getitem__, words), self[END]]

    def keys_and_classes(self, codes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands for each token in features, and its class; ``classes`` has one more for the start."""
        rare, other = codes < 0, -1 - codes
        key = np.where(rare, self.start + 1 + other // RARE_CLASSES, codes)
        return key, np.where(rare, SINGLE + FREQUENT_CLASSES + other % RARE_CLASSES, classes[np.where(rare, 0, codes)])


def feature_rows(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of the features of the tokens at the given places: last word, last two words, word before the last."""
    k = key.astype(np.uint64)
    one, two = k[at - 1], k[at - 2]
    hashes = np.stack([one * _A + _C, one * _A + two * _B, two * _B + _D])
    hashes ^= hashes >> np.uint64(29)
    return ((hashes * _D) >> np.uint64(64 - ROW_BITS)).astype(np.uint16)


def softmax(weights: np.ndarray, shares: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the classes for each column of ``rows``, less the greatest one, their exponentials and the sums of these."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += shares
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return z, e, e @ np.ones(e.shape[1], e.dtype)


def class_log_probability(weights: np.ndarray, shares: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural logarithm of P(class | history) of each column's own class."""
    z, _, total = softmax(weights, shares, rows)
    return z[np.arange(len(classes)), classes] - np.log(total)


def summed_by_group(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of ``sizes`` rows, by adding neighbours until one row of each run is left."""
    out = np.empty((len(sizes), values.shape[1]), values.dtype)
    at = np.arange(len(sizes))
    while len(at):
        first = np.cumsum(sizes) - sizes
        single = sizes == 1
        out[at[single]] = values[first[single]]
        at, first, sizes = at[~single], first[~single], sizes[~single]
        half = (sizes + 1) // 2
        inside = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half)
        left = np.repeat(first, half) + 2 * inside
        paired = 2 * inside + 1 < np.repeat(sizes, half)
        after = values.take(left, axis=0)
        after[paired] += values.take(left[paired] + 1, axis=0)
        values, sizes = after, half
    return out


def gradient(weights: np.ndarray, shares: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows touched, the gradient of the summed negative log-likelihood by each, and how often each was active."""
    _, g, total = softmax(weights, shares, rows)
    g /= total[:, None]
    g[np.arange(len(classes)), classes] -= 1
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    times = np.diff(np.append(first, len(ordered)))
    return ordered[first], summed_by_group(g.take(order % len(classes), axis=0), times), times


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray

    def shipped(self) -> tuple:
        v = self.vocabulary
        return b" ".join(v.words), len(v.words), v.c, v.classes(), v.mass, v.shares(), self.weights


def _unpacked(shipped: tuple) -> tuple:
    words, n, c, classes, mass, shares, weights = shipped
    return Codes(words.split(b" ") if n else []), c, np.append(classes, 0), mass, shares, weights


def train(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", rounds: int = ROUNDS, task_tokens: int = TASK_TOKENS) -> Model:
    """Weights after ``rounds`` rounds over disjoint parts of ``docs`` (doc_id, text).

    Inside a task steps are scaled by each row's past gradients.  A round's new weights are the tasks' ones averaged
    row by row, weighted by how often each task saw the row; what is sent is one vector per task and row.
    """
    spark = docs.sparkSession
    size = 1 << ROW_BITS
    weights, past = np.zeros((size, CLASSES), np.float32), np.full(size, PAST, np.float32)
    tasks = max(1, -(-vocabulary.n // task_tokens))
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((Model(vocabulary, weights).shipped(), past))

        def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shipped, own_past = sent.value
            codes, _, classes, _, shares, start = _unpacked(shipped)
            own, own_past, seen = start.copy(), own_past.copy(), np.zeros(size, np.int64)
            flat: list[int] = []

            def take(flat: list[int]) -> None:
                key, k = codes.keys_and_classes(np.array(flat, np.int64), classes)
                places = np.flatnonzero(key != codes.start)
                for a in range(0, len(places), STEP_TOKENS):
                    at = places[a:a + STEP_TOKENS]
                    touched, g, times = gradient(own, shares, feature_rows(key, at), k[at])
                    own_past[touched] += np.einsum("ij,ij->i", g, g) / CLASSES
                    own[touched] -= RATE * g / np.sqrt(own_past[touched])[:, None]
                    seen[touched] += times

            for batch in batches:
                for t in batch["text"]:
                    flat += codes.of(tokens(t))
                    if len(flat) >= SCORED_TOKENS:
                        take(flat)
                        flat = []
            if flat:
                take(flat)
            rows = np.flatnonzero(seen)
            change = (own[rows] - start[rows]).astype(np.float16)
            yield pd.DataFrame({"row": rows.astype(np.int32), "seen": seen[rows], "past": own_past[rows].astype(np.float64),
                                "change": pd.Series([x.tobytes() for x in change], dtype=object)})

        def averaged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for row, n, p, change in zip(batch["row"], batch["seen"], batch["past"], batch["change"]):
                    own = n * np.append(np.frombuffer(change, np.float16).astype(np.float64), [p, 1.0])
                    total[row] = total[row] + own if row in total else own
            if total:
                yield pd.DataFrame({"row": np.array(list(total), np.int32), "mean": [(x[:-1] / x[-1]).tolist() for x in total.values()]})

        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select(F.col(text).alias("text")).coalesce(tasks)
        changes = part.mapInPandas(steps, "row int, seen bigint, past double, change binary")
        got = changes.repartition("row").mapInPandas(averaged, "row int, mean array<double>").toPandas()
        if len(got):
            mean = np.stack(got["mean"].to_numpy())
            weights, past = weights.copy(), past.copy()
            weights[got["row"]] += mean[:, :-1].astype(np.float32)
            past[got["row"]] = mean[:, -1]
        sent.unpersist()
    return Model(vocabulary, weights)


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (its columns but the text) with n_tokens, n_known, train_tokens, base_score and score.

    Texts are passed over once, in numpy batches; the rare words of each text meet their counts in a join.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model.shipped())
    v = model.vocabulary

    @F.pandas_udf("n bigint, n_frequent bigint, frequent double, given double, rare string")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codes, c, classes, mass, shares, weights = _unpacked(sent.value)
        log_c = np.append(np.log10(c + 1.0), 0.0)
        log_mass = np.log10(np.maximum(mass, 1.0))

        def one(texts: list[np.ndarray]) -> np.ndarray:
            code = np.concatenate(texts)
            of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            key, k = codes.keys_and_classes(code, classes)
            places = np.flatnonzero(key != codes.start)
            given = np.empty(len(places))
            for a in range(0, len(places), SCORED_AT_ONCE):
                at = places[a:a + SCORED_AT_ONCE]
                given[a:a + len(at)] = class_log_probability(weights, shares, feature_rows(key, at), k[at])
            given = given / np.log(10) - log_mass[k[places]]
            code, of = code[places], of[places]
            frequent = code >= 0
            own = np.where(frequent, log_c[np.where(frequent, code, -1)], 0.0)
            return np.stack([np.bincount(of, x, len(texts)) for x in (np.ones(len(of)), frequent, own, given)])

        for batch in batches:
            parts, waiting, size, rare = [], [], 0, []
            for t in batch:
                words = tokens(t)
                code = np.array(codes.of(words), np.int64)
                out = code[2:-1] < 0
                rare.append(b" ".join(compress(words, out.tolist())).decode() if out.any() else None)
                waiting.append(code)
                size += len(code)
                if size >= SCORED_TOKENS:
                    parts.append(one(waiting))
                    waiting, size = [], 0
            if waiting:
                parts.append(one(waiting))
            n, n_frequent, frequent, given = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0))
            yield pd.DataFrame({"n": n.astype(np.int64), "n_frequent": n_frequent.astype(np.int64), "frequent": frequent, "given": given,
                                "rare": pd.Series(rare, dtype=object)})

    kept = [F.col(x).alias(f"c{i}") for i, x in enumerate(x for x in docs.columns if x != text)]
    names = [x for x in docs.columns if x != text]
    rows = stored(docs.select(F.monotonically_increasing_id().alias("rid"), scored(F.col(text)).alias("s"), *kept)
                  .select("rid", *[f"c{i}" for i in range(len(kept))], "s.*"), "scored")
    rare = rows.where(F.col("rare").isNotNull()).select("rid", F.explode(F.split("rare", " ")).alias("word"))
    met = rare.join(counts, "word").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("log_rare"), F.count("*").alias("n_rare"))
    both = rows.drop("rare").join(met, "rid", "left")
    log_rare, n_rare = F.coalesce("log_rare", F.lit(0.0)), F.coalesce("n_rare", F.lit(0))
    uniform = float(np.log10(v.n + v.v + 1.0))
    return both.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(names)], F.col("n").alias("n_tokens"),
                       (F.col("n_frequent") + n_rare).alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"),
                       (F.col("frequent") + log_rare - F.col("n") * uniform).alias("base_score"),
                       (F.col("frequent") + log_rare + F.col("given")).alias("score"))


def fit(docs: DataFrame, text: str = "text", frequent: int = FREQUENT, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model of the texts of ``docs`` (doc_id, text), and the stored counts of all their words."""
    counts = stored(count_tokens(docs, text), "counts")
    return train(docs, Vocabulary.of(counts, frequent), text, rounds), counts


def op11_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = fit(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model, counts).withColumn("held_out", held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
