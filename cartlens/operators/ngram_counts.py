"""Counts of words and adjacent pairs in texts of space-separated words, in Arrow batches.

A word becomes the integer of its place in a list once, and all further work is on integers: a pair is one integer of two
places, and the counts of a document come from one pass over its places.  Spark partitions the rows, sums the partial
counts and brings the rows of an id together; a task holds one slice of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20
#: For words alone, which need less beside them: the fewer slices, the fewer rows of a rare word go to Spark.
WORD_BYTES = 32 << 20
DENSE = 1 << 22


def _slices(batches: Iterator[pa.RecordBatch], col: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, about ``most`` bytes of the strings in column ``col`` at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(ends // most)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def _split(texts: pa.Array) -> pa.Array:
    """The list of the words of each text; an empty text is one empty word."""
    return pc.split_pattern(pc.fill_null(texts, ""), " ")


def _rows(lists: pa.Array) -> np.ndarray:
    """The row of each value of the lists."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _places(words: pa.Array, known: list[str]) -> np.ndarray:
    """The place of each word in ``known``, -1 for others."""
    at = pc.index_in(words, value_set=pa.array(known, type=words.type))
    return pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(at: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first * n + second, row) of adjacent words of a row that both have a place."""
    ok = (at[:-1] >= 0) & (at[1:] >= 0) & (row[:-1] == row[1:])
    return (at[:-1] * n + at[1:])[ok], row[:-1][ok]


def _tally(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, all below ``size``, ascending, and how often each occurs."""
    if size > DENSE:
        return np.unique(keys, return_counts=True)
    n = np.bincount(keys, minlength=1)
    found = np.flatnonzero(n)
    return found, n[found]


def _summed(texts: DataFrame, count: Callable) -> DataFrame:
    part = texts.mapInArrow(count, "term string, n bigint")
    return part.groupBy("term").agg(F.sum("n").alias("term_count"))


def word_counts(words: DataFrame) -> DataFrame:
    """(term, term_count) of all words of (.., words)."""
    def count(batches):
        for b in _slices(batches, 0, WORD_BYTES):
            got = pc.value_counts(_split(b.column(0)).flatten())
            yield pa.RecordBatch.from_arrays([got.field(0).cast(pa.string()), got.field(1)], ["term", "n"])

    return _summed(words.select("words"), count).where(F.col("term") != "")


def pair_counts(words: DataFrame, able: list[str] | None) -> DataFrame:
    """(term, term_count) of all adjacent pairs of ``able`` words (None: of all words) in (.., words)."""
    def count(batches):
        for b in _slices(batches, 0):
            lists = _split(b.column(0))
            flat, row = lists.flatten(), _rows(lists)
            if able is None:
                coded = flat.dictionary_encode()
                names, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            else:
                names, at = pa.array(able, type=flat.type), _places(flat, able)
            n = len(names)
            code, times = _tally(_pairs(at, row, n)[0], n * n)
            terms = pc.binary_join_element_wise(names.take(pa.array(code // n)), names.take(pa.array(code % n)), " ")
            yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(times, pa.int64())], ["term", "n"])

    return _summed(words.select("words"), count)


def _lists(kind: pa.DataType, lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _vectors(ids: pa.Array, key: np.ndarray, tf: np.ndarray, dim: int) -> pa.RecordBatch:
    """A row (id, idx, tf) for each row that has an entry; ``key`` is row * dim + place, ascending."""
    lengths = np.bincount(key // dim, minlength=len(ids))
    have = np.flatnonzero(lengths)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(have)), _lists(pa.int32(), lengths[have], key % dim),
                                       _lists(pa.int64(), lengths[have], tf)], ["id", "idx", "tf"])


def _merge(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """One row for each id of rows (id, idx, tf) that come by id; the last id of a batch waits for the next batch."""
    last = None
    for b in batches:
        if last is not None:
            b = pa.Table.from_batches([last, b.cast(last.schema)]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        ids = b.column(0)
        one, two = ids.slice(1), ids.slice(0, len(ids) - 1)
        same = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(pc.is_null(one), pc.is_null(two)))
        new = np.concatenate([[True], ~same.to_numpy(zero_copy_only=False).astype(bool)])
        if not new.all():
            group = np.cumsum(new) - 1
            keys = group[_rows(b.column(1))] * dim + b.column(1).flatten().to_numpy().astype(np.int64)
            key, where = np.unique(keys, return_inverse=True)
            tf = np.zeros(len(key), np.int64)
            np.add.at(tf, where, b.column(2).flatten().to_numpy())
            b = _vectors(ids.take(pa.array(np.flatnonzero(new))), key, tf, dim)
        last = b.slice(b.num_rows - 1)
        if b.num_rows > 1:
            yield b.slice(0, b.num_rows - 1)
    if last is not None:
        yield last


def count_vectors(words: DataFrame, chosen: list[str], id_col: str, ngram_max: int = 2) -> DataFrame:
    """(id, idx, tf), one row for each id of (id, words) with any of the ``chosen`` terms: their places and counts.

    The rows of a document are as long as ``chosen`` at most, and they are what the exchange by id moves.
    """
    dim, known = max(1, len(chosen)), sorted({w for t in chosen for w in t.split(" ")})
    place = {w: i for i, w in enumerate(known)}
    single = np.full(len(known) + 1, -1)  # the last one is for other words
    pair = {}
    for i, t in enumerate(chosen):
        w = [place[x] for x in t.split(" ")]
        if len(w) == 1:
            single[w[0]] = i
        else:
            pair[w[0] * len(known) + w[1]] = i
    codes = np.array(sorted(pair), np.int64)
    pair_at = np.array([pair[c] for c in codes.tolist()], np.int64)

    def count(batches):
        for b in _slices(batches, 1):
            lists = _split(b.column(1))
            flat, row = lists.flatten(), _rows(lists)
            at = _places(flat, known)
            term = single[at]
            keys = [(row * dim + term)[term >= 0]]
            if ngram_max >= 2 and len(codes):
                code, of = _pairs(at, row, len(known))
                near = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[near] == code
                keys.append((of * dim + pair_at[near])[hit])
            yield _vectors(b.column(0), *_tally(np.concatenate(keys), b.num_rows * dim), dim)

    kind = words.select(F.col(id_col).alias("id")).schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("idx", T.ArrayType(T.IntegerType())),
                           T.StructField("tf", T.ArrayType(T.LongType()))])
    found = words.select(F.col(id_col).alias("id"), "words").mapInArrow(count, schema)
    return (found.repartition("id").sortWithinPartitions("id").mapInArrow(lambda batches: _merge(batches, dim), schema)
            .withColumnRenamed("id", id_col))


def unit_weights(counts: DataFrame, idf: list[float], id_col: str) -> DataFrame:
    """(id, term_idx, weight): tf x idf of the rows (id, idx, tf), each row scaled to length 1."""
    scale = np.array(idf, np.float64)

    def weigh(batches):
        for b in batches:
            if not b.num_rows:
                continue
            idx, row = b.column(1).flatten(), _rows(b.column(1))
            w = b.column(2).flatten().to_numpy() * scale[idx.to_numpy()]
            norm = np.sqrt(np.bincount(row, w * w, minlength=b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), idx.cast(pa.int32()), pa.array(w / norm[row])],
                                             ["id", "term_idx", "weight"])

    schema = T.StructType([T.StructField("id", counts.schema[id_col].dataType), T.StructField("term_idx", T.IntegerType()),
                           T.StructField("weight", T.DoubleType())])
    return (counts.select(F.col(id_col).alias("id"), "idx", "tf").mapInArrow(weigh, schema)
            .withColumnRenamed("id", id_col))
