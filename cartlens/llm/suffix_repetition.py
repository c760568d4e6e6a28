"""Operator 7: quality rules on repetition, by suffix arrays over words.

The suffix array of a document's words and the longest common prefix (LCP) of neighbouring suffixes give, for every
place, the longest repeated substring that starts there; the LCP intervals of the array are the maximal repeated
substrings.  The union of their spans is the covered part of a document.  Documents with too large a covered part or too
long a repeat fail.  The arrays of a batch of documents are built together by prefix doubling in numpy: only places whose
substring isn't yet unique are sorted again, so ordinary prose costs a few rounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cartlens.llm.common import WORD, map_rows, table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: The method's own rules: repeats of at least so many words count, may cover at most so large a share of the words, and
#: none may be longer than so many words and, in a longer text, than so large a share of it.
MIN_REPEAT = 5
MAX_COVERED = 0.2
MAX_LONGEST = 50
MAX_LONGEST_SHARE = 0.1
_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")


def suffix_ranks(words: np.ndarray, doc: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by document and their first 1, 2, 4, ... words, until all differ.

    A rank is the number of smaller suffixes, so equal ranks mean equal prefixes of that many words.  Each round sorts
    only places that still share their rank, by the rank of the place one prefix length further on (-1 past the end).
    """
    _, group, size = np.unique(doc * (words.max() + 1) + words, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[group]
    ranks, length = [rank], 1
    live = np.flatnonzero(size[group] > 1)
    while len(live):
        on = live + length
        there = on < end[live]
        second = np.full(len(live), -1, np.int64)
        second[there] = rank[on[there]]
        order = np.lexsort((second, rank[live]))
        live, second = live[order], second[order]
        head = rank[live]
        first_of_old = np.concatenate([[True], head[1:] != head[:-1]])
        first_of_new = first_of_old | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(live))
        old = np.maximum.accumulate(np.where(first_of_old, at, 0))
        new = np.maximum.accumulate(np.where(first_of_new, at, 0))
        rank = rank.copy()
        rank[live] = head + new - old
        ranks.append(rank)
        length *= 2
        live = live[np.bincount(new, minlength=len(live))[new] > 1]
    return ranks


def longest_repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every place, the length of the longest substring that starts there and also elsewhere in the same document.

    ``words`` are word numbers of the documents one after the other, ``doc`` the number of the document of each place,
    rising.  Occurrences may overlap.  It is the larger LCP with the two neighbours in the suffix array.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.searchsorted(doc, doc, side="right")  # first place after the document
    ranks = suffix_ranks(words, doc, end)
    array = np.empty(n, np.int64)
    array[ranks[-1]] = np.arange(n)
    one, two = array[:-1], array[1:]
    lcp = np.zeros(max(n - 1, 0), np.int64)
    open_ = np.flatnonzero(ranks[0][one] == ranks[0][two])
    for k in range(len(ranks) - 1, -1, -1):
        a, b = one[open_] + lcp[open_], two[open_] + lcp[open_]
        fits = np.flatnonzero((a < end[one[open_]]) & (b < end[two[open_]]))
        fits = fits[ranks[k][a[fits]] == ranks[k][b[fits]]]
        lcp[open_[fits]] += 1 << k
    out = np.zeros(n, np.int64)
    np.maximum.at(out, one, lcp)
    np.maximum.at(out, two, lcp)
    return out


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Places inside a repeat of at least ``least`` words, given the longest repeat at each place."""
    n = len(length)
    start = np.flatnonzero(length >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length[start], -1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true places as (first, one past the last)."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def examine(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> pd.DataFrame:
    """Counts, repeats and covered spans (in words) of every text; null counts as empty."""
    cut = [_WORD.findall(t or "") for t in texts]
    sizes = np.array([len(w) for w in cut], np.int64)
    number = {w: i for i, w in enumerate(dict.fromkeys(x for ws in cut for x in ws))}
    words = np.fromiter((number[x] for ws in cut for x in ws), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(cut)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    longest = longest_repeats(words, doc)
    in_repeat = covered(longest, min_repeat)
    in_window = covered(np.where(longest >= WINDOW, WINDOW, 0), WINDOW) if len(longest) else in_repeat
    rows = []
    for i, (t, ws) in enumerate(zip(texts, cut)):
        a, b = first[i], first[i + 1]
        lines = [x for x in (t or "").split("\n") if _WORD.search(x)]
        rows.append((len(ws), sum(map(len, ws)), len(_SYMBOL.findall(t or "")), len(lines) - len(set(lines)),
                     int(in_window[a:b].sum()), int(in_repeat[a:b].sum()),
                     int(longest[a:b].max()) if b > a else 0, spans_of(in_repeat[a:b])))
    return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                       "n_covered", "longest_repeat", "repeat_spans"])


def rate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_repeat: int = MIN_REPEAT,
         max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST,
         max_longest_share: float = MAX_LONGEST_SHARE) -> DataFrame:
    """A row per document with its counts, ``repeat_spans`` (covered runs of words) and the verdict ``kept``.

    Null and empty texts have no words and fail the base rules.  Repeated rows are judged each by itself; an empty table
    gives an empty one.  Texts of any length are taken whole.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for part in _slices(x):
                got = examine(list(part["text"]), min_repeat)
                got.insert(0, "doc_id", part["doc_id"].to_numpy())
                n = got["n_words"]
                got["base_failed"] = (n < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEATED_PERCENT * n)
                limit = np.maximum(max_longest, max_longest_share * n)
                got["kept"] = ~(got["base_failed"] | (got["n_covered"] > max_covered * n) | (got["longest_repeat"] > limit))
                got["repeat_spans"] = [[list(s) for s in spans] for spans in got["repeat_spans"]]
                yield got

    shape = (f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
             "n_repeat_words bigint, n_covered bigint, longest_repeat bigint, repeat_spans array<array<bigint>>, "
             "base_failed boolean, kept boolean")
    return map_rows(docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text"), rated, shape, "doc_id")


def _slices(x: pd.DataFrame, chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Consecutive rows of about ``chars`` characters, at least one row each."""
    size = x["text"].str.len().fillna(0).cumsum()
    yield from (part for _, part in x.groupby((size // chars).to_numpy()))


def op7_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every whole document."""
    return rate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_covered", "longest_repeat")
