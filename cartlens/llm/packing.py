"""Operator 2: best-fit packing by exact-complement hashing.

A sequence of fixed capacity is filled exactly where possible.  Whatever the corpus, there are at most ``capacity``
different piece lengths, so the whole packing is planned on the histogram of lengths: for an open gap, the sums of
single lengths, of pairs and of triples are looked up, and a combination that fills the gap is consumed as often as the
counts allow.  Where no combination fits, the largest length that fits goes in (best fit) and the smaller gap is looked
up again.  The plan, a bounded table, is then applied to the pieces by their rank within their length.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.common import give_back_memory, in_python_worker_single_threaded, map_rows, running, stored, table

CAPACITY = 2048
END = 0
#: Entries that a Python worker keeps of its cache of ids, about 0.2 kB each.
MOST_KEPT = 300_000
#: How a byte-level tokenizer cuts a text, and the first character (after Latin, Greek and Cyrillic) whose class is left to it.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BELOW = "\u0530"


def _complement(count: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Available lengths (one, two or three of them) that sum to ``gap``, the larger ones first; None if there are none."""
    if count[gap]:
        return (gap,)
    here = count[:gap + 1] > 0
    half = np.arange((gap + 1) // 2, gap)
    ok = here[half] & here[gap - half] & ((half * 2 != gap) | (count[half] > 1))
    if ok.any():
        a = int(half[np.flatnonzero(ok)[-1]])
        return (a, gap - a)
    for a in np.flatnonzero(here)[::-1].tolist():
        if 3 * a < gap:
            break
        if a > gap - 2:
            continue
        b = np.arange(max((gap - a + 1) // 2, 1), min(a, gap - a - 1) + 1)
        c = gap - a - b
        ok = here[b] & here[c]
        for i in np.flatnonzero(ok)[::-1].tolist():
            lengths = (a, int(b[i]), int(c[i]))
            if all(count[x] >= k for x, k in Counter(lengths).items()):
                return lengths
    return None


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences), using every piece of the histogram once.

    Each step uses up at least one length, so there are at most a few thousand patterns for any corpus.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1 to {capacity}")
        count[length] += n
    plan = []
    while count.any():
        first = int(np.flatnonzero(count)[-1])
        pattern = [first]
        count[first] -= 1
        gap = capacity - first
        while gap:
            fill = _complement(count, gap)
            if fill is None:
                fitting = np.flatnonzero(count[:gap + 1])
                if not len(fitting):
                    break
                fill = (int(fitting[-1]),)
            for x in fill:
                count[x] -= 1
            pattern += fill
            gap -= sum(fill)
        need = Counter(pattern)
        more = min(int(count[x]) // k for x, k in need.items())
        for x, k in need.items():
            count[x] -= more * k
        plan.append((tuple(sorted(pattern, reverse=True)), more + 1))
    return plan


def placement(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks: pieces of ``length`` ranked from ``rank`` on fill ``copies`` sequences starting
    at ``sequence``; every further ``copies`` pieces go ``length`` places further right in the same sequences."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, copies in plan:
        at = 0
        for length, k in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, used[length], sequence, copies, at))
            used[length] += k * copies
            at += k * length
        sequence += copies
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "copies", "at"), cols))


def pack(pieces: DataFrame, length: str = "length", ids: tuple[str, ...] = ("doc_id", "piece"),
         capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece (``ids`` identify it; ``length`` is 1 to ``capacity``).

    Other columns stay.  Pieces of a sequence lie side by side from 0.  An empty table stays empty; a null length or one
    out of range raises.  ``pieces`` is read several times and should be a stored table.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most ``capacity`` rows
    if None in histogram:
        raise ValueError("a piece has no length")
    rule = placement(plan_packing(histogram, capacity))
    ranked = running(pieces, [length], list(ids), F.lit(1), "rank_in_length")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    # the rule has at most a few thousand patterns of distinct lengths, whatever the corpus
    width = 1 << 44

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = rule["length"] * width + rule["rank"]
        for x in batches:
            n, r = x[length].to_numpy(np.int64), x["rank_in_length"].to_numpy(np.int64)
            i = np.searchsorted(keys, n * width + r, side="right") - 1
            past = r - rule["rank"][i]
            x["sequence_id"] = rule["sequence"][i] + past % rule["copies"][i]
            x["offset"] = rule["at"][i] + past // rule["copies"][i] * n
            yield x.drop(columns="rank_in_length")

    return ranked.mapInPandas(place, shape)


def _plain_encoding(path: str):
    """The tokenizer's vocabulary as a tiktoken encoding, several times faster on a short piece; None where the file is not
    a byte-level BPE whose ids follow the order of its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    if (model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True)
            or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout")):
        return None
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in added}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [model["vocab"][t] for t in merged] != list(range(256, 256 + len(merged))):
        return None
    return tiktoken.Encoding("plain", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Function from a text to its ids as little-endian unsigned 32-bit bytes, by the tokenizer at ``path``.

    Words repeat, so ids are kept by piece of text.  The tokenizer never joins what a single space separates from
    something that is no white space, so a text is cut before such spaces; texts with two spaces in a row or with the
    string of an added token, which the tokenizer gives its own id, go whole.
    """
    in_python_worker_single_threaded()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    plain = _plain_encoding(path)

    def ids_of(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    class Pieces(dict):
        def __missing__(self, piece: str) -> bytes:
            # where both libraries' character classes surely agree; the same vocabulary gives the same ids
            if plain and piece.replace("\n", "").isprintable() and max(piece) < PLAIN_BELOW:
                ids = self[piece] = array("I", plain.encode_ordinary(piece)).tobytes()
            else:
                ids = self[piece] = ids_of(piece)
            return ids

    known = Pieces({"": b""})

    def encode(text: str) -> bytes:
        if "  " in text or "\0" in text or any(t in text for t in added):
            return ids_of(text)
        if len(known) > MOST_KEPT:
            known.clear()
            known[""] = b""
        return b"".join(map(known.__getitem__, text.replace(" ", "\0 ").split("\0")))

    return encode


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Cut every document (doc_id, text) into pieces of at most ``capacity`` ids.

    A document's ids are those of its text (null: empty), then id 0.  Only longer documents are cut, into full pieces
    with the shorter one first.  Returns doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little
    endian).  Texts of any length go whole through the tokenizer.
    """
    shape = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back_memory()
        encode = _encoder(tokenizer_path)
        end = np.array([END], "<u4").tobytes()
        for x in batches:
            rows = []
            for doc, text in zip(x["doc_id"], x["text"]):
                ids = encode(text or "") + end
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    own = ids[4 * a:4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(own)) + ((own,) if keep_ids else ()))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return map_rows(docs.select("doc_id", "text"), cut, shape, "doc_id")


def op2_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids of the 50k byte-level tokenizer."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    pieces = stored(tokenized_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
