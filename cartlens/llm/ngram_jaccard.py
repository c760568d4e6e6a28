"""Operator 10: n-gram Jaccard join by token-combination prefixes.

Documents are sets of word shingles; two are linked when the Jaccard similarity of their sets reaches the threshold.

All shingles are counted over the corpus.  Each set is ordered rare shingles first.  A pair over the threshold shares its
smallest common shingle within the usual prefixes; if that one is rare, the single shingle finds the pair.  If not, all
common shingles are frequent ones, and a prefix extended by m further places holds at least m + 1 of them in common;
frequent shingles fall into m classes, so two of those share a class, and the combination of the two finds the pair.  So
rare shingles are indexed singly and frequent ones only as pairs within a class, whose lists are far shorter.  m grows
with the size of the set, which keeps the number of combinations in proportion to it.

Documents with equal sets are one class; only the first document of a class is counted, indexed and paired.  A filter of
fixed size picks these documents; where it lets a copy through, that copy is folded into its class later.

Candidates are verified exactly, in two steps: first each list is tied to a few of its members, which joins up large groups
of near copies without pairing all of them; then every pair of a list that still stands in two groups is compared, so no
link is lost.  For lists of frequent combinations that happens in blocks of documents, inside a task, and only links come
out, not pairs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.llm.common import map_rows, small_batches, stored, table

SHINGLE = 5
#: Similarity in hundredths.
THRESHOLD = 80
#: A shingle in more documents than this is frequent, and a list with more members than this is compared in blocks.
FREQUENT_FROM = 64
#: Shingles, and documents at most, in a block that is compared with another block.
BLOCK_SHINGLES = 200_000
BLOCK_DOCUMENTS = 1_000
#: Size bound of the table of frequent shingles; with more of them, the least frequent ones count as rare.
MAX_FREQUENT = 1_000_000
#: Members of a list that the others are first tied to.
HUBS = 8
#: Bits of the filters that tell which documents' sets are needed; fuller filters let more sets through, never fewer.
FILTER_BITS = 1 << 26
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Distinct shingle numbers (64-bit hashes, sorted) of a whole text: A-Z in lower case, words between white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    out = h[:n - k + 1].copy()
    for i in range(1, k):
        out = out * _ODD + h[i:n - k + 1 + i]
    return np.unique(_mix(out))


def _packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers by byte planes, compressed; for ones that are mostly small."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<u8").ravel()


def parity(tokens: np.ndarray) -> bytes:
    """A bitmap of at least as many bits as tokens (a power of two): bit b is the parity of the tokens that hash to b.

    The bits in which two bitmaps differ are at most as many as the tokens in only one of the sets.
    """
    bits = max(256, 1 << int(len(tokens)).bit_length())
    odd = np.bincount((_mix(tokens ^ _ODD) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, n: int, m: int, threshold: int = THRESHOLD) -> bool:
    """False only if the parities show that sets of ``n`` and ``m`` tokens are less similar than the threshold."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # a place modulo half the bits
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    apart = int(np.bitwise_count(x ^ y).sum())
    return apart * (100 + threshold) <= (100 - threshold) * (n + m)


def classes_of(n: int) -> list[tuple[int, int]]:
    """(size class, number m of classes of frequent shingles) under which a set of ``n`` is indexed.

    With m at an eighth of the size, a set made of frequent shingles alone has about half as many combinations as shingles.

    A size class spans a factor of two.  Similar sets lie in one class or the next, so a set near the upper end of its
    class is indexed in the next one as well.
    """
    c = n.bit_length() - 1
    both = [c] + ([c + 1] if 100 * n >= THRESHOLD << (c + 1) else [])
    return [(x, max(4, (1 << x) // 8)) for x in both]


def signatures(tokens: np.ndarray, rarity: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Numbers under which a set is indexed; ``rarity`` is 0 for rare tokens and the count of frequent ones."""
    n = len(tokens)
    overlap = -(-threshold * n // 100)
    tokens = tokens[np.lexsort((tokens, rarity))]
    rare = int((rarity == 0).sum())
    out = [tokens[:min(rare, n - overlap + 1)]]
    for c, m in classes_of(n):
        frequent = tokens[rare:max(rare, n - overlap + m + 1)]
        if overlap <= m:  # too few tokens to be sure of two in one class
            out.append(tokens[rare:])
        if len(frequent) > 1:
            group = (_mix(frequent) % np.uint64(m)).astype(np.int64)
            for g in np.flatnonzero(np.bincount(group) > 1):
                own = np.sort(frequent[group == g])
                i, j = np.triu_indices(len(own), 1)
                out.append(_mix(own[i] * _ODD + _mix(own[j] + np.uint64(c + 1))))
    return np.unique(np.concatenate(out))


def _survey(docs: DataFrame) -> DataFrame:
    """(doc_id, n, one, two, parity) of every row: size, fingerprint and parity of its set."""
    def surveyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for s in map(shingles, x["text"]):
                one, two = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
                rows.append((len(s), one, two, parity(s) if len(s) else None))
            out = pd.DataFrame(rows, columns=["n", "one", "two", "parity"])
            out.insert(0, "doc_id", x["doc_id"].to_numpy())
            yield out

    return map_rows(docs, surveyed, "doc_id bigint, n bigint, one bigint, two bigint, parity binary", "doc_id")


def _filter(ids: DataFrame) -> np.ndarray:
    """Bitmap of FILTER_BITS over the ids (doc_id), by id modulo its size; its size doesn't depend on the data."""
    words = ids.groupBy((F.pmod("doc_id", F.lit(FILTER_BITS)) / 32).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(doc_id, {FILTER_BITS}) % 32 AS int))")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _passing(x: pd.DataFrame, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, shingles) of the rows of (doc_id, text) that pass the filter: all ids in it, and few others."""
    at = np.mod(x["doc_id"].to_numpy(np.int64), FILTER_BITS)
    ok = (wanted[at // 32] >> (at % 32).astype(np.uint32) & 1).astype(bool)
    for doc, text in zip(x["doc_id"][ok], x["text"][ok]):
        yield doc, shingles(text)


def _frequent(docs: DataFrame, reps: np.ndarray, fold: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles (folded, sorted) that are frequent among the documents that pass, and their counts; at most
    MAX_FREQUENT of them."""
    span = (1 << fold) // ranges

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_held = [], 0

        def packed() -> pd.DataFrame:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(token, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(span))
            return pd.DataFrame([(r, _packed(np.diff(token[a:b], prepend=np.uint64(r * span))), _packed(n[a:b]))
                                 for r, (a, b) in enumerate(zip(cut, cut[1:])) if b > a], columns=["part", "steps", "counts"])

        for x in batches:
            for _, s in _passing(x, reps):
                held.append(s >> np.uint64(64 - fold))
                n_held += len(s)
                if n_held > 1_500_000:
                    yield packed()
                    held, n_held = [], 0
        if n_held:
            yield packed()

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        base = np.uint64(int(part["part"].iloc[0]) * span)
        token = np.concatenate([np.cumsum(_unpacked(s)) + base for s in part["steps"]])
        n = np.concatenate([_unpacked(c) for c in part["counts"]]).astype(np.int64)
        token, at = np.unique(token, return_inverse=True)
        total = np.bincount(at, n).astype(np.int64)
        often = total > FREQUENT_FROM
        return pd.DataFrame({"token": token[often].astype(np.int64), "total": total[often]})

    rows = (docs.mapInPandas(counted, "part int, steps binary, counts binary").groupBy("part")
            .applyInPandas(summed, "token bigint, total bigint").orderBy(F.desc("total"), "token").limit(MAX_FREQUENT).toPandas())
    rows = rows.sort_values("token")
    return rows["token"].to_numpy(np.int64).astype(np.uint64), rows["total"].to_numpy(np.int64)


def _postings(docs: DataFrame, reps: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], fold: int) -> DataFrame:
    token, total = frequent  # at most MAX_FREQUENT entries

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_held = [], 0

        def table_of() -> pd.DataFrame:
            ids, sizes, signs = zip(*held)
            many = [len(g) for g in signs]
            return pd.DataFrame({"sign": np.concatenate(signs), "doc_id": np.repeat(np.array(ids, np.int64), many),
                                 "n": np.repeat(np.array(sizes, np.int64), many)})

        for x in batches:
            for doc, s in _passing(x, reps):
                if not len(s):
                    continue
                folded = s >> np.uint64(64 - fold)
                at = np.minimum(np.searchsorted(token, folded), max(len(token) - 1, 0))
                rarity = np.where(token[at] == folded, total[at], 0) if len(token) else np.zeros(len(s), np.int64)
                held.append((doc, len(s), signatures(s, rarity).view(np.int64)))
                n_held += len(held[-1][2])
                if n_held > 300_000:
                    yield table_of()
                    held, n_held = [], 0
        if held:
            yield table_of()

    return docs.mapInPandas(posted, "sign bigint, doc_id bigint, n bigint")


def _sizes_allow(n: Column, m: Column) -> Column:
    return (n * 100 >= m * THRESHOLD) & (m * 100 >= n * THRESHOLD)


def _plausible(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (a, b) whose parities leave them a chance."""
    def left(c: str) -> DataFrame:
        return info.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}"))

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ok = [may_be_similar(*r) for r in zip(x["parity_a"], x["parity_b"], x["n_a"], x["n_b"])]
            yield x.loc[ok, ["a", "b"]]

    return pairs.join(left("b"), "b").join(left("a"), "a").mapInPandas(checked, "a bigint, b bigint")


def _sets_of(ids: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """(doc_id, tokens) for the given doc_ids and perhaps some others; rows of a repeated id count once."""
    wanted = _filter(ids)

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = [(doc, s.tobytes()) for doc, s in _passing(x, wanted)]
            if got:
                yield pd.DataFrame(got, columns=["doc_id", "tokens"])

    sets = docs.mapInPandas(chosen, "doc_id bigint, tokens binary")
    # whole sets are only brought together by id where an id stands in several rows
    return stored(sets.dropDuplicates(["doc_id"]) if repeated else sets, "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ok = []
            for p, q in zip(x["tokens_a"], x["tokens_b"]):
                s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= THRESHOLD * (len(s) + len(t) - both))
            yield x.loc[ok, ["a", "b"]]

    def of(c: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(c), F.col("tokens").alias(f"tokens_{c}"))

    return pairs.join(of("b"), "b").join(of("a"), "a").mapInPandas(compared, "a bigint, b bigint")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], step: int = 8192) -> np.ndarray:
    """Number of tokens that each set of ``left`` has in common with each set of ``right``."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, tokens := np.concatenate(sets))
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        ok = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == tokens)
        return row[ok], at[ok]

    if len(shared):
        (i, x), (j, y) = places(left), places(right)
        for lo in range(0, len(shared), step):  # exact: counts stay far below 2**24
            a, b = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
            p, q = (x >= lo) & (x < lo + step), (y >= lo) & (y < lo + step)
            a[i[p], x[p] - lo] = 1
            b[j[q], y[q] - lo] = 1
            out += a @ b.T
    return out


def _compared_in_blocks(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the members of each group of ``hot`` (anchor, doc_id, n, label) that have different labels.

    The members of a group are dealt to blocks of about BLOCK_SHINGLES shingles; each pair of blocks is a task's work.
    """
    blocks = hot.groupBy("anchor").agg(
        F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_DOCUMENTS)).cast("int").alias("blocks"))
    dealt = hot.join(blocks, "anchor").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets, "doc_id")
    left = dealt.select("anchor", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"),
                        F.lit(0).alias("side"), "doc_id", "label", "tokens")
    right = dealt.where("block > 0").select("anchor", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"),
                                            F.col("block").alias("j"), F.lit(1).alias("side"), "doc_id", "label", "tokens")

    def compared(x: pd.DataFrame) -> pd.DataFrame:
        one = x[x["side"] == 0]
        two = x[x["side"] == 1] if x["i"].iloc[0] != x["j"].iloc[0] else one
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        s, t = ([np.frombuffer(v, np.uint64) for v in y["tokens"]] for y in (one, two))
        both = common_counts(s, t)
        size = np.array([len(v) for v in s])[:, None] + np.array([len(v) for v in t])[None, :]
        like = 100 * both >= THRESHOLD * (size - both)
        like &= one["label"].to_numpy()[:, None] != two["label"].to_numpy()[None, :]
        i, j = np.nonzero(like)
        p, q = one["doc_id"].to_numpy()[i], two["doc_id"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)}).drop_duplicates()

    return left.unionByName(right).groupBy("anchor", "i", "j").applyInPandas(compared, "a bigint, b bigint")


def connected(links: DataFrame) -> DataFrame:
    """(doc_id, label): the smallest id that each linked document reaches.

    Each round takes the smallest label among a node, its neighbours and its label's own label, until nothing changes;
    every round is a stored table.
    """
    links = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    now = stored(links.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("label"))
                 .select("doc_id", F.least("doc_id", "label").alias("label")), "labels")
    while True:
        near = links.join(now.select(F.col("doc_id").alias("b"), "label"), "b").select(F.col("a").alias("doc_id"), "label")
        jump = now.join(now.select(F.col("doc_id").alias("label"), F.col("label").alias("beyond")), "label").select(
            "doc_id", F.col("beyond").alias("label"))
        best = near.union(jump).groupBy("doc_id").agg(F.min("label").alias("new"))
        nxt = stored(now.join(best, "doc_id").select("doc_id", F.least("label", "new").alias("label"),
                                                     (F.col("new") < F.col("label")).alias("moved")), "labels")
        if not nxt.where("moved").limit(1).count():
            return nxt.select("doc_id", "label")
        now = nxt.select("doc_id", "label")


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("label", F.col("doc_id"))
    return lists.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set and the smallest id it reaches by links.

    Documents with equal sets are one class and never paired.  Null and empty texts have no shingles and are linked with
    nothing.  Ids identify texts; whole repeated rows are fine, and so is an empty table.  Texts are taken whole.
    """
    with small_batches(docs.sparkSession):
        return _groups(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))


def _groups(docs: DataFrame) -> DataFrame:
    rows = docs.count()
    fold = min(60, 5 + max(27, (max(rows, 1) * 1000).bit_length()))  # a shingle shares its folded number with few others
    ranges = 1 << max(5, (rows // 4000).bit_length())
    info = stored(_survey(docs), "survey")
    sets = info.where("n > 0").groupBy("one", "two", "n").agg(F.min("doc_id").alias("rep"))
    classes = stored(info.select("doc_id", "n", "one", "two").join(sets, ["one", "two", "n"], "left")
                     .select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    reps = _filter(classes.where("doc_id = rep AND n > 0").select("doc_id"))
    known = docs.where("doc_id IS NOT NULL")
    frequent = _frequent(known, reps, fold, ranges)
    copies = classes.where("doc_id <> rep").select("doc_id", "rep").distinct()
    repeated = not classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    links = _links(known, info, copies, _postings(known, reps, frequent, fold), repeated)
    joined = connected(links).select(F.col("doc_id").alias("rep"), "label")
    return classes.join(joined, "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))


def _links(docs: DataFrame, info: DataFrame, copies: DataFrame, posted: DataFrame, repeated: bool) -> DataFrame:
    """Links between classes that join up all that are similar (not every link inside a group)."""
    of_sign = Window.partitionBy("sign")
    shared = posted.withColumn("low", F.min("doc_id").over(of_sign)).withColumn("high", F.max("doc_id").over(of_sign))
    shared = shared.where("low <> high").select("sign", "doc_id", "n")
    lists = stored(shared.join(copies, "doc_id", "left")
                   .select("sign", F.coalesce("rep", "doc_id").alias("doc_id"), "n").distinct(), "lists")
    info = stored(info.where("n > 0").select("doc_id", "n", "parity").dropDuplicates(["doc_id"]), "info")
    # first: the members of a list against one of them, drawn by one of HUBS orders
    draw = F.struct(F.xxhash64(F.pmod("sign", F.lit(HUBS)), "doc_id").alias("key"), "doc_id", "n")
    hub = lists.groupBy("sign").agg(F.min(draw).alias("hub"))
    tied = lists.join(hub, "sign").where((F.col("doc_id") != F.col("hub.doc_id")) & _sizes_allow(F.col("n"), F.col("hub.n")))
    first = tied.select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b")).distinct()
    first = stored(_plausible(first, info), "first")
    found = stored(_verified(first, _sets_of(_ends(first), docs, repeated)), "found")
    # then: what a list has in two groups or more
    near = _labelled(lists, connected(found))
    open_ = stored(near.groupBy("sign").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"),
                                            F.mode("label", True).alias("anchor"))
                   .where("low <> high").select("sign", "members", "anchor"), "open")
    near = stored(near.join(open_, "sign"), "near")
    # ... in short lists, pair by pair
    short = near.where(F.col("members") <= FREQUENT_FROM)
    x, y = short.alias("x"), short.alias("y")
    rest = x.join(y, F.col("x.sign") == F.col("y.sign")).where(
        (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.label") != F.col("y.label")) & _sizes_allow(F.col("x.n"), F.col("y.n")))
    rest = rest.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    rest = stored(_plausible(rest.join(first, ["a", "b"], "left_anti"), info), "rest")
    # ... in long ones, by block; lists of the same main group are one
    hot = stored(near.where(F.col("members") > FREQUENT_FROM).select("anchor", "doc_id", "n", "label").distinct(), "hot")
    sets = _sets_of(_ends(rest).union(hot.select("doc_id")), docs, repeated)
    more = stored(_verified(rest, sets).union(_compared_in_blocks(hot, sets)), "found")
    return found.union(more)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def op10_combination_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents over all whole texts."""
    return similar_groups(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
single AS (SELECT doc_id, unnest(s) AS t FROM sets),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM single x JOIN single y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sized UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM reach JOIN sized USING (doc_id) GROUP BY 1, 2
"""
