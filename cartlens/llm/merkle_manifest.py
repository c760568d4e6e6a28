"""Operator 12: Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a source form a tree of fan-out 16, and the sources' roots one more.  A node's label is its
level and place, so children come before their parent in label order.  The forward sweep takes the messages (label of
the parent, child, digest) from a priority queue in label order: when a node's turn comes, all digests of its children stand
at the head of the queue, and its own digest is sent on to its parent.  The reversed sweep goes by falling label and sends
each child what it needs to know of the tree above it: the digests left and right of its path, level by level.

The queue is external: messages are dealt to sections of 16^3 places, three levels high, each swept in memory by one
call; messages that leave a section are a written table, sorted by label by the shuffle to the next sections.  A section has
at most 4 096 leaves however many a source has, and of a section only its root and the path above it travel.

Rows: every row is a leaf, nulls included.  Leaves of a source go by doc_id, null first, then by digest, so rows with one id
have a defined order and repeated whole rows are leaves of their own.  Rows with a null id are never tampered with.
An empty table gives no rows.  Other columns than the named ones are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import string
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.llm.common import stored, table

FANOUT = 16
#: Levels of a section; a section has FANOUT ** LEVELS places.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "struct<left:string,right:string>"


def digest_of(fields: Sequence[Column]) -> Column:
    """SHA-256 in lowercase hex of fields in order, each ``-`` if null, else byte count, ``:`` and value."""
    parts = []
    for c in fields:
        s = c.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text with A-Z in lower case where 5 divides the CRC-32 of the decimal id."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return F.when(hit, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def forward(digests: list[str], levels: int) -> list[list[str]]:
    """Digests by level of a section, its leaves first, ``levels`` levels up, each node in its turn of the queue."""
    queue = [(1, i // FANOUT, i, d) for i, d in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    out = [digests] + [[] for _ in range(levels)]
    while queue:
        level, node = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, node):
            children.append(heapq.heappop(queue)[3])
        own = sha("".join(children))
        out[level].append(own)
        if level < levels:
            heapq.heappush(queue, (level + 1, node // FANOUT, node, own))
    return out


def reversed_sweep(levels: list[list[str]], above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """For each leaf of a section the digests left and right of its path, from its run up; ``above`` is its root's path."""
    paths = [above] * len(levels[-1])
    for digests in reversed(levels[:-1]):
        below = []
        for first in range(0, len(digests), FANOUT):
            run, onward = digests[first:first + FANOUT], paths[first // FANOUT]
            below += [[("".join(run[:i]), "".join(run[i + 1:]))] + onward for i in range(len(run))]
        paths = below
    return paths


def _section(rows: pa.Table, levels: int) -> tuple[pa.Table, list[list[str]]]:
    """A section's rows by place, and its digests by level, as many levels up as its tree still has."""
    rows = rows.sort_by("place")
    left, high = -(-rows["n"][0].as_py() // FANOUT ** rows["height"][0].as_py()), 0
    while left > 1 and high < levels:
        left, high = -(-left // FANOUT), high + 1
    return rows, forward(rows["digest"].to_pylist(), high)


def _paths_of(known: pa.Table) -> list[tuple[str, str]]:
    return [(p["left"], p["right"]) for p in known["above"][0].as_py()]


def _as_column(paths: list[list[tuple[str, str]]]) -> pa.Array:
    return pa.array([[{"left": a, "right": b} for a, b in p] for p in paths],
                    pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))


NODE = "tree bigint, n bigint, place bigint, digest string, height int"


def _sections(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("section", F.floor(F.col("place") / F.lit(FANOUT ** levels)).cast("long"))


def sweep_forward(leaves: DataFrame, name: str, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The written messages of each round, leaves first, and (tree, digest) of each tree's root.

    ``leaves`` has tree, n (leaves of the tree), place (from 0) and digest.
    """
    def swept(key: tuple, rows: pa.Table) -> pa.Table:
        rows, digests = _section(rows, levels)
        return pa.table({"tree": rows["tree"][:1], "n": rows["n"][:1], "place": pa.array([rows["place"][0].as_py() // FANOUT ** levels]),
                         "digest": pa.array(digests[-1][:1]), "height": pa.array([rows["height"][0].as_py() + levels], pa.int32())})

    rounds = [leaves.withColumn("height", F.lit(0))]
    roots = None
    top = leaves.agg(F.max("n")).first()[0] or 0
    places = FANOUT ** levels
    while True:
        up = _sections(rounds[-1], levels).select(*[c.split()[0] for c in NODE.split(", ")], "section")
        up = stored(up.groupBy("tree", "section").applyInArrow(swept, NODE), f"{name}-messages")
        whole = F.col("n") <= F.lit(places).cast("long")
        done = up.where(whole).select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if top <= places:
            return rounds, roots
        rounds.append(up.where(~whole))
        places *= FANOUT ** levels


def sweep_back(rounds: list[DataFrame], paths: DataFrame, name: str, levels: int = LEVELS) -> DataFrame:
    """(tree, section, above, subroot, root) of each section of leaves: what its root's path to the top looks like.

    ``paths`` has tree, above (array of left and right digests from the tree's root up), subroot and root.
    """
    def section(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        rows, digests = _section(rows, levels)
        return pa.table({"tree": rows["tree"], "section": rows["place"],
                         "above": _as_column(reversed_sweep(digests, _paths_of(known))),
                         "subroot": pa.array([known["subroot"][0].as_py()] * len(rows)),
                         "root": pa.array([known["root"][0].as_py()] * len(rows))})

    reached, onward = FANOUT ** levels, None
    sizes = rounds[0].where("place = 0").select("tree", "n")
    with_n = stored(paths.join(sizes, "tree"), f"{name}-paths")
    for r in range(len(rounds) - 1, -1, -1):
        cap = reached ** (r + 1)
        ends = with_n.where((F.col("n") <= cap) & (F.col("n") > (reached ** r if r else 0)))
        own = ends.select("tree", F.lit(0).cast("long").alias("section"), "above", "subroot", "root")
        known = own if onward is None else own.unionByName(onward)
        if r == 0:
            return known
        nodes = _sections(rounds[r], levels).groupBy("tree", "section")
        onward = stored(nodes.cogroup(known.groupBy("tree", "section")).applyInArrow(
            section, f"tree bigint, section bigint, above array<{PATH}>, subroot string, root string"), f"{name}-suffixes")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``place`` from 0 within ``keys`` by ``order`` (nulls first) and ``n``, the rows of the key.

    Rows are dealt by ranges of (keys, order), so a key that holds a third of all rows is many tasks' work, and the
    position is the one within the task plus the rows of the key in the tasks before it.
    """
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*keys, *order]])
    ranged = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in [*keys, *order]])
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33)), name)
    parts = ranged.groupBy("task", *keys).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    by_key = Window.partitionBy(*keys).orderBy("task")
    parts = parts.select("task", *keys, (F.sum("rows").over(by_key) - F.col("rows") - F.col("first")).alias("shift"),
                         F.sum("rows").over(Window.partitionBy(*keys)).alias("n"))
    parts = parts.select(F.col("task").alias("of_task"), *[F.col(k).alias(f"of_{k}") for k in keys], "shift", "n")
    same = F.col("task") == F.col("of_task")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return (ranged.join(parts, same).withColumn("place", F.col("at") + F.col("shift"))
            .drop("at", "task", "of_task", "shift", *[f"of_{k}" for k in keys]))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, by sections ``levels`` levels high."""
    fields = [F.col(c) for c in FIELDS]
    changed = [*fields[:-1], tampered_text(F.col("doc_id"), F.col("text"))]
    leaf, other = digest_of(fields), digest_of(changed)
    leaves = stored(docs.select("doc_id", "source", leaf.alias("digest"),
                                F.when(~changed[-1].eqNullSafe(F.col("text")), other).alias("other")), "leaves")
    if leaves.isEmpty():
        return docs.sparkSession.createDataFrame([], _result_type(docs))
    placed = stored(numbered(leaves, ["source"], ["doc_id", "digest"], "leaves-ranged"), "leaves-placed")
    trees = numbered(placed.where("place = 0").select("source", F.lit(0).cast("long").alias("tree")), ["tree"], ["source"], "trees")
    trees = stored(trees.select(F.col("source").alias("of_source"), F.col("place").alias("of_tree"),
                                F.col("n").alias("trees")), "trees-placed")
    joined = placed.join(trees, F.col("source").eqNullSafe(F.col("of_source")))
    leaves = stored(joined.select("doc_id", "other", F.col("of_tree").alias("tree"), "n", "place", "digest"), "leaves-by-tree")

    rounds, subroots = sweep_forward(leaves, "source", levels)
    top = stored(subroots.join(trees.select(F.col("of_tree").alias("tree"), "trees"), "tree")
                 .select(F.lit(0).cast("long").alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("place"), "digest"), "top")
    top_rounds, top_root = sweep_forward(top, "top", levels)
    root = top_root.first()["digest"]
    start = top_root.select("tree", F.array().cast(f"array<{PATH}>").alias("above"), F.lit("").alias("subroot"), F.lit(root).alias("root"))
    paths = _leaf_paths(top_rounds, start, levels)
    paths = stored(paths.select(F.col("place").alias("tree"), "above", F.col("digest").alias("subroot"), "root"), "subroot-paths")

    known = sweep_back(rounds, paths, "source", levels)
    proven = _sections(rounds[0], levels).groupBy("tree", "section").cogroup(known.groupBy("tree", "section"))
    return proven.applyInArrow(lambda key, rows, known: _proofs(rows, known, levels), _result_type(docs))


def _result_type(docs: DataFrame) -> str:
    return (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, "
            "folded_root string, verified boolean")


def _leaf_paths(rounds: list[DataFrame], paths: DataFrame, levels: int) -> DataFrame:
    """(place, digest, above, root) of every leaf, ``above`` being its whole path."""
    def section(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        rows, digests = _section(rows, levels)
        return pa.table({"place": rows["place"], "digest": rows["digest"],
                         "above": _as_column(reversed_sweep(digests, _paths_of(known))),
                         "root": pa.array([known["root"][0].as_py()] * len(rows))})

    known = sweep_back(rounds, paths, "top", levels)
    return _sections(rounds[0], levels).groupBy("tree", "section").cogroup(known.groupBy("tree", "section")).applyInArrow(
        section, f"place bigint, digest string, above array<{PATH}>, root string")


def _proofs(rows: pa.Table, known: pa.Table, levels: int) -> pa.Table:
    """The proof of each leaf of a section, and the root that its tampered or own digest folds to."""
    rows, digests = _section(rows, levels)
    above, root = _paths_of(known), known["root"][0].as_py()
    upper = "".join(a + b for a, b in above)
    proofs, folded = [], []
    for path, own, other in zip(reversed_sweep(digests, []), digests[0], rows["other"].to_pylist()):
        proofs.append(sha("".join(a + b for a, b in path) + upper))
        at = own if other is None else other
        for left, right in path + above:
            at = sha(left + at + right)
        folded.append(at)
    return pa.table({"doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": pa.array([known["subroot"][0].as_py()] * len(rows)),
                     "root": pa.array([root] * len(rows)), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded),
                     "verified": pa.array([f == root for f in folded])})


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every document."""
    return manifest(table(spark, sf_dir, "documents"))
