"""Corpus pipeline: from raw documents to packed training sequences.

STAGES lists (name, function) in order.  A function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes the result of each stage as Parquet and reads it as the next one's input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import mixing, ngram_jaccard, packing, quality_classifier, secret_grammar
from cartlens.llm.common import WORD, free_name, small_batches, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score 0.3 or more)."""
    name = free_name(docs, "quality_score")
    model = quality_classifier.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model, name=name)
    return scored.where(F.col(name) >= quality_classifier.KEEP_FROM).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates; the least of the rows with one id.

    Documents without words or without an id stay.
    """
    groups = stored(ngram_jaccard.similar_groups(docs), "groups")
    copies = groups.where("component_id <> doc_id").select("doc_id")
    again = groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = docs.join(copies.union(again).distinct(), "doc_id", "left_anti")
    if again.isEmpty():  # else the texts would be shuffled a second time for nothing
        return once
    twice = docs.join(again.join(copies, "doc_id", "left_anti"), "doc_id", "left_semi")
    row = free_name(docs, "whole_row")
    # the least row, so that a second run keeps the same one
    first = twice.groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns])).alias(row))
    return once.unionByName(first.select(*[F.col(row)[c].alias(c) for c in docs.columns]))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars brought up to date."""
    automata = secret_grammar.learn(docs)

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            texts = [secret_grammar.redact(t, secret_grammar.scan(t, automata)) for t in x]
            # null where the text stays as it is
            yield pd.Series([None if t == old else t for t, old in zip(texts, x)], dtype=object)

    name = free_name(docs, "redacted")
    found = docs.withColumn(name, cleaned.asNondeterministic()(F.col("text")))
    if "n_chars" in docs.columns:
        n = F.length(name).cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col(name).isNotNull(), n).otherwise(F.col("n_chars")))
    return found.withColumn("text", F.coalesce(name, "text")).drop(name)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order; not taken ones go.

    The copy of a document at which its source's target ends keeps only the words that are taken, with single spaces.
    """
    cols = docs.columns
    info, key, nth, due, cut = (free_name(docs, x) for x in ("mix_plan", "mix_row", "mix_pass", "mix_position", "mix_cut"))
    # written, so that a row has the same key in the plan and beside its text
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "mix-rows")
    plan = mixing.mix(keyed, row=key)
    own = plan.select(F.struct("size", "taken", "passes", "positions").alias(info), key)
    joined = keyed.join(own, key).where(F.col(info)["passes"] > 0)
    copies = joined.select(*cols, info, F.posexplode(F.col(info)["positions"]).alias(nth, due))
    left = F.col(info)["taken"] - F.col(nth) * F.col(info)["size"]
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), left.cast("int")), " ")
    mixed = copies.withColumn(cut, left < F.col(info)["size"]).withColumn("text", F.when(F.col(cut), part).otherwise(F.col("text")))
    if "n_chars" in cols:
        mixed = mixed.withColumn("n_chars", F.when(F.col(cut), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return mixed.orderBy(due, "doc_id", key, nth).select(*cols)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with the sequence and offset at which each is packed."""
    pieces = stored(packing.tokenized_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces")
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the classifier, the grammars or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    # whole texts go to Python in every stage but the mix; large batches of them stay in an executor's buffers
    with small_batches(spark):
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
