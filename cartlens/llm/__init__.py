"""Operators of a training-data pipeline: each in a module of its own, with the registered query beside it.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from cartlens.llm import (bitsliced_topk, embedding_whitening, lm_scoring, merkle_manifest, mixing, ngram_jaccard, packing,
                              preference_format, quality_classifier, secret_grammar, sharding, suffix_repetition, toxicity)

    jobs = [preference_format.op1_preference_format, packing.op2_complement_packing, mixing.op3_curriculum_mix,
            sharding.op4_jump_sharding, toxicity.op5_nnpu_toxicity, quality_classifier.op6_pu_quality,
            suffix_repetition.op7_suffix_repetition, secret_grammar.op8_secret_grammar,
            bitsliced_topk.op9_bitsliced_topk, ngram_jaccard.op10_combination_prefixes, lm_scoring.op11_hashed_maxent,
            merkle_manifest.op12_merkle_manifest, embedding_whitening.op13_chebyshev_whitening]
    return {f.__name__: f for f in jobs}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""
    from cartlens.llm import bitsliced_topk, mixing, ngram_jaccard, preference_format

    return {"op1_preference_format": preference_format.OP1_SQL, "op3_curriculum_mix": mixing.OP3_SQL,
            "op9_bitsliced_topk": bitsliced_topk.OP9_SQL, "op10_combination_prefixes": ngram_jaccard.OP10_SQL}
