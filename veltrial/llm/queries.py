"""Queries of the training-data operators, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veltrial.llm import decontaminate, html, jaccard, language, packing, phrases, quality, secrets, sharding, streamdedup, suffixes, vectors, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffixes.op1_suffix_dedup,
    "op2_html": html.op2_html,
    "op3_packing": packing.op3_packing,
    "op4_vectors": vectors.op4_vectors,
    "op5_language": language.op5_language,
    "op6_secrets": secrets.op6_secrets,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_quality": quality.op9_quality,
    "op10_shards": sharding.op10_shards,
    "op11_phrases": phrases.op11_phrases,
    "op12_stream_dedup": streamdedup.op12_stream_dedup,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": suffixes.OP1_SQL,
    "op4_vectors": vectors.OP4_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_jaccard": jaccard.OP8_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op12_stream_dedup": streamdedup.OP12_SQL,
}
