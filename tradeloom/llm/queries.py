"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradeloom.llm import decontaminate, filter_audit, importance, licences, ngram_join, order_minhash, packing, pii, quality, simhash, token_counts, toxicity, url_lists

_ALL = [
    licences.op1_licence_sentences,
    ngram_join.op2_ngram_jaccard_join,
    pii.op3_pii_sanitisation,
    decontaminate.op4_template_decontamination,
    packing.op5_sum_of_squares_packing,
    url_lists.op6_temporal_url_lists,
    quality.op7_compression_quality,
    toxicity.op8_nnpu_toxicity,
    token_counts.op9_section_token_counts,
    order_minhash.op10_order_minhash,
    filter_audit.op11_filter_interaction_audit,
    importance.op12_importance_resampling,
    simhash.op13_simhash_near_duplicates,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licence_sentences": licences.sql(), "op6_temporal_url_lists": url_lists.SQL,
        "op11_filter_interaction_audit": filter_audit.SQL, "op12_importance_resampling": importance.SQL,
    }
