"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from raceflow.llm import byte_bpe, curriculum, exact_dedup, html_extract, jaccard_join, language_id, licenses, line_quality, periodic_runs, pii, prefix_trie, suffix_dedup, weighted_sampling


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_frequency": line_quality.op1_line_frequency,
        "op2_curriculum_mix": curriculum.op2_curriculum_mix,
        "op3_html_blocks": html_extract.op3_html_blocks,
        "op4_signature_tree": jaccard_join.op4_signature_tree,
        "op5_byte_bpe": byte_bpe.op5_byte_bpe,
        "op6_disclosure": pii.op6_disclosure,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_license_digest": licenses.op9_license_digest,
        "op10_language_id": language_id.op10_language_id,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_weighted_sampling": weighted_sampling.op12_weighted_sampling,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_frequency": line_quality.ORACLE,
        "op2_curriculum_mix": curriculum.ORACLE,
        "op4_signature_tree": jaccard_join.ORACLE,
        "op8_exact_dedup": exact_dedup.ORACLE,
        "op9_license_digest": licenses.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
