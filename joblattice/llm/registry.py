"""The registered queries of this subpackage and SQL that recomputes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from joblattice.llm import byte_bpe, licenses, line_dedup, media, packing, prefix_trie, quality_classifier, quality_rules, resampling, simhash, substring_dedup, suffix_dedup, topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op3_line_classes": line_dedup.op3_line_classes,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_simhash": simhash.op5_simhash,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_gif_columns": media.op9_gif_columns,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_topk_search": topk_search.op13_topk_search,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op3_line_classes": line_dedup.CLASSES_SQL,
    "op7_license_scan": licenses.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_importance_resampling": resampling.SQL,
    "op13_topk_search": topk_search.SQL,
}
