"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from marketlake.llm.chat import OP3_SQL, op3_chat_formatting
from marketlake.llm.decontaminate import op10_benchmark_decontamination
from marketlake.llm.embeddings import op1_embedding_near_duplicates
from marketlake.llm.html import op6_html_extraction
from marketlake.llm.jaccard import op7_ngram_jaccard_join
from marketlake.llm.mixing import OP5_SQL, op5_mixing_by_raking
from marketlake.llm.negatives import OP13_SQL, op13_hard_negatives
from marketlake.llm.ngram_lm import op8_ngram_lm_scores
from marketlake.llm.pii import op4_information_theoretic_sanitising
from marketlake.llm.quality import op2_quality_classifier
from marketlake.llm.repeats import OP12_SQL, op12_suffix_array_dedup
from marketlake.llm.resample import OP11_SQL, op11_importance_resampling
from marketlake.llm.secrets import op9_secret_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_duplicates": op1_embedding_near_duplicates,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_information_theoretic_sanitising": op4_information_theoretic_sanitising,
    "op5_mixing_by_raking": op5_mixing_by_raking,
    "op6_html_extraction": op6_html_extraction,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_ngram_lm_scores": op8_ngram_lm_scores,
    "op9_secret_scan": op9_secret_scan,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_suffix_array_dedup": op12_suffix_array_dedup,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_formatting": OP3_SQL,
    "op5_mixing_by_raking": OP5_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_suffix_array_dedup": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
