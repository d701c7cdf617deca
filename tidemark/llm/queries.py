"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.chat import OP10_SQL, op10_perspective_rotation
from tidemark.llm.codec import op6_bpe_round_trip
from tidemark.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tidemark.llm.filter_audit import OP11_SQL, op11_filter_audit
from tidemark.llm.html_text import op7_main_text
from tidemark.llm.near_dedup import op5_near_dedup
from tidemark.llm.packing import op2_best_fit_packing
from tidemark.llm.quality import OP3_SQL, op3_quality_rules
from tidemark.llm.ranked_search import OP13_SQL, op13_ranked_search
from tidemark.llm.sharding import OP4_SQL, op4_stratified_shards
from tidemark.llm.token_counts import op9_token_counts
from tidemark.llm.token_files import op8_token_files
from tidemark.llm.vector_dedup import OP12_SQL, op12_embedding_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_best_fit_packing,
        op3_quality_rules,
        op4_stratified_shards,
        op5_near_dedup,
        op6_bpe_round_trip,
        op7_main_text,
        op8_token_files,
        op9_token_counts,
        op10_perspective_rotation,
        op11_filter_audit,
        op12_embedding_dedup,
        op13_ranked_search,
    )
}
ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op3_quality_rules": OP3_SQL,
    "op4_stratified_shards": OP4_SQL,
    "op10_perspective_rotation": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_embedding_dedup": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
