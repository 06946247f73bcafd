"""Queries of this subpackage, by name, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import knn_join, mixing, near_dup, piece_bpe, quality_classifier, quality_rules, token_counts, token_tables, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_near_dup": near_dup.op1_near_dup,
        "op2_quality": quality_classifier.op2_quality,
        "op3_token_tables": token_tables.op3_token_tables,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_piece_bpe": piece_bpe.op5_piece_bpe,
        "op6_knn_join": knn_join.op6_knn_join,
        "op7_mixing": mixing.op7_mixing,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_warc": warc.op9_warc,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dup": near_dup.OP1_SQL, "op6_knn_join": knn_join.OP6_SQL, "op7_mixing": mixing.OP7_SQL}
