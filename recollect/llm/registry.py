"""The corpus operators' queries and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact, lm, near, packing, pii, quality, substring, toxicity, urlfilter
from .common import documents


def vocabulary() -> str:
    """Where the public word-level vocabulary lies; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": lambda spark, d: packing.op1_best_fit_packing(documents(spark, d), vocabulary()),
        "op2_bpe": lambda spark, d: bpe.op2_bpe(documents(spark, d), vocabulary()),
        "op3_toxicity": lambda spark, d: toxicity.op3_toxicity(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op4_order_minhash": lambda spark, d: near.op4_order_minhash(documents(spark, d)),
        "op5_pii": lambda spark, d: pii.op5_pii(documents(spark, d)),
        "op6_lm_scoring": lambda spark, d: lm.op6_lm_scoring(documents(spark, d)),
        "op7_url_filters": lambda spark, d: urlfilter.op7_url_filters(spark.read.parquet(f"{d}/pages.parquet")),
        "op8_quality_rules": lambda spark, d: quality.op8_quality_rules(documents(spark, d)),
        "op9_substring_dedup": lambda spark, d: substring.op9_substring_dedup(documents(spark, d)),
        "op10_exact_dedup": lambda spark, d: exact.op10_exact_dedup(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": urlfilter.ORACLE, "op8_quality_rules": quality.ORACLE, "op10_exact_dedup": exact.ORACLE}
