"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_names, contamination, decision_list, divergence, lexical_search, licenses, mixing, near_duplicates, rollups, rule_ensemble, sharding, substrings, tokens
from .common import table


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op1(spark, table(spark, sf_dir, "documents"))


def op2_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op2(spark, table(spark, sf_dir, "documents"))


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.op3(spark, sf_dir)


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.op5(spark, sf_dir)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.op6(spark, table(spark, sf_dir, "documents"))


def op7_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op7(spark, table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9(spark, table(spark, sf_dir, "documents"))


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.op10(spark, sf_dir)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


def op13_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.op13(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_token_shards, op2_hypergeometric_shuffle, op3_token_rollups, op4_benchmark_leaks, op5_decision_list,
        op6_near_duplicates, op7_repeated_substrings, op8_license_scan, op9_pareto_mix, op10_rule_ensemble,
        op11_lexical_search, op12_source_divergence, op13_block_names,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_benchmark_leaks": contamination.SQL, "op6_near_duplicates": near_duplicates.SQL, "op11_lexical_search": lexical_search.SQL, "op12_source_divergence": divergence.SQL, "op13_block_names": block_names.SQL}
