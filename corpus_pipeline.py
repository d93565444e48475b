"""From raw documents to shuffled training shards: each stage is one operator over all that the stage before has kept.

In every stage null texts count as empty, extra columns go along under their own names, texts of any length are read whole, and an empty table gives an empty table. Each operator's module says more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import contamination, decision_list, mixing, near_duplicates, sharding
from quire.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or a learned rule go, null and empty ones among them. Equal rows share a verdict."""
    return decision_list.filter_documents(spark, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id (null last; ties by the text's hash). Equal rows are one document; unlike texts of one doc_id are not."""
    return near_duplicates.keep_one(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, each of equal rows. Null and empty items match nothing."""
    return contamination.remove_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that the sources get their target shares of words. Null sources are one source; documents without words go; equal rows draw for themselves."""
    return mixing.mixed_documents(spark, docs)


def shuffle(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of equal row counts, in uniform random order, with size, text_crc32, shard and slot (columns of these names are replaced). Copies are spread like unlike rows."""
    return sharding.sharded_documents(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shuffle)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs


#: The rules are learned and the mix is drawn at random; tests hold the stages against brute force instead.
ORACLE_SQL = None
