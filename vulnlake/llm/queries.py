"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm import (
    jaccard_join,
    lexical_search,
    licenses,
    mixing,
    neighbours,
    packing,
    passages,
    pii,
    prefix_trie,
    quality,
    quality_votes,
    substrings,
    toxicity,
)
from vulnlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op4_mixing", mixing.sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op3_licenses", licenses.sql())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_personal_data")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pii.annotate(table(spark, folder, "documents"))


@query("op2_jaccard_join")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, folder, "documents"))


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents")).drop("distance")


@query("op7_neighbours")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op1_substrings")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicated(table(spark, folder, "documents"))


@query("op6_passages")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


@query("op11_quality_votes")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return quality_votes.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_lexical_search", lexical_search.sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_prefix_trie", prefix_trie.sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))
