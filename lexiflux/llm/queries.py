"""The registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflux.llm import decontaminate, fingerprints, lm, mixing, neardup, quality, quotes, substrings, tokencount, toxicity
from lexiflux.llm.common import fold, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(3) == 1)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_units(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return found.withColumn("removed", F.array_join(spans, ","))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"), fold(7) == 2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(4) == 2)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.in_order(mixing.mix(table(spark, sf_dir, "documents")))


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.render(quotes.link_quotes(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_quality, op3_substring_dedup, op4_fingerprints, op5_decontamination, op6_lm_scoring, op7_toxicity, op8_near_duplicates, op9_mixing, op10_chat_quotes)}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": substrings.ORACLE, "op9_mixing": mixing.ORACLE, "op10_chat_quotes": quotes.ORACLE}
