"""Counts, densities and ranks by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflux.functions.text import per_thousand, ratio, short_doc
from lexiflux.operators.lexicon import TIERS
from lexiflux.plans.places import ranked

TOP_DOC = 10


def counts(kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term_id, n for the terms that occur."""
    return kept.groupBy(key, "term_id").agg(F.count(F.lit(1)).alias("n"))


def tier_sum(tier: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("tier") == tier, F.col("n"))), F.lit(0))


def totals(counted: DataFrame, terms: DataFrame, by: str) -> DataFrame:
    """by, hits, weighted, unique_terms, extra_hits and hits of each tier. terms is a lexicon, broadcast."""
    t = counted.join(F.broadcast(terms.select("term_id", "tier", "weight", "extra")), "term_id")
    return t.groupBy(by).agg(F.sum("n").alias("hits"), F.sum(F.col("n") * F.col("weight")).alias("weighted"), F.count_distinct("term_id").alias("unique_terms"),
                             F.coalesce(F.sum(F.when(F.col("extra"), F.col("n"))), F.lit(0)).alias("extra_hits"), *(tier_sum(x).alias(f"{x}_hits") for x in TIERS))


def doc_rows(docs: DataFrame, counted: DataFrame, terms: DataFrame) -> DataFrame:
    """One row for each document, those without hits included.

    docs: doc_id, symbol, doc_kind, n_words, quantity_hits, year_hits.
    """
    none = F.lit(0)
    rows = docs.join(totals(counted, terms, "doc_id"), "doc_id", "left")
    n, hits, weighted = F.col("n_words"), F.coalesce("hits", none), F.coalesce("weighted", F.lit(0.0))
    substance = F.col("quantity_hits") + F.col("year_hits")
    return rows.select(
        "doc_id", "symbol", "doc_kind", n.alias("total_words"), short_doc(n).alias("short_doc"), hits.alias("buzzword_hits"), per_thousand(hits, n).alias("buzzwords_per_1000_words"),
        F.round(weighted, 1).alias("buzzword_score_weighted"), per_thousand(weighted, n).alias("weighted_per_1000_words"), F.coalesce("unique_terms", none).alias("unique_buzzwords"),
        *(F.coalesce(f"{x}_hits", none).alias(f"{x}_hits") for x in TIERS), *(per_thousand(F.coalesce(f"{x}_hits", none), n).alias(f"{x}_per_1000_words") for x in TIERS),
        "quantity_hits", "year_hits", substance.alias("substance_hits"), per_thousand(substance, n).alias("substance_per_1000_words"), ratio(hits, substance, 3).alias("buzzwords_per_substance_hit"),
    )


def percentile(rows: DataFrame, metric: str = "buzzwords_per_1000_words", tie: str = "doc_id") -> DataFrame:
    """rows with density_percentile: 100 * place / (n - 1), equal densities in order of tie; a single row has 0."""
    placed = ranked(rows, F.col(metric), F.col(tie))
    share = F.when(F.col("n_rows") > 1, F.round(F.lit(100.0) * F.col("place") / (F.col("n_rows") - 1), 1)).otherwise(F.lit(0.0))
    return placed.withColumn("density_percentile", share).drop("place", "n_rows")


def full_rows(docs: DataFrame, counted: DataFrame, terms: DataFrame, companies: DataFrame) -> DataFrame:
    """doc_rows with file, company (blank where unknown), top_terms and density_percentile, densest first; ties go by file.

    docs: as for doc_rows, with file; companies: symbol, company.
    """
    names = companies.select("symbol", F.col("company").alias("_company"))
    rows = doc_rows(docs, counted, terms).join(docs.select("doc_id", "file"), "doc_id").join(names, "symbol", "left").join(top_terms(counted, terms, "doc_id"), "doc_id", "left")
    rows = rows.withColumn("company", F.coalesce("_company", F.lit(""))).withColumn("top_terms", F.coalesce("top_terms", F.lit(""))).drop("_company")
    return percentile(rows, tie="file").orderBy(F.col("buzzwords_per_1000_words").desc(), "file")


def top_terms(counted: DataFrame, terms: DataFrame, by: str, k: int | None = TOP_DOC) -> DataFrame:
    """by, top_terms: 'label:hits; ...' of the k terms with most hits (all if k is None), equal counts in order of the lexicon."""
    if k is None:  # as many as the lexicon has at most
        t = counted.join(F.broadcast(terms.select("term_id", "label")), "term_id")
        t = t.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_k"), "term_id", "label", "n"))).alias("top"))
        return t.select(by, F.array_join(F.transform("top", lambda x: F.concat(x["label"], F.lit(":"), x["n"].cast("string"))), "; ").alias("top_terms"))
    order = Window.partitionBy(by).orderBy(F.col("n").desc(), "term_id")
    t = counted.join(F.broadcast(terms.select("term_id", "label")), "term_id").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    t = t.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_k", "label", "n"))).alias("top"))
    return t.select(by, F.array_join(F.transform("top", lambda x: F.concat(x["label"], F.lit(":"), x["n"].cast("string"))), "; ").alias("top_terms"))
