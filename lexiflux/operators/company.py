"""Companies: which documents count, rollups, boards, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflux.functions.text import per_thousand, ratio
from lexiflux.operators.lexicon import TIERS
from lexiflux.operators.score import top_terms, totals
from lexiflux.plans.places import ranked

METRICS = ("buzzwords_per_1000_words", "buzzword_hits", "weighted_per_1000_words", "unique_buzzwords", "buzzwords_per_substance_hit", "total_words")
SOURCES = ("auto", "reports", "pages", "main", "all")
TOP_COMPANY, MIN_WORDS = 15, 2000


def chosen(docs: DataFrame, sources: str = "auto") -> DataFrame:
    """The documents that a company is scored on. docs: symbol, doc_kind, ...

    auto (and any other name) takes a company's reports, or its pages where it has none. Every kind but 'page' is a report.
    """
    page = F.col("doc_kind") == "page"
    if sources == "all":
        return docs
    if sources in ("reports", "pages", "main"):
        return docs.where({"reports": ~page, "pages": page, "main": F.col("doc_kind") == "main"}[sources])
    reporting = docs.where(~page).groupBy("symbol").agg(F.lit(True).alias("_reports"))
    return docs.join(reporting, "symbol", "left").where(F.col("_reports").isNull() | ~page).drop("_reports")


def rollup(docs: DataFrame, counted: DataFrame, terms: DataFrame, sources: str = "auto") -> DataFrame:
    """One row for each company with a chosen document; ratios are of sums.

    docs: doc_id, symbol, doc_kind, file, n_words, quantity_hits, year_hits. files and doc_kinds are joined by '; '.
    """
    kinds = chosen(docs.groupBy("symbol", "doc_kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("total_words"), F.sum(F.col("quantity_hits") + F.col("year_hits")).alias("substance_hits")), sources)
    base = kinds.groupBy("symbol").agg(
        *(F.sum(c).alias(c) for c in ("n_docs", "total_words", "substance_hits")), F.array_join(F.array_sort(F.collect_set("doc_kind")), "; ").alias("doc_kinds"),
    )
    by_term = _by_term(docs, counted, kinds)
    rows = base.join(totals(by_term, terms, "symbol"), "symbol", "left").join(top_terms(by_term, terms, "symbol", TOP_COMPANY), "symbol", "left")
    n, none = F.col("total_words"), F.lit(0)
    hits, weighted = F.coalesce("hits", none), F.coalesce("weighted", F.lit(0.0))
    return rows.select(
        "symbol", "n_docs", "doc_kinds", n, hits.alias("buzzword_hits"), per_thousand(hits, n).alias("buzzwords_per_1000_words"), F.round(weighted, 1).alias("buzzword_score_weighted"),
        per_thousand(weighted, n).alias("weighted_per_1000_words"), F.coalesce("unique_terms", none).alias("unique_buzzwords"), F.coalesce("extra_hits", none).alias("extra_hits"),
        per_thousand(F.coalesce("extra_hits", none), n).alias("extra_per_1000_words"), "substance_hits", ratio(hits, F.col("substance_hits"), 2).alias("buzzwords_per_substance_hit"),
        *(per_thousand(F.coalesce(f"{x}_hits", none), n).alias(f"{x}_per_1000_words") for x in TIERS), F.coalesce("top_terms", F.lit("")).alias("top_terms"),
    )


def _by_term(docs: DataFrame, counted: DataFrame, kinds: DataFrame) -> DataFrame:
    """symbol, term_id, n over the documents of the chosen kinds (symbol, doc_kind, one row each) of a company.

    Hits are summed for each kind before kinds are chosen: so documents are dealt by id only, not by a company that may have
    most of them. Those without a symbol have no sum.
    """
    n = counted.join(docs.select("doc_id", "symbol", "doc_kind"), "doc_id").groupBy("symbol", "doc_kind", "term_id").agg(F.sum("n").alias("n"))
    kinds = kinds.select(F.col("symbol").alias("_symbol"), F.col("doc_kind").alias("_kind"))
    used = n.join(kinds, (F.col("symbol") == F.col("_symbol")) & F.col("doc_kind").eqNullSafe(F.col("_kind")), "left_semi")
    return used.groupBy("symbol", "term_id").agg(F.sum("n").alias("n"))


def all_terms(docs: DataFrame, counted: DataFrame, terms: DataFrame, sources: str = "auto") -> DataFrame:
    """symbol, all_terms: every term that a company's chosen documents use, with its hits, most first."""
    kinds = chosen(docs.select("symbol", "doc_kind").distinct(), sources)
    found = top_terms(_by_term(docs, counted, kinds), terms, "symbol", None)
    return kinds.select("symbol").distinct().join(found, "symbol", "left").select("symbol", F.coalesce("top_terms", F.lit("")).alias("all_terms"))


def files(docs: DataFrame, sources: str = "auto") -> DataFrame:
    """symbol, file of the documents that count, one row each: a company's list is never gathered in one place."""
    return chosen(docs, sources).select("symbol", "doc_id", "file")


def decorated(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """rows with company, website and sector of the table of companies (symbol, company, website, sector), blank where unknown."""
    blank = F.lit("")
    dim = companies.select("symbol", *(F.col(c).alias(f"_{c}") for c in ("company", "website", "sector")))
    return rows.join(dim, "symbol", "left").withColumns({c: F.coalesce(f"_{c}", blank) for c in ("company", "website", "sector")}).drop("_company", "_website", "_sector")


def board(rows: DataFrame, metric: str = METRICS[0], top: int = 25, min_words: int = MIN_WORDS, reverse: bool = False) -> DataFrame:
    """The top companies by a metric among those with enough words; a missing ratio counts as -1. Equal ones go by symbol."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    value = F.coalesce(metric, F.lit(-1))
    return rows.where(F.col("total_words") >= min_words).orderBy(value.asc() if reverse else value.desc(), "symbol").limit(top)


def lookup_rank(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rows with rank among companies with enough words, by density; null for the others. of: how many are ranked."""
    enough = rows.where(F.col("total_words") >= min_words)
    places = ranked(enough.select("symbol", "buzzwords_per_1000_words"), F.col("buzzwords_per_1000_words").desc(), F.col("symbol"))
    return rows.join(places.select("symbol", (F.col("place") + 1).alias("rank"), F.col("n_rows").alias("of")), "symbol", "left")


def fit(query: Column, symbol: Column, company: Column, website: Column) -> Column:
    """How well a company fits a query, 0 best, 99 not at all: by ticker, site or name, then their beginnings, then parts."""
    q = F.lower(F.trim(query))
    sym, name, site = (F.lower(F.coalesce(c, F.lit(""))) for c in (symbol, company, website))
    return (F.when(sym == q, 0).when(site == q, 1).when(name == q, 2).when(sym.startswith(q), 3).when(name.startswith(q) | site.startswith(q), 4)
             .when(F.contains(name, q) | F.contains(site, q), 5).otherwise(99))


def resolve(companies: DataFrame, queries: list[str]) -> DataFrame:
    """query, symbol, fit: the company each query means, the first by symbol among equals; queries without one are left out."""
    asked = companies.withColumn("query", F.explode(F.array(*map(F.lit, queries))))
    rows = asked.select("query", "symbol", fit(F.col("query"), F.col("symbol"), F.col("company"), F.col("website")).alias("fit")).where("fit < 99")
    best = rows.groupBy("query").agg(F.min(F.struct("fit", "symbol")).alias("best"))  # summed in tasks first
    return best.select("query", "best.symbol", "best.fit")


def quintiles(rows: DataFrame, metric: str = METRICS[0]) -> DataFrame:
    """symbol, quintile: five equal fifths by density, 1 the plainest; with a remainder the first fifths have one more."""
    placed = ranked(rows.select("symbol", metric), F.col(metric), F.col("symbol"))
    size, extra = F.floor(F.col("n_rows") / 5), F.col("n_rows") % 5
    long = extra * (size + 1)
    fifth = F.when(F.col("place") < long, F.floor(F.col("place") / (size + 1))).otherwise(extra + F.floor((F.col("place") - long) / F.greatest(size, F.lit(1))))
    return placed.select("symbol", metric, (fifth + 1).cast("int").alias("quintile"))


def best_capture(captures: DataFrame) -> DataFrame:
    """The richest of a stem's captures: most words, then the first file name. captures: stem, file, n_words, ..."""
    order = Window.partitionBy("stem").orderBy(F.col("n_words").desc(), "file")
    return captures.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
