"""All queries of the library proper over the driver's tables.

documents play the corpus: a source is a company, a document a file, and its kind follows from source and language. A
suffix with a figure and a year, the same in every engine, exercises the counts of hard numbers. The lexicon is a small
one of the same shapes as a real one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflux.functions import html as H
from lexiflux.functions import text as X
from lexiflux.operators import company, kwic, match, overlap, scan, score, sparse, tally
from lexiflux.operators.lexicon import TIERS, Compiled, Term, terms_frame, usable, with_added
from lexiflux.plans import oracles
from lexiflux.plans.cluster import durable, spread
from lexiflux.plans.places import ranked

LEXICON = [
    Term("the", "puffery", "the"),
    Term("of the", "hedge", "of the"),
    Term("prep the", "corporate", "(?:in|on|to) the", weight=1.5),
    Term("for the", "esg_jargon", "for the"),
    Term("and", "puffery", "and"),
    Term("and the", "hedge", "and the"),
    Term("the of", "corporate", "the of"),
    Term("that", "esg_jargon", "(?<!of )that"),
    Term("with", "corporate", "with"),
    Term("of the (dup)", "esg_jargon", "of the"),
    Term("thing*", "puffery", "thing*", "plain"),
]
ADDED = ["the*", "with|from the"]
RESOLVED_QUERIES = ["src1", "SRC10", "company 7", "src3.example", "comp", "rc1", "ample", "zzz"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, symbol, doc_kind, file, norm. The texts are dealt out before anything is done to them."""
    return _normal(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without their texts, which are not read."""
    return _normal(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("norm")


def _normal(d: DataFrame) -> DataFrame:
    text = F.concat(F.col("text"), F.lit(" "), F.col("n_chars").cast("string"), F.lit(" tonnes in "), (F.lit(1990) + F.col("doc_id") % 60).cast("string"))
    kind = F.when(F.col("source").isin("src0", "src1", "src2", "src3"), "page").when(F.col("source") == "src4", "data").when(F.col("lang") == "en", "main").when(F.col("lang") == "de", "data").otherwise("page")
    d = d.select("doc_id", F.col("source").alias("symbol"), kind.alias("doc_kind"), X.normalise(text, composed=False).alias("norm"))
    return d.withColumn("file", F.concat("symbol", F.lit("__"), "doc_kind", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "symbol", "doc_kind", "file", *_measures())


def _measures() -> list[Column]:
    n = F.col("norm")
    return [X.word_count(n).alias("n_words"), X.quantity_count(n).alias("quantity_hits"), X.year_count(n).alias("year_hits")]


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "symbol", "doc_kind", X.tokens(F.col("norm")).alias("toks"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.vocabulary(tokenised(spark, sf_dir))


def compiled(spark: SparkSession, sf_dir: str, terms: list[Term]) -> Compiled:
    return usable(terms)


def raw_spans(spark: SparkSession, sf_dir: str, terms: list[Term] = LEXICON) -> DataFrame:
    found = usable(terms)  # before anything is read
    return match.spans(tokenised(spark, sf_dir), found)


def kept_spans(spark: SparkSession, sf_dir: str, terms: list[Term] = LEXICON) -> DataFrame:
    return overlap.resolve(raw_spans(spark, sf_dir, terms))


def counted(spark: SparkSession, sf_dir: str, terms: list[Term] = LEXICON) -> DataFrame:
    found = usable(terms)  # before anything is read
    return tally.unfolded(documents(spark, sf_dir).select("doc_id", tally.tally(spark, F.col("norm"), found).alias("terms")))


def stats_and_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """stats and counted of the same pass over the texts: what it finds is kept, a short row for each document."""
    terms = tally.tally(spark, F.col("norm"), usable(LEXICON)).alias("terms")
    both = durable(documents(spark, sf_dir).select("doc_id", "symbol", "doc_kind", "file", *_measures(), terms))
    return both.drop("terms"), tally.unfolded(both)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("symbol")).distinct()
    n = F.substring("symbol", 4, 9)
    return d.select("symbol", F.concat(F.lit("Company "), n).alias("company"), F.concat("symbol", F.lit(".example")).alias("website"), F.concat(F.lit("sector "), (n.cast("int") % 3).cast("string")).alias("sector"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.doc_rows(*stats_and_counts(spark, sf_dir), terms_frame(spark, LEXICON))


def _rollup(spark: SparkSession, sf_dir: str, sources: str = "auto") -> DataFrame:
    return company.rollup(*stats_and_counts(spark, sf_dir), terms_frame(spark, LEXICON), sources)


def term_density_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, hits = stats_and_counts(spark, sf_dir)
    hits = hits.groupBy("doc_id").agg(F.sum("n").alias("n"))
    rows = docs.join(hits, "doc_id", "left").groupBy("symbol").agg(F.sum("n_words").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
    return rows.select("symbol", "words", "hits", X.per_thousand(F.col("hits"), F.col("words")).alias("density")).orderBy(F.col("density").desc(), "symbol")


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir)


def token_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ranked(vocabulary(spark, sf_dir), F.col("corpus_freq").desc(), F.col("token"))
    return placed.select(F.col("place").alias("id"), "token", "corpus_freq")


def raw_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.counts(raw_spans(spark, sf_dir))


def resolved_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir)


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir)


def doc_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.percentile(_rows(spark, sf_dir).select("doc_id", "buzzwords_per_1000_words"))


def tier_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = counted(spark, sf_dir).join(F.broadcast(terms_frame(spark, LEXICON).select("term_id", "tier")), "term_id")
    return t.groupBy("doc_id").agg(*(score.tier_sum(x).alias(f"{x}_hits") for x in TIERS))


def doc_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.top_terms(counted(spark, sf_dir), terms_frame(spark, LEXICON), "doc_id", 3)


def company_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir).select("symbol", "top_terms")


def doc_full_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.full_rows(*stats_and_counts(spark, sf_dir), terms_frame(spark, LEXICON), companies(spark, sf_dir))


def company_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.all_terms(*stats_and_counts(spark, sf_dir), terms_frame(spark, LEXICON))


def _sources(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rollup(spark, sf_dir, policy)


def company_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.decorated(company.board(_rollup(spark, sf_dir), top=10), companies(spark, sf_dir)).select("symbol", "company", "website", "sector", "total_words", "buzzword_hits", "buzzwords_per_1000_words")


def board_metric_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the ratio to figures of at least a thousand characters' worth, of which many have none."""
    rows = _rows(spark, sf_dir)
    rare = F.nullif(F.floor(F.col("quantity_hits") * F.col("total_words") / 500), F.lit(0))
    value = F.round(F.col("buzzword_hits").cast("double") / rare, 3)
    return rows.select("doc_id", value.alias("per_figure")).orderBy(F.coalesce("per_figure", F.lit(-1)).desc(), "doc_id")


def lookup_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.lookup_rank(_rollup(spark, sf_dir)).select("symbol", "total_words", "buzzwords_per_1000_words", "rank", "of")


def resolve_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.resolve(companies(spark, sf_dir), RESOLVED_QUERIES)


def find_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raw_spans(spark, sf_dir, [Term("in|of the", "puffery", "in|of the", "plain")])
    return kwic.by_symbol(found, documents(spark, sf_dir), 15)


def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raw_spans(spark, sf_dir, [Term("of the", "puffery", "of the", "plain")])
    return kwic.concordance(found, tokenised(spark, sf_dir))


def wildcard_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.counts(raw_spans(spark, sf_dir, [Term("th*ing", "puffery", "th*ing", "plain"), Term("the|this th*", "puffery", "the|this th*", "plain")]))


def lookaround_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.counts(raw_spans(spark, sf_dir, [Term("a", "puffery", "(?<!of )(?<!and in )the"), Term("b", "puffery", "and(?! the)(?! of that)")]))


def added_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = with_added(LEXICON, ADDED)
    raw = raw_spans(spark, sf_dir, terms)
    return sparse.added_word_stats(raw, overlap.resolve(raw), terms_frame(spark, terms))


def quintile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.quintiles(_rollup(spark, sf_dir).where("total_words >= 2000"))


def scan_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each document by tokens and by scanning, over the terms that are regular expressions."""
    terms = [t for t in LEXICON if t.syntax == "regex"]
    n = F.col("norm")
    both = durable(documents(spark, sf_dir).select("doc_id", tally.tally(spark, n, usable(terms)).alias("indexed"), scan.scanned_counts(spark, n, terms).alias("scanned")))
    return scan.agreement(tally.unfolded(both, "indexed"), tally.unfolded(both, "scanned"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", H.clean_lines(H.stripped(F.col("html"))).alias("lines"))


def page_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "\n").alias("text"))


def page_dedup_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.without_navigation(_pages(spark, sf_dir), "page_id", "lines", 1)


def page_min_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.min_words(H.without_navigation(_pages(spark, sf_dir), "page_id", "lines")).select("page_id", "n_words", "too_short")


def page_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = H.page_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return H.without_navigation(parsed.select("page_id", H.clean_lines(F.col("text")).alias("lines")), "page_id", "lines")


def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = company.chosen(stats(spark, sf_dir))
    return sparse.term_vectors(kept_spans(spark, sf_dir), used, sparse.slots(used))


def unclaimed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = company.chosen(stats(spark, sf_dir))
    return sparse.word_vectors(tokenised(spark, sf_dir), kept_spans(spark, sf_dir), used, sparse.slots(used))


def todo_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files not in a cache that holds those of English documents."""
    d = names(spark, sf_dir).select("file")
    cache = names(spark, sf_dir).where("doc_kind = 'main'").select("file")
    return d.join(cache, "file", "left_anti")


def docs_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"))


def lexicon_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms_frame(spark, LEXICON).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        term_density_by_source, doc_stats, token_vocab, raw_term_hits, resolved_term_counts, doc_scores, doc_percentile, tier_pivot, doc_top_terms, company_top_terms, doc_full_rows, company_all_terms,
        company_board, board_metric_nulls, lookup_rank, resolve_company, find_by_symbol, concordance, wildcard_terms, lookaround_terms, added_word_stats, quintile, scan_agreement,
        page_clean_lines, page_dedup_nav, page_min_words, page_parsed, sparse_vectors, unclaimed_words, todo_antijoin, docs_by_kind, lexicon_tiers,
    )
}
QUERIES |= {f"sources_{p}": _sources(p) for p in company.SOURCES}
ORACLES: dict[str, str] = oracles.all_sql()
