"""find and concordance: where a term occurs, before overlaps are resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflux.functions.text import BARRIER
from lexiflux.plans.places import ranked

WIDTH = 9


def by_symbol(spans: DataFrame, docs: DataFrame, top: int | None = None) -> DataFrame:
    """symbol, hits over all documents, most first."""
    rows = spans.join(docs.select("doc_id", "symbol"), "doc_id").groupBy("symbol").agg(F.count(F.lit(1)).alias("hits"))
    return rows if top is None else rows.orderBy(F.col("hits").desc(), "symbol").limit(top)


def concordance(spans: DataFrame, docs: DataFrame, limit: int = 20, width: int = WIDTH) -> DataFrame:
    """doc_id, start, before, hit, after of every step-th hit, the first `limit` of them; a barrier shows as a middle dot.

    Only the chosen hits meet their document's tokens again. docs: doc_id, toks.
    """
    if limit <= 0:
        raise ValueError("limit is at least 1")
    placed = ranked(spans.select("doc_id", "start", "len", "term_id"), F.col("doc_id"), F.col("start"), F.col("len"), F.col("term_id"))
    step = F.greatest(F.lit(1), F.floor(F.col("n_rows") / limit))
    picked = placed.where((F.col("place") % step == 0) & (F.col("place") < step * limit)).select("doc_id", "start", "len")
    rows = docs.select("doc_id", "toks").join(F.broadcast(picked), "doc_id")  # at most limit rows

    def words(first, n):
        return F.array_join(F.transform(F.slice("toks", first, n), lambda t: F.when(t == BARRIER, "·").otherwise(t)), " ")

    start, n_before = F.col("start"), F.least(F.col("start"), F.lit(width))
    return rows.select("doc_id", "start", words(start - n_before + 1, n_before).alias("before"), words(start + 1, F.col("len")).alias("hit"), words(start + F.col("len") + 1, F.lit(width)).alias("after"))
