"""Overlap resolution: leftmost, then longest, then first in the lexicon; every stretch of text counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The spans (key, start, end, len, term_id, and words where there are any) that are kept.

    Of the spans with one start only the first can be kept; the others go before anything is gathered. Spans fall into
    islands, between which nothing overlaps: a span starts one if no earlier span reaches past its start. Only inside an island is the greedy choice made, by a fold over its few spans; a document of many spans is
    many islands, so the fold stays linear.
    """
    order = Window.partitionBy(key).orderBy("start", F.col("len").desc(), "term_id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (reach.isNull() | (F.col("start") >= reach)).cast("int")).withColumn("_same", F.lag("start").over(order).eqNullSafe(F.col("start")))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("_same"))
    with_words = ["words"] if "words" in spans.columns else []
    islands = marked.groupBy(key, "_island").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("len")).alias("neg"), "term_id", "end", *with_words))).alias("s"))

    def choose(state, x):
        take = x["start"] >= state["upto"]
        return F.struct(F.when(take, x["end"]).otherwise(state["upto"]).alias("upto"), F.when(take, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"))

    empty = F.struct(F.lit(-1).alias("upto"), F.filter("s", lambda x: F.lit(False)).alias("kept"))
    kept = F.when(F.size("s") == 1, F.col("s")).otherwise(F.aggregate("s", empty, choose, lambda state: state["kept"]))
    out = islands.select(key, F.explode(kept).alias("x"))
    return out.select(key, "x.start", "x.end", (-F.col("x.neg")).alias("len"), "x.term_id", *(f"x.{w}" for w in with_words))
