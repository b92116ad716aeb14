"""Sparse exports: for a term or word, the companies that use it and how often, as 'slot:count' in hexadecimal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflux.functions.text import hex_pairs
from lexiflux.plans.places import ranked

MIN_HITS = 4


def slots(used: DataFrame) -> DataFrame:
    """symbol, slot: the place of each company with a document that counts, in order of symbol."""
    return ranked(used.select("symbol").distinct(), F.col("symbol")).select("symbol", F.col("place").alias("slot"))


def _vectors(rows: DataFrame, by: str, name: str) -> DataFrame:
    """by, name: summed by company first, so that a word's group is as long as there are companies."""
    per = rows.groupBy(by, "slot").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(by).agg(hex_pairs(F.collect_list(F.struct("slot", "n"))).alias(name))


def term_vectors(kept: DataFrame, used: DataFrame, slot: DataFrame) -> DataFrame:
    """term_id, c over the kept spans of documents that count."""
    return _vectors(kept.join(used.join(slot, "symbol").select("doc_id", "slot"), "doc_id"), "term_id", "c")


def word_vectors(docs: DataFrame, kept: DataFrame, used: DataFrame, slot: DataFrame, min_hits: int = MIN_HITS) -> DataFrame:
    """token, c, n, overlap for words of 3 to 20 letters with at least min_hits in the corpus.

    c counts all places in documents that count, n those outside kept spans (null where all are), overlap the
    difference. docs: doc_id, symbol, doc_kind, toks; kept: with the words of each span. Words are counted by company in
    tasks first; no single place of a word is shuffled. Whether a document counts follows from its company and kind, of
    which there are few: that table is broadcast, so that tokens never travel to meet their company.
    """
    letters = F.col("token").rlike("^[a-z]{3,20}$")
    slotted = used.join(slot, "symbol").select("doc_id", "slot")
    counting = F.broadcast(used.select("symbol", F.col("doc_kind").alias("_kind")).distinct().join(slot, "symbol").withColumnRenamed("symbol", "_symbol"))
    of = (F.col("symbol") == F.col("_symbol")) & F.col("doc_kind").eqNullSafe(F.col("_kind"))
    # a document that does not count has no slot; its words count for how often a word occurs
    tokens = docs.select("symbol", "doc_kind", "toks").join(counting, of, "left").select("slot", F.explode_outer("toks").alias("token")).where(letters)
    all_ = tokens.groupBy("token", "slot").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("taken"))
    claimed = kept.select("doc_id", F.explode_outer("words").alias("token")).where(letters).join(slotted, "doc_id")
    claimed = claimed.groupBy("token", "slot").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("taken"))
    per = all_.unionByName(claimed).groupBy("token", "slot").agg(F.sum("n").alias("n"), F.sum("taken").alias("taken"))
    here = F.when(F.col("slot").isNotNull(), F.struct("slot", "n"))
    free = F.when(F.col("slot").isNotNull() & (F.col("n") > F.col("taken")), F.struct("slot", (F.col("n") - F.col("taken")).alias("n")))
    out = per.groupBy("token").agg(hex_pairs(F.collect_list(here)).alias("c"), hex_pairs(F.collect_list(free)).alias("free"), F.sum("taken").alias("overlap"), F.sum("n").alias("_all"), F.count("slot").alias("_slots"))
    return out.where((F.col("_all") >= min_hits) & (F.col("_slots") > 0)).select("token", "c", F.when(F.col("overlap") > 0, F.col("free")).alias("n"), "overlap")


def added_word_stats(raw: DataFrame, kept: DataFrame, terms: DataFrame, errors: dict[int, str] | None = None) -> DataFrame:
    """term, corpus_hits, new_hits, already_counted for each added word: all its occurrences, those it adds, and the rest.

    With the errors of the compiled terms there is a column error as well: why a word was left out, null where it was not.
    """
    mine = F.broadcast(terms.where("extra").select("term_id", F.col("label").alias("term")))
    found = raw.groupBy("term_id").agg(F.count(F.lit(1)).alias("corpus_hits"))
    new = kept.groupBy("term_id").agg(F.count(F.lit(1)).alias("new_hits"))
    rows = mine.join(found, "term_id", "left").join(new, "term_id", "left").fillna(0, ["corpus_hits", "new_hits"])
    why = []
    if errors is not None:
        said = F.lit(None).cast("string")
        for term, message in errors.items():
            said = F.when(F.col("term_id") == term, F.lit(message)).otherwise(said)
        why = [said.alias("error")]
    return rows.select("term", "corpus_hits", "new_hits", (F.col("corpus_hits") - F.col("new_hits")).alias("already_counted"), *why)
