"""The token index: documents with their tokens, and the vocabulary, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflux.functions import text as X
from lexiflux.operators.match import vocabulary
from lexiflux.plans.places import ranked


def build(docs: DataFrame, path: str, composed: bool = True, fixed: bool = False) -> None:
    """Writes docs_tokens and vocab under path. docs: file, text, symbol, doc_kind, doc_num and, if known, company.

    doc_id is a file's place in the order of files, so that equal scores rank in that order. The texts meet their ids in
    one join; the other shuffles are those of the vocabulary. Readers prune columns: statistics are read without tokens.
    """
    docs = docs.withColumn("company", F.col("company") if "company" in docs.columns else F.lit(""))
    ids = ranked(docs.select("file").distinct(), F.col("file")).select("file", F.col("place").alias("doc_id"))
    n = docs.join(ids, "file").withColumn("norm", X.normalise(F.col("text"), composed))
    norm = F.col("norm")
    out = n.select("doc_id", "file", "symbol", "company", "doc_kind", "doc_num", X.word_count(norm).alias("n_words"), X.quantity_count(norm, fixed).alias("quantity_hits"),
                   X.year_count(norm).alias("year_hits"), X.tokens(norm).alias("toks")).withColumn("n_tokens", F.size("toks"))
    out.write.mode("overwrite").parquet(f"{path}/docs_tokens")
    words = vocabulary(docs.sparkSession.read.parquet(f"{path}/docs_tokens"))
    ranked(words, F.col("corpus_freq").desc(), F.col("token")).select(F.col("place").alias("id"), "token", "corpus_freq").write.mode("overwrite").parquet(f"{path}/vocab")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents with tokens, and the vocabulary."""
    return spark.read.parquet(f"{path}/docs_tokens"), spark.read.parquet(f"{path}/vocab")
