"""A stream of documents into counts and densities, exactly once for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiflux.functions import text as X
from lexiflux.operators.lexicon import Compiled
from lexiflux.operators.match import spans
from lexiflux.operators.overlap import resolve
from lexiflux.operators.score import counts


def scores(docs: DataFrame, compiled: Compiled, composed: bool = True) -> DataFrame:
    """doc_id, n_words, hits, density of a batch of documents (doc_id, text)."""
    n = docs.select("doc_id", X.normalise(F.col("text"), composed).alias("norm"))
    hits = counts(resolve(spans(n.select("doc_id", X.tokens(F.col("norm")).alias("toks")), compiled))).groupBy("doc_id").agg(F.sum("n").alias("hits"))
    rows = n.select("doc_id", X.word_count(F.col("norm")).alias("n_words")).join(hits, "doc_id", "left")
    h = F.coalesce("hits", F.lit(0))
    return rows.select("doc_id", "n_words", h.alias("hits"), X.per_thousand(h, F.col("n_words")).alias("density"))


def stream(spark: SparkSession, folder: str, out: str, checkpoint: str, compiled: Compiled, once: bool = True) -> StreamingQuery:
    """Scores Parquet documents (doc_id, text) that arrive in a folder. Each batch overwrites a partition of its own number, so that a repeated batch changes nothing."""
    arriving = spark.readStream.schema("doc_id long, text string").parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        scores(batch, compiled).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
