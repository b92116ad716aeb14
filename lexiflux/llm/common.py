"""What the training-data operators share: folds, paths, shipping of code, durable intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflux.plans.cluster import durable, shared_dir, ship

__all__ = ["WORD", "durable", "fold", "in_parts", "one_label", "ship", "shared_dir", "spent", "stored", "table", "texts"]

#: Rows, and bytes on average, that a worker takes up at once: what it makes of them is several times as large.
PART_ROWS, PART_BYTES = 512, 2_000_000

#: One word: code points other than space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage with a compressed table in the checkpoint folder: for what is large or read by column."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexiflux_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read again: all that was made of them is stored itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._lexiflux_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker's memory depends neither on a batch's rows nor on its texts' mean length."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def fold(modulus: int, doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus


def texts(documents: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty ones: other columns, whatever their names, stay out of the way."""
    return documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, y: the largest non-null label of each id; rows without id or label are left out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
