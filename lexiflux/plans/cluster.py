"""What plans need of the cluster: code on the executors, and a folder that all of them share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "spark.lexiflux.shipped"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per context, so that workers can import it from any directory."""
    sc = spark.sparkContext
    if sc.getLocalProperty(_SHIPPED):
        return
    package = Path(__file__).resolve().parent.parent
    own = tempfile.mkdtemp(prefix="lexiflux-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)  # executors may fetch it until the driver ends
    out = Path(own) / "lexiflux_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(out))
    sc.setLocalProperty(_SHIPPED, "1")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints", "lexiflux"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly where one of its partitions holds over twice its share of the rows; the rows must lie in files.

    A file's row group is read by one task, however large it is, and what follows on its rows would stay in that task. Rows
    go by their place in the files, whatever their ids. To count them no column is read. As executors may come late, four
    cores are presumed at least.
    """
    spark = df.sparkSession
    rows = [r["count"] for r in df.select(F.spark_partition_id().alias("_part")).groupBy("_part").count().collect()]
    cores = max(4, spark.sparkContext.defaultParallelism)
    if max(rows, default=0) * cores <= 2 * sum(rows):
        return df
    return df.withColumn("_place", F.monotonically_increasing_id()).repartition(8 * cores, "_place").drop("_place")
