"""Intermediate tables in the folder the cluster names for checkpoints.

Loops cut their lineage by writing a Parquet table there and reading it back:
the table survives the loss of any executor, keeps column pruning, and its size
on disk lets the optimizer choose join strategies from facts.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder; a local temporary one only for local sessions."""
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="surveyloom-")
    spark.conf.set(_SETTING, root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/surveyloom/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and return the stored table.

    The row count is observed during the write and kept as ``.stored_rows``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_rows = seen.get["rows"]
    stored.stored_path = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more."""
    for table in tables:
        path = getattr(table, "stored_path", None)
        if path is not None:
            jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver's JVM collect garbage: Spark deletes the shuffle files of finished plans once it finds them unreferenced."""
    spark._jvm.System.gc()


def row_count(df: DataFrame) -> int:
    """Rows of a table, for free when it was materialized."""
    stored = getattr(df, "stored_rows", None)
    return df.count() if stored is None else stored
