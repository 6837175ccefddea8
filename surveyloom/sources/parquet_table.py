"""Parquet load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surveyloom.sources.csv_table import audit_table


def read_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A Parquet table with its own types, and its audit."""
    table = spark.read.parquet(path)
    return table, audit_table(table)


def dealt_out(scan: DataFrame) -> DataFrame:
    """Spread a table stored in fewer splits than there are cores over all of them.

    Worth its small shuffle before heavy work per cell. ``scan`` is a plain
    table scan; a table of many splits is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
