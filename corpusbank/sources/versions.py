"""Versioned tables on shared storage: new data first, then one appended commit per change.

A store is a folder with one data folder per table, partitioned by version and key, and a log of
(key, version, seq).  A change writes the rows of its keys under a new version and then appends
its keys to the log in one Spark job; readers take the last version of every key from the log.
A change that fails before its log entry leaves files that nothing refers to, and the old version
as it was.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_store(spark: SparkSession, root: str, key: str) -> None:
    """An empty store whose key column is a ``key`` definition such as ``call_id long``."""
    spark.createDataFrame([], f"{key}, version string, seq long").write.mode("append").parquet(
        f"{root}/log")


def _log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/log")


def publish(tables: dict[str, DataFrame], root: str, key: str, keys: DataFrame,
            inner: tuple[str, ...] = ()) -> str:
    """Replace the rows of ``keys`` in all ``tables``; other keys keep their versions.

    A key without rows becomes empty.  ``inner`` names further partition columns, used by the
    tables that have them.
    """
    spark, version = keys.sparkSession, uuid.uuid4().hex
    for name, rows in tables.items():
        parts = [c for c in inner if c in rows.columns]
        rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy(
            "version", key, *parts).parquet(f"{root}/{name}")
    seq = (_log(spark, root).agg(F.max("seq")).first()[0] or 0) + 1  # one number
    keys.select(key).distinct().select(
        key, F.lit(version).alias("version"), F.lit(seq).cast("long").alias("seq")
    ).write.mode("append").parquet(f"{root}/log")
    return version


def published(spark: SparkSession, root: str, name: str, key: str, schema: str) -> DataFrame:
    """Current rows of a table; ``schema`` is the DDL of its columns, ``key`` included.

    The versions in use, one per key at most, become a filter on the partition column, so that
    the files of replaced versions are neither listed nor read.
    """
    last = _log(spark, root).groupBy(key).agg(F.max_by("version", "seq").alias("version"))
    used = sorted(r.version for r in last.select("version").distinct().collect())
    rows = spark.read.schema(f"{schema}, version string").parquet(f"{root}/{name}").filter(
        F.col("version").isin(used))
    return rows.join(last, ["version", key], "left_semi").drop("version")
