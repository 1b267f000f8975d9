"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "corpusbank", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC; the cluster decides everything else."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_master(master: str) -> bool:
    """True for a master that runs everything in this process (``local``, ``local[4]``)."""
    return master == "local" or master.startswith("local[")


def work_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local session may do without (tests, trial runs): it gets a temporary folder.  On
    a cluster executors and driver do not share such a folder, so the setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not local_master(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="corpusbank-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the work folder, grouped by application for later clean-up."""
    app = spark.sparkContext.applicationId
    return os.path.join(work_dir(spark), "corpusbank", app, f"{label}-{uuid.uuid4().hex}")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    It cuts the lineage (a lost executor never recomputes it), is computed once however
    often it is used, and gives the planner its exact size: a join with it becomes a
    broadcast join only when it is below ``spark.sql.autoBroadcastJoinThreshold`` and
    stays a shuffle join (with adaptive skew handling) otherwise.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer splits than the session has cores out to all of them.

    The same rule for every master; a table of many splits is read as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def clear_staged(spark: SparkSession) -> None:
    """Remove this application's staged tables; call it when its results have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(
        os.path.join(work_dir(spark), "corpusbank", spark.sparkContext.applicationId))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
