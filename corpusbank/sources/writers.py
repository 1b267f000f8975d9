"""Writers: parent/child tables, incident reports, cost log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbank.constants import BUNDLE, RECORD
from corpusbank.operators.ranking import range_numbers


def assign_ids(new: DataFrame, existing: DataFrame | None, order: list[str],
               id_col: str = "id") -> DataFrame:
    """Surrogate ids after the highest stored id, in the given order."""
    numbered = range_numbers(new, [], order, "_rn")
    if existing is None:
        base = F.lit(0)
    else:
        base = F.coalesce(existing.agg(F.max(id_col)).scalar(), F.lit(0))
    return numbered.withColumn(id_col, (F.col("_rn") + base).cast("long")).drop("_rn")


def write_parent_child(items: DataFrame, path: str, batch: str) -> None:
    """Write one batch of questions with their options, both or neither.

    Parents and children lie in the rows of one table and are committed together; a batch that
    is written again replaces itself, so a retry doubles nothing.
    """
    items.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_parents(spark: SparkSession, path: str, options: str = "options") -> DataFrame:
    """Questions of all batches."""
    return spark.read.parquet(path).drop(options)


def read_children(spark: SparkSession, path: str, id_col: str, options: str = "options") -> DataFrame:
    """(id, letter, text): options of the questions of all batches."""
    return spark.read.parquet(path).select(id_col, F.explode(options).alias("letter", "text"))


def write_reports(reports: DataFrame, path: str, source: str) -> None:
    """One JSON document per row, partitioned by source; the sources written replace themselves."""
    (reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(source).json(path))


def incident_reports(outcomes: DataFrame, source: str, order: str, summary: Column,
                     incidents: Column, fields: list[str], most: int = 500) -> DataFrame:
    """(source, page, pages, summary, incidents): nested reports of outcomes, in documents.

    ``summary`` is an aggregate per source, ``incidents`` tells which outcomes are listed with
    their ``fields``, by ``order``.  A document lists ``most`` of them at most; a source with more
    has several pages, one without any a single page with an empty list.
    """
    totals = outcomes.groupBy(source).agg(
        summary.alias("summary"),
        F.greatest(F.ceil(F.count_if(incidents) / most), F.lit(1)).cast("long").alias("pages"))
    listed = range_numbers(outcomes.filter(incidents).select(source, *fields), [source], [order],
                           "place", "incidents")
    paged = listed.groupBy(source, F.floor((F.col("place") - 1) / most).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("place", *fields))).alias("incidents"))
    pages = totals.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)))
    kind = paged.schema["incidents"].dataType
    return pages.join(paged, [source, "page"], "left").withColumn(
        "incidents", F.coalesce("incidents", F.array().cast(kind)))


def append_cost_log(costs: DataFrame, path: str) -> None:
    """Append model calls to the CSV log (each part file has its header)."""
    costs.write.mode("append").option("header", True).csv(path)


def write_bundles(rows: DataFrame, path: str, name: str, text: str, most: int = BUNDLE) -> None:
    """Append texts to a folder as bundles of ``most`` texts a file at most.

    A text stands behind ``RECORD`` and a line with its name and ends with a line feed, as a text file
    of its own would; it must not hold ``RECORD``.  Small texts as files of their own take more
    time to create and to list than to read.
    """
    (rows.select(F.concat(F.lit(RECORD), F.col(name).cast("string"), F.lit("\n"), text))
     .write.mode("append").option("maxRecordsPerFile", most).text(path))


def write_files(rows: DataFrame, path: str, name: str, text: str) -> None:
    """Append every text, by its unique name, as a file of its own in a folder ``name=..`` below the path.

    A file takes time to create, whatever it holds, so the texts go to tasks for all cores however small
    they are.
    """
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    rows.select(name, text).repartition(tasks, name).write.mode("append").partitionBy(name).text(path)
