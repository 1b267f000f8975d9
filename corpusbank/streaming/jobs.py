"""Structured Streaming jobs: import new questions, classify pending ones.

Uniqueness is for ever, so it is not kept in stream state: each micro-batch is compared with the
bank table, of which only the partitions of its fingerprints' prefixes are read.  A batch writes to
partitions of its own (overwritten when the batch is replayed), which makes the sinks idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbank.operators import search
from corpusbank.session import stage
from corpusbank.sources import versions


PREFIX = 2  # characters of a fingerprint that name its partition of the bank


def create_bank(spark: SparkSession, path: str, first: DataFrame | None = None) -> None:
    """A bank (id, fp) partitioned by fingerprint prefix and batch; ``first`` are its first rows."""
    rows = spark.createDataFrame([], "id long, fp string") if first is None else first
    _write_bank(rows.select("id", "fp"), path, -1)


def _write_bank(rows: DataFrame, path: str, batch_id: int) -> None:
    (rows.withColumn("prefix", F.left("fp", F.lit(PREFIX)))
     .withColumn("batch", F.lit(batch_id).cast("long")).repartition("prefix")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("prefix", "batch").parquet(path))


def stored_questions(spark: SparkSession, path: str, fingerprints: DataFrame, batch_id: int
                     ) -> DataFrame:
    """(id, fp) of the bank for the given fingerprints, as it was before the batch.

    The prefixes of a batch, ``16 ** PREFIX`` at most, become a filter on the partition
    column: other partitions are not listed or read.  Rows of the batch itself and of later ones
    do not count, so that a replay sees the same state.
    """
    wanted = fingerprints.select(F.left("fp", F.lit(PREFIX)).alias("p")).distinct()
    prefixes = sorted(r.p for r in wanted.collect() if r.p)
    schema = "id long, fp string, prefix string, batch long"
    bank = spark.read.schema(schema).parquet(path).filter(
        F.col("prefix").isin(prefixes) & (F.col("batch") < batch_id))
    return bank.join(fingerprints.select("fp").distinct(), "fp", "left_semi").select("id", "fp")


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def import_batch(batch: DataFrame, batch_id: int, bank_path: str, out_path: str,
                 fingerprinted: Callable[[DataFrame], DataFrame],
                 importer: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Label, validate and store one batch of raw questions; a replay changes nothing.

    ``fingerprinted`` adds ``fp`` to raw rows (pos, ..), ``importer`` takes the batch and the
    stored questions (id, fp) and returns (pos, label, ..).  The batch is staged once.
    """
    raw = stage(fingerprinted(batch), "import-batch")
    stored = stored_questions(batch.sparkSession, bank_path, raw.filter("fp IS NOT NULL"), batch_id)
    outcome = stage(importer(raw, stage(stored, "import-stored")), "import-outcome")
    new = outcome.filter("label = 'NUEVA'").select("pos").join(raw.select("pos", "fp"), "pos")
    _write_bank(new.select(F.col("pos").alias("id"), "fp"), bank_path, batch_id)
    _write_batch(outcome, out_path, batch_id)


def import_stream(source: DataFrame, bank_path: str, out_path: str, checkpoint: str, *,
                  fingerprinted: Callable[[DataFrame], DataFrame],
                  importer: Callable[[DataFrame, DataFrame], DataFrame]):
    """Start the import of everything available (see :func:`import_batch`).

    The bank path must exist (see :func:`create_bank`).
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        import_batch(batch, batch_id, bank_path, out_path, fingerprinted, importer)

    return (
        source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def store_index(root: str, name: str, docs: DataFrame, doc_id: str, part: list[str]) -> str:
    """Store an inverted index of document terms as the next version of ``name``."""
    spark = docs.sparkSession
    tables = {n: rows.withColumn("name", F.lit(name))
              for n, rows in search.index_tables(docs, doc_id, part).items()}
    keys = spark.range(1).select(F.lit(name).alias("name"))
    return versions.publish(tables, root, "name", keys, ("bucket",))


def stored_ranker(spark: SparkSession, root: str, name: str, *, doc_id: str, query_id: str,
                  part: str, query_text: str = "text", within: DataFrame | None = None):
    """Ranker over the stored index (see ``plans.classify``): the version current at the call.

    ``part`` is the DDL of the index' part columns.  ``within`` holds values of some of them: the
    ranker then knows the documents with these only, as an index of their own would.
    """
    def table(which: str, columns: str) -> DataFrame:
        rows = versions.published(spark, root, which, "name", f"{columns}, {part}, name string")
        rows = rows.filter(F.col("name") == name).drop("name")
        return rows if within is None else rows.join(within, within.columns, "left_semi")

    def ranked(questions: DataFrame, parts: list[str]) -> DataFrame:
        found = search.ranked_from_index(
            table("postings", f"{doc_id} long, dl int, tok string, tf int, bucket int"),
            table("sizes", "n long, words long"), questions, doc_id=doc_id, query_id=query_id,
            query_text=query_text, part=parts)
        return found.withColumnRenamed(doc_id, "candidate_id")
    return ranked


def classify_stream(source: DataFrame, out_path: str, checkpoint: str,
                    classify: Callable[[DataFrame], DataFrame]):
    """Start the classification of pending rows: every micro-batch goes through ``classify``.

    The batch is staged once, as a cascade reads it for every branch.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        _write_batch(classify(stage(batch, "pending")), out_path, batch_id)

    return (
        source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
