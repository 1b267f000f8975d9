"""Duplicates by fingerprint, incremental gates and import labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each key; ``order`` must be unique.

    The winners come from a map-side combined ``min`` and are matched on the unique order
    column, so a key shared by a third of all rows never meets in one task.
    """
    winners = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return df.join(winners, order, "left_semi")


def first_ids(df: DataFrame, key: str, id_col: str, name: str = "first_id") -> DataFrame:
    """Fingerprint -> smallest id."""
    return df.groupBy(key).agg(F.min(id_col).alias(name))


def unseen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return df.join(known.select(key), key, "left_anti")


def label_import(records: DataFrame, existing: DataFrame, *, order: str, key: str,
                 error: str, batch: list[str] | None = None,
                 existing_id: str = "first_id") -> DataFrame:
    """Adds ``label`` and ``existing_id``: error, stored duplicate, batch duplicate or new.

    ``existing`` has one row per fingerprint (see :func:`first_ids`); ``order`` is unique.
    ``records`` is read twice: stage it when the fingerprint is costly.
    """
    batch = batch or []
    good = records.filter(F.col(error).isNull())
    firsts = (
        good.groupBy(*batch, key).agg(F.min(order).alias(order))
        .select(order, F.lit(True).alias("_first"))
    )
    # records without a key get one of their own: nulls would all meet in one task
    own = F.coalesce(F.col(key), F.concat(F.lit("-"), F.col(order).cast("string")))
    marked = records.withColumn("_key", own).join(firsts, order, "left").join(
        existing.select(F.col(key).alias("_key"), F.col(existing_id).alias("existing_id")),
        "_key", "left",
    )
    label = (
        F.when(F.col(error).isNotNull(), "ERROR_EXTRACCION")
        .when(F.col("existing_id").isNotNull(), "DUPLICADA_BD")
        .when(F.col("_first"), "NUEVA")
        .otherwise("DUPLICADA_LOTE")
    )
    return marked.withColumn("label", label).withColumn(
        "existing_id", F.when(F.col("label") == "DUPLICADA_BD", F.col("existing_id"))
    ).drop("_first", "_key")


def import_summary(labelled: DataFrame, batch: list[str], state: Column) -> DataFrame:
    """Counts per file: processed, imported, errors, duplicates and states of the new ones."""
    new = F.col("label") == "NUEVA"
    return labelled.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(new).alias("imported"),
        F.count_if(F.col("label") == "ERROR_EXTRACCION").alias("errors"),
        F.count_if(F.col("label").startswith("DUPLICADA")).alias("duplicates"),
        F.count_if(new & (state == "VALIDADA")).alias("validated"),
        F.count_if(new & (state == "A_REVISAR")).alias("review"),
        F.count_if(new & (state == "RECHAZADA")).alias("rejected"),
    )


def change_state(configured: DataFrame, stored: DataFrame, name: str, *, force: bool = False
                 ) -> DataFrame:
    """(name, state) of the documents to process: NUEVO, SIN_TEXTO, MODIFICADO (if forced)."""
    joined = configured.join(
        stored.select(
            name, F.col("hash").alias("stored_hash"),
            (F.trim(F.coalesce("text", F.lit(""))) != "").alias("has_text"),
        ), name, "left",
    )
    state = F.when(F.col("has_text").isNull(), "NUEVO").when(~F.col("has_text"), "SIN_TEXTO")
    if force:
        state = state.when(F.col("hash") != F.col("stored_hash"), "MODIFICADO")
    return joined.withColumn("state", state).filter("state IS NOT NULL").select(name, "state")
