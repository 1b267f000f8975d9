"""Table maintenance on immutable files: upserts, replacement, constraints.

Each function returns the new content; :func:`replace_partitions` and
:func:`write_version` put it on storage without overwriting what is being read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbank.session import new_path


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or update: the newest row of a key replaces the stored one."""
    rest = [c for c in new.columns if c not in keys]
    latest = new.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*")
    kept = old.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(new rows.., status): 'inserted' for the first row of an unknown key, else 'existing'."""
    # ``order`` is unique per key; it may repeat over keys.
    first = new.groupBy(*keys).agg(F.min(order).alias("_order")).join(
        old, keys, "left_anti").select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_order",
            F.lit(True).alias("_first"))
    same = F.col(order) == F.col("_order")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return new.join(first, same, "left").drop("_order", *[f"_k{i}" for i in range(len(keys))]).withColumn(
        "status", F.when(F.col("_first"), "inserted").otherwise("existing")).drop("_first")


def replace_children(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """All children of every parent present in ``new`` are replaced."""
    gone = new.select(*parent).distinct()
    return old.join(gone, parent, "left_anti").unionByName(new)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Dynamic overwrite: only the partitions present in ``df`` are rewritten."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def write_version(df: DataFrame, label: str) -> str:
    """Write a new version of a table to a fresh path and return it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def guarded_update(old: DataFrame, updates: DataFrame, key: str, state: str, expected: str,
                   columns: list[str]) -> DataFrame:
    """Update only rows still in the expected state; adds ``updated``."""
    u = updates.select(key, F.lit(True).alias("_u"),
                       *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = old.join(u, key, "left").withColumn(
        "updated", F.col("_u").isNotNull() & F.coalesce(F.col(state) == expected, F.lit(False)))
    return joined.select(*[
        F.when(F.col("updated"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c) for c in old.columns
    ], "updated")


def delete_cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children without those of the deleted parents."""
    return children.join(deleted.select(key), key, "left_anti")


def set_null_on_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children keep their row; the reference to a deleted parent becomes null."""
    gone = deleted.select(key, F.lit(True).alias("_gone")).distinct()
    return children.join(gone, key, "left").select(*[
        F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == key else F.col(c)
        for c in children.columns
    ])


def unique_violations(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(rule, key, n): one row per repeated key; a key with a null part may repeat."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit(name).alias("rule"), key.alias("key"), "n")


def check_violations(df: DataFrame, condition: Column, keys: list[str], name: str) -> DataFrame:
    """(rule, key, n): rows that break a CHECK or NOT NULL condition, counted per key."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    return df.filter(~F.coalesce(condition, F.lit(False))).groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "key", "n")


def foreign_key_violations(df: DataFrame, parent: DataFrame, keys: list[str], name: str
                           ) -> DataFrame:
    """(rule, key, n): missing parents; the child side is counted before it is joined."""
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    return counts.join(parent.select(*keys), keys, "left_anti").select(
        F.lit(name).alias("rule"), key.alias("key"), "n")


def all_violations(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def next_numbers(existing: DataFrame, requests: DataFrame, key: str, number: str = "number"
                 ) -> DataFrame:
    """(key, next): highest number of the key plus one, 1 for a key without rows."""
    top = existing.groupBy(key).agg(F.max(number).alias("_max"))
    return requests.select(key).distinct().join(top, key, "left").select(
        key, (F.coalesce("_max", F.lit(0)) + 1).alias("next"))
