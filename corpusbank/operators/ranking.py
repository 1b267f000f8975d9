"""Row numbers and running sums that do not put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbank.session import stage


def hash_order(*cols: Column) -> Column:
    """Reproducible pseudo-random order: md5 of the joined values."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def _laid_out(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` dealt out by (group.., order..) ranges taken from the data, sorted and staged.

    A group of any size spreads over many tasks.  ``_at`` numbers the rows inside ``_range``.
    """
    keys = [*group, *order]
    return stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id()), label
    ).withColumn("_range", F.shiftright("_at", 33))


def _shifted(laid: DataFrame, group: list[str], total: Column, first: Column) -> DataFrame:
    """Adds ``_shift``: the totals of the group's earlier ranges plus ``first``.

    Only one row per (range, group) is counted, summed up and joined back.
    """
    spans = laid.groupBy("_range", *group).agg(total.alias("_total"), first.alias("_first"))
    before = (
        Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    spans = spans.select(
        F.col("_range").alias("_r"), *[F.col(c).alias(f"_g_{c}") for c in group],
        (F.coalesce(F.sum("_total").over(before), F.lit(0)) + F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return laid.join(spans, same)


def range_numbers(df: DataFrame, group: list[str], order: list[str], name: str = "rn",
                  label: str = "numbered") -> DataFrame:
    """``row_number`` per group along ascending ``order`` (nulls first) by range partitions.

    ``order`` must be unique per group for a reproducible result.  A null group value is a
    group of its own; ``group=[]`` numbers the whole table.
    """
    laid = _laid_out(df, group, order, label)
    shifted = _shifted(laid, group, F.count(F.lit(1)), 1 - F.min("_at"))
    return shifted.withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)


def range_running_sum(df: DataFrame, group: list[str], order: list[str], value: str,
                      name: str = "running", label: str = "summed") -> DataFrame:
    """Inclusive running sum of a column per group, like :func:`range_numbers`."""
    laid = _laid_out(df, group, order, label)
    inside = (
        Window.partitionBy("_range", *group).orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    shifted = _shifted(laid, group, F.sum(value), F.lit(0))
    return shifted.withColumn(name, F.sum(value).over(inside) + F.col("_shift")).select(
        *df.columns, name)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int,
          name: str = "rn") -> DataFrame:
    """First k rows per group; the literal bound prunes each task before the shuffle."""
    if k < 1:
        raise ValueError("k must be positive")
    window = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= F.lit(k))
    )
