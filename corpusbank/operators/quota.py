"""Quota-based stratified drawing of exams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbank.constants import INFORMATICS
from corpusbank.operators.ranking import top_k


def largest_remainder(counts: DataFrame, targets: DataFrame, block: str = "block",
                      topic: str = "topic", n: str = "n") -> DataFrame:
    """(block, topic, n, quota): counts scaled to the target of their block.

    Integer remainders, so exact ties keep topic order.  ``counts`` is already aggregated
    (one row per block and topic).
    """
    in_block = Window.partitionBy(block)
    scaled = counts.join(targets.select(block, "target"), block).withColumn(
        "_total", F.sum(n).over(in_block))
    product = F.col(n) * F.col("target")
    scaled = scaled.withColumn("_floor", F.floor(product / F.col("_total")).cast("long"))
    scaled = scaled.withColumn("_rest", product % F.col("_total")).withColumn(
        "_left", F.col("target") - F.sum("_floor").over(in_block))
    place = F.row_number().over(in_block.orderBy(F.col("_rest").desc(), F.col(topic)))
    return scaled.withColumn(
        "quota", F.col("_floor") + F.when(place <= F.col("_left"), 1).otherwise(0)
    ).select(block, topic, n, "quota")


def ranked_strata(bank: DataFrame, quotas: DataFrame, *, block: str, topic: str, order: Column,
                  bound: int) -> DataFrame:
    """Bank rows numbered inside (block, topic) with their quota.

    Only the first ``bound`` rows of a stratum are kept: the number that the draw can need,
    taken from the quotas, so that nothing is missing and each task prunes before the shuffle.
    """
    wanted = bank.join(quotas.select(block, topic, "quota"), [block, topic])
    return top_k(wanted, [block, topic], [order], bound, "rn")


def largest_quota(quotas: DataFrame, group: list[str]) -> int:
    """The largest sum of quotas of a group: one number to the driver."""
    return max(1, quotas.groupBy(*group).agg(F.sum("quota").alias("q")).agg(F.max("q")).first()[0] or 0)


def stratified_sample(bank: DataFrame, quotas: DataFrame, *, block: str, topic: str,
                      order: Column) -> DataFrame:
    """First ``quota`` rows of each (block, topic) in the given (pseudo-random) order."""
    ranked = ranked_strata(bank, quotas, block=block, topic=topic, order=order,
                           bound=largest_quota(quotas, [block, topic]))
    return ranked.filter(F.col("rn") <= F.col("quota"))


def shortfalls(sample: DataFrame, quotas: DataFrame, block: str, topic: str) -> DataFrame:
    """(block, topic, quota, obtained, missing) per stratum."""
    got = sample.groupBy(block, topic).agg(F.count(F.lit(1)).alias("obtained"))
    obtained = F.coalesce("obtained", F.lit(0))
    return quotas.join(got, [block, topic], "left").select(
        block, topic, "quota", obtained.alias("obtained"),
        F.greatest(F.lit(0), F.col("quota") - obtained).alias("missing"))


def draw_with_backfill(bank: DataFrame, quotas: DataFrame, *, block: str, topic: str,
                       order: Column, topic_order: Column,
                       no_backfill: tuple[str, ...] = (INFORMATICS,)) -> DataFrame:
    """Stratified draw plus back-fill; adds ``origin`` = 'quota' or 'backfill'.

    Missing units of a block are taken one by one from its topics in ``topic_order``:
    closed form, the r-th spare row of each topic is offered in the order (r, topic).
    """
    # A stratum gives its quota and, at most, what all of its block lacks.
    most = largest_quota(quotas, [block])
    ranked = ranked_strata(bank, quotas, block=block, topic=topic, order=order, bound=2 * most)
    chosen = ranked.filter(F.col("rn") <= F.col("quota"))
    deficit = (
        shortfalls(chosen, quotas, block, topic)
        .filter(~F.col(block).isin(*no_backfill) if no_backfill else F.lit(True))
        .groupBy(block).agg(F.sum("missing").alias("_deficit"))
    )
    spare = ranked.filter(F.col("rn") > F.col("quota")).withColumn(
        "_round", F.col("rn") - F.col("quota"))
    extra = top_k(
        spare.join(deficit, block), [block], [F.col("_round"), topic_order], most, "_place"
    ).filter(F.col("_place") <= F.col("_deficit"))
    return chosen.withColumn("origin", F.lit("quota")).drop("rn", "quota").unionByName(
        extra.withColumn("origin", F.lit("backfill"))
        .drop("rn", "quota", "_round", "_place", "_deficit"))


def number_items(items: DataFrame, exam: list[str], block_position: Column, order: Column,
                 name: str = "number") -> DataFrame:
    """Shuffle inside the blocks, blocks in fixed order, numbers 1..n (an exam is bounded)."""
    window = Window.partitionBy(*exam).orderBy(block_position, order)
    return items.withColumn(name, F.row_number().over(window))


def block_summary(items: DataFrame, targets: DataFrame, block: str = "block") -> DataFrame:
    """(block, target, obtained, missing, complete): complete covers the whole exam."""
    got = items.groupBy(block).agg(F.count(F.lit(1)).alias("obtained"))
    obtained = F.coalesce("obtained", F.lit(0))
    rows = targets.join(got, block, "left").select(
        block, "target", obtained.alias("obtained"),
        F.greatest(F.lit(0), F.col("target") - obtained).alias("missing"))
    everything = Window.partitionBy(F.lit(1))  # one row per block
    return rows.withColumn("complete", (
        F.sum("obtained").over(everything) == F.sum("target").over(everything)
    ) & (F.max("missing").over(everything) == 0))


def total_check(items: DataFrame, targets: DataFrame, block: str = "block") -> DataFrame:
    """(block, target, obtained, ok) for every block on either side."""
    got = items.groupBy(block).agg(F.count(F.lit(1)).alias("obtained"))
    return targets.join(got, block, "full").select(
        block, F.coalesce("target", F.lit(0)).alias("target"),
        F.coalesce("obtained", F.lit(0)).alias("obtained"),
        F.coalesce(F.col("target") == F.col("obtained"), F.lit(False)).alias("ok"))
