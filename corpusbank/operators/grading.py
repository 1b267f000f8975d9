"""Grading of answered exams and error reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbank.constants import BLANK_ANSWER, TOP_ERRORS
from corpusbank.functions.text import blank_to_null
from corpusbank.operators.ranking import top_k

MAX_REPRESENTATIVES = 15


def outcome(answer: Column, key: Column) -> Column:
    """'blank', 'hit' or 'error'."""
    return F.when(answer == BLANK_ANSWER, "blank").when(answer == key, "hit").otherwise("error")


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("outcome") == "hit").alias("hits"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "blank").alias("blanks"),
    ]


def grade(answered: DataFrame, attempt: list[str]) -> DataFrame:
    """Counts and mark 0..10 per attempt; three errors cancel one hit."""
    mark = (F.col("hits") - F.col("errors") / 3) / F.col("total") * 10
    return answered.groupBy(*attempt).agg(*_counts()).withColumn(
        "mark", F.greatest(F.lit(0.0), mark))


def outcome_by(answered: DataFrame, keys: list[str]) -> DataFrame:
    """Total, hits, errors and blanks per key."""
    return answered.groupBy(*keys).agg(*_counts())


def error_topk(answered: DataFrame, attempt: list[str], *, topic: str, norm: str, article: str,
               number: str, k: int = TOP_ERRORS) -> DataFrame:
    """(attempt.., dimension, key, n, rank): most frequent keys of the not-correct answers.

    Dimensions: topic, norm, "norm · article"; blanks count as not correct; equal counts
    keep the order in which the keys first appear.
    """
    n_, a_ = blank_to_null(F.col(norm).cast("string")), blank_to_null(F.col(article).cast("string"))
    pairs = F.array(
        F.struct(F.lit("topic").alias("dimension"),
                 blank_to_null(F.col(topic).cast("string")).alias("key")),
        F.struct(F.lit("norm").alias("dimension"), n_.alias("key")),
        F.struct(F.lit("reference").alias("dimension"),
                 F.concat(n_, F.lit(" · "), a_)
                 .alias("key")),
    )
    keyed = (
        answered.filter(F.col("outcome") != "hit")
        .select(*attempt, number, F.inline(pairs)).filter(F.col("key").isNotNull())
        .groupBy(*attempt, "dimension", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("first_seen"))
    )
    return top_k(keyed, [*attempt, "dimension"],
                 [F.col("n").desc(), F.col("first_seen")], k, "rank").drop("first_seen")


def representatives(answered: DataFrame, attempt: list[str], *, topic: str, norm: str,
                    number: str) -> DataFrame:
    """Representative errors: one per (topic, norm) first, then the rest in order.

    The limit is every error up to 10, 12 up to 25, else 15.  Only the first 15 errors and
    the first 15 new (topic, norm) pairs of an attempt can be chosen, so both are pruned
    before the last window.  ``number`` is unique inside an attempt.
    """
    errors = answered.filter(F.col("outcome") != "hit").select(
        *attempt, number,
        F.coalesce(blank_to_null(F.col(topic).cast("string")), F.lit("")).alias("topic"),
        F.coalesce(blank_to_null(F.col(norm).cast("string")), F.lit("")).alias("norm"),
    )
    limits = errors.groupBy(*attempt).agg(F.count(F.lit(1)).alias("_total")).withColumn(
        "_limit", F.when(F.col("_total") <= 10, F.col("_total"))
        .when(F.col("_total") <= 25, 12).otherwise(MAX_REPRESENTATIVES))
    firsts = errors.groupBy(*attempt, "topic", "norm").agg(F.min(number).alias(number))
    order = [F.col(number)]
    pool = (
        top_k(firsts, attempt, order, MAX_REPRESENTATIVES, "_rn").drop("_rn")
        .unionByName(top_k(errors, attempt, order, MAX_REPRESENTATIVES, "_rn").drop("_rn"))
        .distinct()
    )
    pair = Window.partitionBy(*attempt, "topic", "norm").orderBy(number)
    place = Window.partitionBy(*attempt).orderBy("_repeat", number)
    return (
        pool.withColumn("_repeat", F.when(F.row_number().over(pair) == 1, 0).otherwise(1))
        .withColumn("place", F.row_number().over(place))
        .join(limits, attempt).filter(F.col("place") <= F.col("_limit"))
        .select(*attempt, number, "topic", "norm", "place")
    )


def feature_profile(items: DataFrame, klass: str, flags: dict[str, Column],
                    classes: tuple[str, str]) -> DataFrame:
    """(feature, pct_a, pct_b, difference): share of items per class showing each feature."""
    flagged = items.select(klass, *[
        F.coalesce(c, F.lit(False)).cast("double").alias(name) for name, c in flags.items()
    ])
    means = flagged.groupBy(klass).agg(*[
        (F.avg(name) * 100).alias(name) for name in flags
    ])
    long = means.unpivot([klass], list(flags), "feature", "pct")
    return long.groupBy("feature").agg(
        F.max(F.when(F.col(klass) == classes[0], F.col("pct"))).alias("pct_a"),
        F.max(F.when(F.col(klass) == classes[1], F.col("pct"))).alias("pct_b"),
    ).withColumn("difference", F.col("pct_a") - F.col("pct_b"))


def length_profile(items: DataFrame, klass: str, text: str) -> DataFrame:
    """Items and length statistics per class."""
    n = F.length(text)
    return items.groupBy(klass).agg(
        F.count(F.lit(1)).alias("items"), F.avg(n).alias("avg_len"), F.min(n).alias("min_len"),
        F.max(n).alias("max_len"))


def feature_examples(items: DataFrame, klass: str, key: str, flags: dict[str, Column]
                     ) -> DataFrame:
    """(class, feature, key): the items that show each feature, one row per example."""
    shown = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in flags.items()]))
    return items.select(klass, F.explode(shown).alias("feature"), key)
