"""Documentation of a topic within a character budget, and fixed-size batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbank.constants import BATCH_ITEMS, CONTEXT_CHARS
from corpusbank.operators.ranking import range_numbers, range_running_sum
from corpusbank.session import stage


def context_budget(docs: DataFrame, topic: list[str], doc: str, blocks: Column,
                   budget: int = CONTEXT_CHARS) -> DataFrame:
    """(topic.., context): blocks of the documents joined by new lines, cut at ``budget``.

    ``blocks`` is an array of non-empty texts per document, ``doc`` the unique document key
    that orders them.  Only the lengths of the documents are shuffled: a running
    length by ranges finds the documents that start within the budget, and just their texts are
    joined and collected (every one uses up part of the budget).
    """
    size = F.aggregate(blocks, F.lit(0), lambda total, b: total + F.length(b) + F.lit(1))
    sizes = stage(docs.select(*topic, doc, size.alias("_size")), "sizes").filter("_size > 0")
    sized = range_running_sum(sizes, topic, [doc], "_size", "_end")
    within = sized.filter(F.col("_end") - F.col("_size") < budget).select(doc)
    texts = docs.join(within, doc, "left_semi").select(
        *topic, doc, F.left(F.array_join(blocks, "\n"), F.lit(budget)).alias("_t"))
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(doc, "_t"))), lambda s: s["_t"]), "\n")
    return texts.groupBy(*topic).agg(F.left(joined, F.lit(budget)).alias("context"))


def fixed_batches(df: DataFrame, order: list[str], size: int = BATCH_ITEMS,
                  name: str = "batch") -> DataFrame:
    """Consecutive batches of ``size`` rows over the whole table."""
    numbered = range_numbers(df, [], order, "_rn")
    return numbered.withColumn(name, F.floor((F.col("_rn") - 1) / size)).drop("_rn")
