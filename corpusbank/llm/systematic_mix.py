"""Mixing sources to target weights by systematic sampling.

The words of every source are brought to a target.  A source's expected number of copies per
document is target / size; along the documents of the source, ordered by size, the expected
copies are summed up, one random offset per source is added, and a document is emitted once for
every integer boundary that the running sum crosses.  The order by size makes neighbours equal in
size, so the words taken miss the target by at most about twice the longest document.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; a
null doc_id sorts first; repeated rows are separate rows; an empty table gives no rows; a source
without words gets target 0 and none of its documents is taken; columns of any name are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbank.llm.common import table, word_count
from corpusbank.operators.ranking import range_numbers
from corpusbank.session import stage

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   most: int = MOST_COPIES) -> DataFrame:
    """(_source, _source_size, _docs, _target) from one row (_source, _source_size, _docs) each.

    The weights repeat along the sources by code point, null last.  All targets add up to the
    words of all sources; a target is held at ``most`` times its source's words and the excess is
    reshared by weight: sources ordered by words per weight are held as long as the level of the
    rest would lift them above their limit.  The windows see one row per source.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    by_room = Window.orderBy(F.col("_limit").cast("double") / F.col("_weight"), "_index")
    everything = Window.partitionBy(F.lit(0))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    as_double = lambda c: F.col(c).cast("double")
    return (
        sizes.withColumn("_index", F.row_number().over(by_name))
        .withColumn("_weight", F.element_at(
            F.array(*[F.lit(w) for w in weights]),
            (F.col("_index") - 1) % F.lit(len(weights)) + 1).cast("long"))
        .withColumn("_limit", F.col("_source_size") * F.lit(most))
        .withColumn("_total", F.sum("_source_size").over(everything))
        .withColumn("_earlier", F.coalesce(F.sum("_limit").over(before), F.lit(0)))
        .withColumn("_rest", F.sum("_weight").over(onwards))
        .withColumn("_held", as_double("_limit") * F.col("_rest")
                    <= (F.col("_total") - F.col("_earlier")).cast("double") * F.col("_weight"))
        .withColumn("_free", F.col("_total") - F.coalesce(
            F.sum(F.when(F.col("_held"), F.col("_limit"))).over(everything), F.lit(0)))
        .withColumn("_open", F.sum(F.when(~F.col("_held"), F.col("_weight"))).over(everything))
        .select("_source", "_source_size", "_docs", F.when(F.col("_held"), as_double("_limit"))
                .otherwise(as_double("_free") * F.col("_weight") / F.col("_open"))
                .alias("_target"))
    )


def random_offset(source: Column) -> Column:
    """A reproducible offset in (0, 1) for every source."""
    named = F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))
    return (F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _with_copies(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds the source's figures and ``_copies`` to rows of (_row, _source, _id, _size)."""
    rows = stage(rows, "mix-rows")
    targets = source_targets(
        rows.groupBy("_source").agg(F.sum("_size").alias("_source_size"),
                                    F.count(F.lit(1)).alias("_docs")), weights, most)
    targets = targets.withColumnRenamed("_source", "_of")
    ranked = range_numbers(rows, ["_source"], ["_size", "_id"], "_rn", "mix-order")
    each = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    until = lambda rank: F.floor(rank * each + random_offset(F.col("_source")))
    return ranked.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).withColumn(
        "_copies", F.least(until(F.col("_rn")) - until(F.col("_rn") - 1), F.lit(most)))


def systematic_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   source: str = "source", weights: tuple[int, ...] = WEIGHTS,
                   most: int = MOST_COPIES) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    rows = docs.select(F.col(source).alias("_source"), F.col(doc_id).alias("_id"),
                       word_count(F.col(text)).alias("_size"))
    return _with_copies(rows, weights, most).select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"),
        F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    source: str = "source", weights: tuple[int, ...] = WEIGHTS,
                    most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is emitted (0 to ``most``)."""
    rows = docs.select(F.col(source).alias("_source"), F.col(doc_id).alias("_id"),
                       word_count(F.col(text)).alias("_size"),
                       F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    taken = _with_copies(rows, weights, most).filter("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
                        .alias("_copy")).select("_row.*")


def op8_systematic_mix(spark, sf_dir: str) -> DataFrame:
    """All documents: size, its source's size and target, and the words the mix takes."""
    return systematic_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''),
         '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS idx FROM s),
v AS (SELECT *, [1, 2, 3][(idx - 1) % 3 + 1] AS weight, source_size * 3 AS lim,
             CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
o AS (SELECT *, coalesce(CAST(sum(lim) OVER (ORDER BY CAST(lim AS DOUBLE) / weight, idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS earlier,
             CAST(sum(weight) OVER (ORDER BY CAST(lim AS DOUBLE) / weight, idx
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM v),
h AS (SELECT *, CAST(lim AS DOUBLE) * rest <= CAST(total - earlier AS DOUBLE) * weight AS held
      FROM o),
f AS (SELECT *, total - coalesce(CAST(sum(lim) FILTER (held) OVER () AS BIGINT), 0) AS free,
             CAST(sum(weight) FILTER (NOT held) OVER () AS BIGINT) AS open FROM h),
t AS (SELECT source, source_size, CASE WHEN held THEN CAST(lim AS DOUBLE)
             ELSE CAST(free AS DOUBLE) * weight / open END AS target,
             (CAST(('0x' || substr(md5(coalesce('s' || source, 'null')), 1, 8)) AS BIGINT) + 0.5)
               / 4294967296.0::DOUBLE AS shift
      FROM f),
r AS (SELECT d.*, t.source_size, t.target, t.shift,
             row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS rn,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       least(CAST(floor(rn * each + shift) AS BIGINT)
             - CAST(floor((rn - 1) * each + shift) AS BIGINT), 3) * size AS taken
FROM r
"""
