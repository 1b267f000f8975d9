"""Relational joins of the bank: dimensions, options, membership, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbank.constants import ACCEPTED, REASON, REVIEW, SUBJECT_TOPICS
from corpusbank.functions.items import valid_answer
from corpusbank.functions.text import title_key
from corpusbank.operators.ranking import range_numbers


def options_to_map(options: DataFrame, key: list[str], letter: str, text: str,
                   order: str) -> DataFrame:
    """(key.., options, repeated): child rows as a map letter -> text.

    Letters are trimmed and upper-cased; a repeated letter keeps its last text by ``order``
    (equal places: the greater text) and raises the flag.  Rows are reduced per letter first,
    so a key collects one entry per letter (a small fixed set, see the CHECK rules).
    """
    rows = options.groupBy(*key, F.upper(F.trim(F.col(letter))).alias("_l")).agg(
        F.max_by(text, F.struct(order, text)).alias("_t"), F.count(F.lit(1)).alias("_n"))
    return rows.groupBy(*key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_l", "_t")))).alias("options"),
        (F.max("_n") > 1).alias("repeated"))


def explode_options(items: DataFrame, key: list[str], options: str = "options") -> DataFrame:
    """(key.., letter, text): one row per option."""
    return items.select(*key, F.explode(options).alias("letter", "text"))


def topic_fragments(bridge: DataFrame, fragments: DataFrame, topic: str, document: str,
                    order: list[str], name: str = "place") -> DataFrame:
    """(topic, document, fragment columns.., place): the fragments of a topic's documents in order.

    ``bridge`` is (topic, document).  Numbering deals the rows out by ranges, so a topic with
    any number of fragments spreads over many tasks.
    """
    rows = bridge.select(topic, document).join(fragments, document)
    return range_numbers(rows, [topic], [document, *order], name)


def lookup_part_topic(rows: DataFrame, parts: DataFrame, topics: DataFrame) -> DataFrame:
    """Resolve part_id by (call, part) and then topic_id by (call, part_id, number).

    ``parts`` is (call, part, part_id), ``topics`` is (call, part_id, number, topic_id); ids
    that cannot be resolved stay null.
    """
    return (
        rows.join(parts, ["call", "part"], "left")
        .join(topics, ["call", "part_id", "number"], "left")
    )


def subject_topics(rows: DataFrame, subject: Column, name: str = "topic",
                   mapping: dict[str, int] = SUBJECT_TOPICS) -> DataFrame:
    """Adds the topic number of a subject code; unknown codes give null."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return rows.withColumn(name, F.try_element_at(F.create_map(*pairs), subject))


def unique_match(assoc: DataFrame, titles: DataFrame, key: list[str], *, number: str,
                 title: str, match_id: str) -> DataFrame:
    """(key.., n_matches, match_id): the id only when number and title match exactly once."""
    left = assoc.select(*key, number, title_key(F.col(title)).alias("_key"))
    counted = titles.select(number, title_key(F.col(title)).alias("_key"), match_id).groupBy(
        number, "_key").agg(F.count(match_id).alias("_n"), F.min(match_id).alias("_id"))
    n = F.coalesce(F.sum("_n"), F.lit(0))
    return left.join(counted, [number, "_key"], "left").groupBy(*key).agg(
        n.alias("n_matches"), F.when(n == 1, F.min("_id")).alias(match_id))


def evaluate(rows: DataFrame, *, topic: str, part: str, answer: str, subject: str) -> DataFrame:
    """Adds decision and reason; part and topic are cleared unless accepted."""
    ok = F.col(topic).isNotNull() & valid_answer(F.col(answer))
    return rows.withColumn("decision", F.when(ok, ACCEPTED).otherwise(REVIEW)).withColumn(
        "reason", F.when(ok, F.concat(
            F.lit("Materia "), F.col(subject), F.lit(" vinculada al tema.")))
        .otherwise(REASON["not_acceptable"])
    ).withColumn(part, F.when(ok, F.col(part))).withColumn(topic, F.when(ok, F.col(topic)))


def cached_explanations(items: DataFrame, cache: DataFrame, key: str, *, fragment: str,
                        fallback: str) -> DataFrame:
    """Adds short, long and source: 'reused', 'needed' (a fragment exists) or 'placeholder'."""
    joined = items.join(
        cache.select(key, F.col("short").alias("_s"), F.col("long").alias("_l")), key, "left")
    found = F.col("_s").isNotNull()
    source = (
        F.when(found, "reused").when(F.col(fragment).isNotNull(), "needed")
        .otherwise("placeholder")
    )
    return joined.withColumn("source", source).withColumn(
        "short", F.when(F.col("source") == "reused", F.col("_s")).when(
            F.col("source") == "placeholder",
            F.coalesce(F.col(fallback), F.lit("Explicación pendiente.")))
    ).withColumn("long", F.when(F.col("source") == "reused", F.col("_l")).when(
        F.col("source") == "placeholder", F.lit(""))).drop("_s", "_l")


def bank_star(bank: DataFrame, evaluations: DataFrame, calls: DataFrame, parts: DataFrame,
              topics: DataFrame, questions: DataFrame, exams: DataFrame) -> DataFrame:
    """Bank rows with evaluation, call, part and topic, and (if known) question and exam."""
    return (
        bank.join(evaluations, ["question_id", "call_id"])
        .join(calls, "call_id").join(parts, "part_id").join(topics, "topic_id")
        .join(questions, "question_id", "left").join(exams, "exam_id", "left")
    )
