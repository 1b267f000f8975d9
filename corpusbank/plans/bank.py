"""Import, bank, exam and report jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbank.constants import ACCEPTED, INFORMATICS, METHOD_FOOTER, VALIDATED
from corpusbank.functions.items import (
    import_reason, initial_type, letters_complete, prepare_error, valid_answer,
)
from corpusbank.functions.text import fingerprint
from corpusbank.operators.dedup import first_ids, label_import
from corpusbank.operators.grading import error_topk, grade, outcome_by, representatives
from corpusbank.operators.joins import cached_explanations, lookup_part_topic
from corpusbank.operators.maintenance import insert_ignore, upsert
from corpusbank.operators.quota import (
    block_summary, draw_with_backfill, largest_remainder, number_items,
)
from corpusbank.operators.ranking import range_numbers
from corpusbank.plans.classify import validate_footers
from corpusbank.session import stage
from corpusbank.sources import versions


def with_fingerprint(items: DataFrame, stem: str = "stem", options: str = "opt_") -> DataFrame:
    return items.withColumn("fp", fingerprint(
        F.col(stem), *[F.col(f"{options}{x}") for x in "abcd"]))


def label_questions(raw: DataFrame, stored: DataFrame, batch: list[str]) -> DataFrame:
    """Check, fingerprint and label raw questions (pos, page, stem, opt_a..opt_d, answer).

    ``stored`` is (id, fp).  Every row leaves with ``label``: error, duplicate or new.
    """
    options = {x.upper(): F.col(f"opt_{x}") for x in "abcd"}
    checked = raw.withColumn("error", prepare_error(
        F.col("page").try_cast("long"), F.col("stem"), options, F.col("answer")))
    hashed = with_fingerprint(checked).withColumn(
        "fp", F.when(F.col("error").isNull(), F.col("fp")))
    return label_import(hashed, first_ids(stored, "fp", "id"), order="pos", key="fp",
                        error="error", batch=batch)


def import_questions(raw: DataFrame, stored: DataFrame, batch: list[str], aliases: DataFrame,
                     index) -> DataFrame:
    """Label raw questions and validate the new ones by their footer.

    ``raw`` is (pos, page, stem, opt_a..opt_d, answer, norm, footer, article, notes).  New
    rows get state, norm code, part, topic, initial type, reason and method; the stored
    article stays raw.  Errors and duplicates keep their label only.
    """
    labelled = stage(label_questions(raw, stored, batch), "labelled")
    new = labelled.filter("label = 'NUEVA'")
    checked = validate_footers(new, aliases, index, key="pos", norm="norm", footer="footer",
                               stem="stem", article="article")
    verdict = checked.select(
        "pos", "state", F.col("reason").alias("_reason"), F.col("norm").alias("code"), "part",
        "topic")
    done = F.col("state").isNotNull()
    return labelled.join(verdict, "pos", "left").select(
        "pos", *batch, "error", "label", "existing_id", "state", "code", "article", "part", "topic",
        initial_type(F.col("state"), F.col("part")).alias("qtype"),
        F.when(done, import_reason(F.col("notes"), F.col("_reason"))).alias("reason"),
        F.when(done, F.lit(METHOD_FOOTER)).alias("method"))


def accepted_bank(evaluations: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows of the new bank: accepted, resolved, answerable, exactly four options.

    ``questions`` carries answer and options(map).
    """
    good = evaluations.filter(
        (F.col("decision") == ACCEPTED) & F.col("part_id").isNotNull()
        & F.col("topic_id").isNotNull())
    return good.join(questions, "question_id").filter(valid_answer(F.col("answer"))).withColumn(
        "complete", letters_complete(F.col("options")))


def rebuild_bank(bank: DataFrame, accepted: DataFrame, calls: DataFrame) -> DataFrame:
    """(call_id, deleted, accepted, inserted, skipped) of a rebuild of the given calls."""
    deleted = bank.join(calls, "call_id", "left_semi").groupBy("call_id").agg(
        F.count(F.lit(1)).alias("deleted"))
    made = accepted.join(calls, "call_id", "left_semi").groupBy("call_id").agg(
        F.count(F.lit(1)).alias("accepted"), F.count_if("complete").alias("inserted"))
    zero = F.lit(0)
    return calls.join(deleted, "call_id", "left").join(made, "call_id", "left").select(
        "call_id", F.coalesce("deleted", zero).alias("deleted"),
        F.coalesce("accepted", zero).alias("accepted"),
        F.coalesce("inserted", zero).alias("inserted"),
        (F.coalesce("accepted", zero) - F.coalesce("inserted", zero)).alias("skipped"))


BANK_TABLES = {
    "questions": "call_id long, question_id long, part_id long, topic_id long, answer string",
    "options": "call_id long, question_id long, letter string, text string",
}


def stored_bank(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Current questions and options of all calls of a bank store."""
    return {name: versions.published(spark, root, name, "call_id", schema)
            for name, schema in BANK_TABLES.items()}


def bank_tables(accepted: DataFrame) -> dict[str, DataFrame]:
    """Questions and their options of the complete rows of :func:`accepted_bank`."""
    rows = accepted.filter("complete")
    return {
        "questions": rows.select("call_id", "question_id", "part_id", "topic_id", "answer"),
        "options": rows.select("call_id", "question_id",
                               F.explode("options").alias("letter", "text"))}


def store_rebuild(root: str, accepted: DataFrame, calls: DataFrame) -> DataFrame:
    """Replace the stored bank of ``calls``; returns the counters of :func:`rebuild_bank`.

    Questions and options of all calls go into one new version and are committed together; the
    other calls keep theirs.  A run that fails before the commit changes nothing.
    """
    spark, calls = calls.sparkSession, stage(calls.select("call_id").distinct(), "rebuild-calls")
    rows = stage(accepted.join(calls, "call_id", "left_semi"), "rebuild-rows")
    counts = stage(rebuild_bank(stored_bank(spark, root)["questions"], rows, calls), "rebuild")
    versions.publish(bank_tables(rows), root, "call_id", calls)
    return counts


def storage_bucket(parent: Column, buckets: int) -> Column:
    """Stable bucket of a parent's children on storage."""
    return F.pmod(F.xxhash64(parent.cast("string")), F.lit(buckets)).cast("long")


def create_children(root: str, rows: DataFrame, parent: str, order: list[str],
                    buckets: int = 64) -> None:
    """A store of children, numbered 1..n per parent in ``place`` and dealt out to buckets."""
    spark = rows.sparkSession
    versions.create_store(spark, root, "bucket long")
    placed = range_numbers(rows, [parent], order, "place").withColumn(
        "bucket", storage_bucket(F.col(parent), buckets))
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    versions.publish({"children": placed.repartition("bucket")}, root, "bucket", every)


def stored_children(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Current children; ``schema`` is the DDL of their columns and ``place``."""
    return versions.published(spark, root, "children", "bucket", f"{schema}, bucket long")


def replace_stored_children(root: str, schema: str, new: DataFrame, parent: str,
                            order: list[str], buckets: int = 64) -> None:
    """All stored children of the parents in ``new`` are replaced and numbered 1..n.

    Only the buckets of these parents are read and written again; the files of the others stay.
    """
    spark = new.sparkSession
    own = stage(new.withColumn("bucket", storage_bucket(F.col(parent), buckets)), "children-new")
    touched = stage(own.select("bucket").distinct(), "children-buckets")
    kept = (
        stored_children(spark, root, schema).join(touched, "bucket", "left_semi")
        .join(own.select(parent).distinct(), parent, "left_anti"))
    placed = range_numbers(own, [parent], order, "place")
    rows = kept.unionByName(placed.select(kept.columns))
    versions.publish({"children": rows.repartition("bucket")}, root, "bucket", touched)


def migrate_bank(questions: DataFrame, bank: DataFrame, parts: DataFrame, topics: DataFrame
                 ) -> DataFrame:
    """(question_id, part_id, topic_id, status): inserted, existing, unresolved or skipped."""
    usable = questions.filter(
        (F.col("state") == VALIDATED) & F.col("qtype").isNotNull()
        & valid_answer(F.col("answer")))
    resolved = lookup_part_topic(usable, parts, topics)
    ok = F.col("topic_id").isNotNull() & letters_complete(F.col("options"))
    marked = insert_ignore(
        bank, resolved.filter(ok).select("question_id", "call", "part_id", "topic_id"),
        ["question_id", "call"], "question_id")
    rest = resolved.filter(~ok).select(
        "question_id", "call", "part_id", "topic_id",
        F.when(F.col("topic_id").isNull(), "unresolved").otherwise("skipped").alias("status"))
    return marked.select(rest.columns).unionByName(rest)


def build_exam(bank: DataFrame, counts: DataFrame, targets: DataFrame, *, order: Column,
               topic_order: Column, block_position: Column, shuffle: Column,
               no_backfill: tuple[str, ...] = (INFORMATICS,)) -> DataFrame:
    """Numbered exam: quotas by largest remainder, draw, back-fill, shuffle inside blocks."""
    quotas = stage(largest_remainder(counts, targets), "quotas")
    drawn = draw_with_backfill(bank, quotas, block="block", topic="topic", order=order,
                               topic_order=topic_order,
                               no_backfill=no_backfill)
    return number_items(drawn, [], block_position, shuffle)


def build_exams(bank: DataFrame, counts: DataFrame, targets: DataFrame, exams: int, *,
                item: str = "item", used: DataFrame | None = None, **draw) -> DataFrame:
    """Several exams (column ``exam``, from 1) of one call, without repeating an item.

    Every exam is drawn from the bank without the ledger of used items, which starts with
    ``used`` and grows by each exam; the quotas are the same for all.  A ledger row per item
    drawn is all that passes from one exam to the next; ``draw`` goes to :func:`build_exam`.
    """
    ledger = bank.select(item).limit(0) if used is None else used.select(item)
    out = None
    for number in range(1, exams + 1):
        exam = stage(build_exam(bank.join(ledger, item, "left_anti"), counts, targets, **draw)
                     .withColumn("exam", F.lit(number)), "exam")
        ledger = ledger.unionByName(exam.select(item))
        out = exam if out is None else out.unionByName(exam)
    return out


def grade_report(answered: DataFrame, attempt: list[str], *, topic: str, norm: str,
                 article: str, number: str) -> dict[str, DataFrame]:
    """Marks, outcome per topic, most frequent errors and representative errors."""
    return {
        "marks": grade(answered, attempt),
        "topics": outcome_by(answered, [*attempt, topic]),
        "errors": error_topk(answered, attempt, topic=topic, norm=norm, article=article,
                             number=number),
        "examples": representatives(answered, attempt, topic=topic, norm=norm, number=number),
    }


def fill_gaps(exam: DataFrame, generated: DataFrame, gaps: DataFrame, *, block_position: Column,
              order: Column) -> DataFrame:
    """Exam plus generated items, renumbered; only strata generated exactly as requested.

    ``generated`` is (block, topic, item, options, answer); invalid items do not count.
    """
    valid = generated.filter(letters_complete(F.col("options")) & valid_answer(F.col("answer")))
    exact = valid.groupBy("block", "topic").agg(F.count(F.lit(1)).alias("_n")).join(
        gaps, ["block", "topic"]).filter(F.col("_n") == F.col("missing")).select("block", "topic")
    added = valid.join(exact, ["block", "topic"], "left_semi").select(
        "block", "topic", "item", F.lit(True).alias("needs_review"))
    everything = exam.select("block", "topic", "item", F.lit(False).alias("needs_review")
                             ).unionByName(added)
    return number_items(everything, [], block_position, order)


def enrich_explanations(items: DataFrame, cache: DataFrame, generated: DataFrame, *, key: str,
                        fragment: str, fallback: str) -> tuple[DataFrame, DataFrame]:
    """(items with explanation, new cache): cached texts are reused, new ones stored."""
    enriched = cached_explanations(items, cache, key, fragment=fragment, fallback=fallback)
    needed = enriched.filter("source = 'needed'").select(key)
    new = generated.join(needed, key, "left_semi")
    return enriched, upsert(cache, new, [key], "at")
