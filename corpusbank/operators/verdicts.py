"""Externally produced verdicts: parsing, checks, alignment, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbank.constants import (
    ALIGN_NOTE, LETTERS, REASON, REJECTED, REVIEW, SUBJECT_TOPICS, VERDICT_ERROR,
    VERDICT_STATES,
)
from corpusbank.functions.items import decide
from corpusbank.functions.text import let, strip, strip_code_fence
from corpusbank.operators.coverage import single_value
from corpusbank.session import stage


def parse_verdict(text: Column, id_field: str = "fragmento_id") -> Column:
    """struct<is_object, decision, confidence, chosen_id, id_given, id_is_int, reason, number_ok>.

    Malformed JSON gives ``is_object`` false instead of failing the job.
    """
    def fields(body):
        kind = F.schema_of_variant(F.try_variant_get(body, f"$.{id_field}", "variant"))
        number = F.schema_of_variant(F.try_variant_get(body, "$.confianza", "variant"))
        decision = F.try_variant_get(body, "$.decision", "string")
        reason = F.try_variant_get(body, "$.motivo", "string")
        return F.struct(
            body.isNotNull().alias("is_object"),
            F.upper(strip(F.coalesce(decision, F.lit("")))).alias("decision"),
            F.try_variant_get(body, "$.confianza", "double").alias("confidence"),
            F.coalesce(number.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False)).alias("number_ok"),
            F.coalesce(kind != "VOID", F.lit(False)).alias("id_given"),
            F.coalesce(kind == "BIGINT", F.lit(False)).alias("id_is_int"),
            F.try_variant_get(body, f"$.{id_field}", "bigint").alias("chosen_id"),
            strip(F.coalesce(reason, F.lit(""))).alias("reason"),
        )

    return let(F.try_parse_json(strip_code_fence(text)), fields)  # the text is parsed once


def check_verdicts(verdicts: DataFrame, candidates: DataFrame, *, question: str, text: str,
                   candidate_id: str, id_field: str = "fragmento_id") -> DataFrame:
    """Adds decision, confidence, chosen_id, reason, error and state to raw verdicts.

    The chosen id must be one of the candidates (question, candidate_id) offered.  Any
    violation gives A_REVISAR with a null confidence; otherwise the thresholds decide.
    """
    parsed = verdicts.withColumn("v", parse_verdict(F.col(text), id_field)).select(
        "*", F.col("v.chosen_id").alias("_id")).join(
        candidates.select(
            question, F.col(candidate_id).alias("_id"), F.lit(True).alias("_offered")
        ).distinct(), [question, "_id"], "left",
    )
    v = F.col("v")
    error = F.coalesce(
        F.when(~v["is_object"], F.lit(VERDICT_ERROR["not_object"])),
        F.when(~v["decision"].isin(*VERDICT_STATES),
               F.concat(F.lit(VERDICT_ERROR["decision"]), v["decision"])),
        F.when(~v["number_ok"], F.lit(VERDICT_ERROR["confidence_type"])),
        F.when(~v["confidence"].between(0.0, 1.0), F.lit(VERDICT_ERROR["confidence_range"])),
        F.when((v["decision"] == REJECTED) & v["id_given"],
               F.lit(VERDICT_ERROR["rejected_with_id"])),
        F.when((v["decision"] != REJECTED) & ~v["id_is_int"], F.lit(VERDICT_ERROR["id_type"])),
        F.when((v["decision"] != REJECTED) & F.col("_offered").isNull(),
               F.lit(VERDICT_ERROR["not_offered"])),
    )
    bad = F.col("error").isNotNull()
    return parsed.withColumn("error", error).select(
        *verdicts.columns,
        v["decision"].alias("decision"),
        F.when(~bad, v["confidence"]).alias("confidence"),
        F.when(~bad & (v["decision"] != REJECTED), v["chosen_id"]).alias("chosen_id"),
        F.when(bad, F.concat(F.lit(REASON["bad_verdict"]), F.col("error")))
        .otherwise(v["reason"]).alias("reason"),
        "error",
        F.when(bad, F.lit(REVIEW)).otherwise(decide(v["decision"], v["confidence"]))
        .alias("state"),
    )


def resolve_topics(checked: DataFrame, topics: DataFrame, chosen: str = "chosen_id",
                   many: str = REASON["fragment_many"],
                   none: str = REASON["fragment_unrelated"]) -> DataFrame:
    """Adds part and topic: given only when the chosen candidate has exactly one topic.

    ``topics`` is (chosen, n_topics, part, topic), one row per candidate.  Rejected and
    unreadable verdicts stay as they are; several topics or none mean A_REVISAR.
    """
    joined = checked.join(topics, chosen, "left")
    open_ = F.col("error").isNull() & (F.col("state") != REJECTED)
    n = F.coalesce("n_topics", F.lit(0))
    return joined.withColumn(
        "reason", F.when(open_ & (n == 0), none).when(open_ & (n > 1), many)
        .otherwise(F.col("reason"))
    ).withColumn("state", F.when(open_ & (n != 1), REVIEW).otherwise(F.col("state"))).withColumn(
        "part", F.when(open_ & (n == 1), F.col("part"))
    ).withColumn("topic", F.when(open_ & (n == 1), F.col("topic"))).withColumn(
        "chosen_id", F.when(F.col("state") == REJECTED, None).otherwise(F.col("chosen_id"))
    ).drop("n_topics")


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, columns: list[str]
                    ) -> DataFrame:
    """Rows with an override take all its columns, nulls included."""
    o = overrides.select(
        key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    joined = df.join(o, key, "left")
    hit = F.col("_hit").isNotNull()
    return joined.select(*[
        F.when(hit, F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def align_results(questions: DataFrame, results: DataFrame, number: list[str], position: str,
                  subjects=tuple(SUBJECT_TOPICS)) -> DataFrame:
    """Model results per question: the last one wins, defects become notes.

    ``results`` is (number.., position, answer, subject, confidence).
    """
    last = results.groupBy(*number).agg(
        F.max_by(F.struct("answer", "subject", "confidence"), F.col(position)).alias("r"))
    joined = questions.join(last, number, "left")
    answer = F.upper(strip(F.coalesce(F.col("r.answer"), F.lit(""))))
    subject = F.upper(strip(F.coalesce(F.col("r.subject"), F.lit(""))))
    missing = F.col("r").isNull()
    good_answer = ~missing & answer.isin(*LETTERS)
    good_subject = ~missing & subject.isin(*subjects)
    note = F.when(missing, ALIGN_NOTE["missing"]).otherwise(F.nullif(F.concat_ws(
        " ", F.when(~good_answer, ALIGN_NOTE["answer"]),
        F.when(~good_subject, ALIGN_NOTE["subject"])), F.lit("")))
    return joined.select(
        *questions.columns,
        F.when(good_answer, answer).alias("answer"),
        F.when(good_subject, subject).alias("subject"),
        F.when(missing, F.lit(0.0)).otherwise(
            F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(0.0))).alias("confidence"),
        note.alias("note"),
    )




def candidate_topics(documents: DataFrame, chosen: DataFrame, *, doc_id: str, text: str,
                     part: str, topic: str) -> DataFrame:
    """(chosen_id, n_topics, part, topic) of the documents in ``chosen`` (doc_id).

    A text may occur under several parts and topics.  Only the texts of candidates are looked
    for: their hashes are staged and the corpus is reduced by them before it is grouped.
    """
    keyed = documents.select(
        doc_id, F.sha2(text, 256).alias("_h"), F.col(part).alias("_p"), F.col(topic).alias("_t"))
    wanted = stage(keyed.join(chosen.distinct(), doc_id).select(doc_id, "_h").distinct(), "candidate-texts")
    summary = keyed.select("_h", "_p", "_t").join(wanted.select("_h").distinct(), "_h", "left_semi") \
        .groupBy("_h").agg(F.count_distinct("_p", "_t").alias("n_topics"),
                           single_value("_p").alias("part"), single_value("_t").alias("topic"))
    return wanted.join(summary, "_h").select(
        F.col(doc_id).alias("chosen_id"), "n_topics", "part", "topic")
