"""Question records: options, answers, cleaning rules, thresholds, costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusbank.constants import (
    AUTO_CONFIDENCE, DEFAULT_ORIGIN_PART, EXTRACTION_NOTE, GENERAL, INFORMATICS, LETTERS,
    MIN_CONFIDENCE, ORIGIN_PART, POSITION_RANGES, PREPARE_ERROR, REJECTED, REVIEW, VALIDATED,
)
from corpusbank.functions.text import blank_to_null, normalize_spaces, strip


def valid_answer(c: Column) -> Column:
    """True when the trimmed upper-case answer is one of A-D (null counts as false)."""
    return F.coalesce(F.upper(strip(c)).isin(*LETTERS), F.lit(False))


def letters_complete(options: Column) -> Column:
    """True when a letter->text map has exactly A-D, each one non-blank."""
    exact = F.array_sort(F.map_keys(options)) == F.array(*[F.lit(x) for x in LETTERS])
    filled = F.forall(
        F.map_values(options), lambda v: F.coalesce(strip(v) != "", F.lit(False))
    )
    return F.coalesce(exact & filled, F.lit(False))


def prepare_error(page: Column, stem: Column, options: dict[str, Column], answer: Column,
                  has_options: Column | None = None) -> Column:
    """Text of the first failing check of a raw question; null when it is good."""
    checks = [
        F.when(page.isNull(), F.lit(PREPARE_ERROR["page"])),
        F.when(blank_to_null(stem).isNull(), F.lit(PREPARE_ERROR["stem"])),
    ]
    if has_options is not None:
        checks.append(F.when(~has_options, F.lit(PREPARE_ERROR["options"])))
    checks += [
        F.when(blank_to_null(options[x]).isNull(), F.lit(PREPARE_ERROR["option"].format(x)))
        for x in LETTERS
    ]
    checks.append(F.when(~valid_answer(answer), F.lit(PREPARE_ERROR["answer"])))
    return F.coalesce(*checks)


def clamp_confidence(c: Column) -> Column:
    """Numeric confidence in [0, 1]; anything unreadable becomes 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))


def extraction_notes(notes: Column, number: Column, options: dict[str, Column],
                     answer: Column) -> Column:
    """Existing notes followed by one note per defect of an extracted question."""
    def missing(c):
        return F.coalesce(c, F.lit("")) == ""

    found = [F.when(number.isNull(), F.lit(EXTRACTION_NOTE["number"]))]
    found += [
        F.when(missing(options[x]), F.lit(EXTRACTION_NOTE["option"].format(x))) for x in LETTERS
    ]
    found.append(F.when(
        answer.isNotNull() & ~F.upper(strip(answer)).isin(*LETTERS),
        F.lit(EXTRACTION_NOTE["answer"]),
    ))
    return F.concat(
        F.coalesce(notes, F.array().cast("array<string>")), F.array_compact(F.array(*found))
    )


def extraction_complete(stem: Column, options: dict[str, Column], answer: Column,
                        norm: Column, article: Column) -> Column:
    def given(c):
        return F.coalesce(c, F.lit("")) != ""

    present = reduce(lambda a, b: a & b, [given(options[x]) for x in LETTERS])
    return given(stem) & present & valid_answer(answer) & given(norm) & given(article)


def decide(decision: Column, confidence: Column, low: float = MIN_CONFIDENCE,
           high: float = AUTO_CONFIDENCE) -> Column:
    """State of a verdict; the order of the rules matters."""
    return (
        F.when(decision == REJECTED, REJECTED)
        .when(confidence < low, REJECTED)
        .when(decision == REVIEW, REVIEW)
        .when(confidence < high, REVIEW)
        .otherwise(VALIDATED)
    )


def position_type(position: Column, ranges=POSITION_RANGES) -> Column:
    """Question type of an exam position; null outside every range."""
    return F.coalesce(*[
        F.when(position.between(lo, hi), F.lit(name)) for lo, hi, name in ranges
    ])


def origin_part(qtype: Column) -> Column:
    out = F.lit(DEFAULT_ORIGIN_PART)
    for name, part in ORIGIN_PART.items():
        out = F.when(qtype == name, F.lit(part)).otherwise(out)
    return out


def initial_type(state: Column, part: Column) -> Column:
    """Type given at import: only validated items of two parts get one."""
    name = normalize_spaces(part)
    return F.when(
        state == VALIDATED,
        F.when(name == "general", GENERAL).when(
            name.isin("especial-informatica", "especial informatica"), INFORMATICS
        ),
    )


def join_reasons(*reasons: Column) -> Column:
    """Non-blank reasons joined by " | "; null when there are none."""
    return F.nullif(F.concat_ws(" | ", *[blank_to_null(r) for r in reasons]), F.lit(""))


def import_reason(notes: Column, reason: Column) -> Column:
    """Extraction notes and the validation reason in one text."""
    return join_reasons(
        F.when(F.size(notes) > 0,
               F.concat(F.lit("Incidencias de extracción: "), F.array_join(notes, " | "))),
        reason,
    )


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost of a model call; prices are per million tokens, cached tokens pay in full."""
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1_000_000)


def same_letters(options: Column) -> Column:
    """True when the option letters are exactly A-D as a set (texts are not checked)."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    keys = F.map_keys(options)
    return (F.size(F.array_except(keys, letters)) == 0) & (
        F.size(F.array_except(letters, keys)) == 0)


def exam_item(options: Column, answer: Column, origin: Column | None = None) -> Column:
    """struct<options(array in fixed order), answer_text, origin> of a bank row."""
    ordered = F.transform(
        F.array(*[F.lit(x) for x in LETTERS]),
        lambda x: F.struct(x.alias("letter"), F.try_element_at(options, x).alias("text")))
    return F.struct(
        ordered.alias("options"), F.try_element_at(options, answer).alias("answer_text"),
        F.coalesce(origin if origin is not None else F.lit(None).cast("string"),
                   F.lit("BANCO")).alias("origin"))
