"""Regular-expression features: practical-case score and phrase flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusbank.constants import (
    ACRONYM_PATTERN, ACTION_WORDS, AMOUNT_PATTERN, CONCRETE_SUBJECT, DATE_PATTERN, EXPLICIT_CASE,
    MONTHS, NAMED_SUBJECT_VERBS, NARRATIVE_PHRASES, NUMBER_PATTERN, OPENINGS, ORGAN_PHRASES,
    PERCENT_PATTERN, PERSON_PHRASES, SEQUENCE_WORDS, YEAR_PATTERN,
)
from corpusbank.functions.text import normalize_spaces


def any_phrase(text: Column, phrases) -> Column:
    """Any of the phrases as whole words."""
    return text.rlike("(?U)\\b(?:" + "|".join(phrases) + ")\\b")


def practical_rules(original: Column, strict: bool = False) -> list[tuple[int, Column]]:
    """(weight, condition) pairs of the practical-case score.

    ``strict=True`` keeps the historic behaviour: acronyms are looked up on lower-cased
    text (never found), any word followed by a subject verb counts as a person, and
    months match inside longer words.
    """
    text = normalize_spaces(original)
    verbs = "|".join(NAMED_SUBJECT_VERBS)
    if strict:
        subject = any_phrase(text, CONCRETE_SUBJECT) | text.rlike(
            rf"\b[a-z]{{2,}}(?:\s+[a-z]\.){{0,3}}\s+(?:{verbs})\b"
        )
        acronym = F.lit(False)
        month = text.rlike("|".join(MONTHS))
    else:
        subject = any_phrase(text, CONCRETE_SUBJECT) | original.rlike(
            rf"\b[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-Z]\.){{0,3}}\s+(?:{verbs})\b"
        )
        acronym = original.rlike(ACRONYM_PATTERN)
        month = any_phrase(text, MONTHS)
    return [
        (4, any_phrase(text, EXPLICIT_CASE)),
        (2, subject),
        (2, acronym),
        (2, text.rlike(YEAR_PATTERN)),
        (2, month),
        (2, text.rlike(PERCENT_PATTERN)),
        (1, text.rlike(NUMBER_PATTERN)),
        (2, any_phrase(text, ACTION_WORDS)),
        (1, any_phrase(text, SEQUENCE_WORDS)),
    ]


def weighted_score(rules: list[tuple[int, Column]]) -> Column:
    return reduce(
        lambda a, b: a + b,
        [F.when(cond, F.lit(weight)).otherwise(F.lit(0)) for weight, cond in rules],
    )


def practical_score(original: Column, strict: bool = False) -> Column:
    return weighted_score(practical_rules(original, strict))


def phrase_flags(original: Column, openings=OPENINGS, persons=PERSON_PHRASES,
                 organs=ORGAN_PHRASES, actions=NARRATIVE_PHRASES) -> dict[str, Column]:
    """Boolean features of a statement; phrases are compared accent-free."""
    text = normalize_spaces(original)
    months = "|".join(MONTHS)
    person, organ, action = (
        any_phrase(text, persons), any_phrase(text, organs), any_phrase(text, actions)
    )
    date = original.rlike(DATE_PATTERN.format(months=months))
    amount = original.rlike(AMOUNT_PATTERN)
    flags = {
        f"opens_{i:02d}": text.startswith(normalize_spaces(F.lit(p)))
        for i, p in enumerate(openings)
    }
    flags.update(
        person=person, organ=organ, action=action, date=date, amount=amount,
        subject_action=action & (person | organ), action_datum=action & (date | amount),
    )
    return flags
