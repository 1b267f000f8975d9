"""Citations and coverage expressions: article numbers, norm codes, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusbank.constants import (
    ARTICLE_SUFFIXES, KIND_PREFIXES, SPECIAL_ALIASES, SPECIAL_PREFIXES,
)
from corpusbank.functions.text import let, normalize_spaces, strip

_SUFFIX = "|".join(ARTICLE_SUFFIXES)

# fixed values: citation patterns
ARTICLE_PATTERN = rf"(?iU)\bart[íi]culo(?:s)?\s+(\d+)(?:\s*({_SUFFIX}))?"
NORM_PATTERN = (
    r"(?iU)\b(ley\s+org[aá]nica|real\s+decreto\s+legislativo|decreto\s+legislativo"
    r"|ley|decreto)\s+(\d+)\s*/\s*(\d{4})\b"
)
NAMED_NORMS = {"CODIGO_CIVIL": r"(?iU)\bc[oó]digo\s+civil\b"}


def cited_article(text: Column, pattern: str = ARTICLE_PATTERN) -> Column:
    """First cited article ("52", "40 bis"); null when there is none."""
    number = F.regexp_extract(text, pattern, 1)
    suffix = F.lower(F.regexp_extract(text, pattern, 2))
    return F.nullif(F.concat_ws(" ", number, F.nullif(suffix, F.lit(""))), F.lit(""))


def cited_norm(text: Column, pattern: str = NORM_PATTERN) -> Column:
    """First generic norm reference as a code such as ``L39_2015``; null if none."""
    kind = F.regexp_replace(F.lower(F.regexp_extract(text, pattern, 1)), "(?U)\\s+", " ")
    prefix = (
        F.when(kind.isin("ley orgánica", "ley organica"), "LO")
        .when(kind.isin("decreto legislativo", "real decreto legislativo"), "DL")
        .when(kind == "decreto", "D")
        .otherwise("L")
    )
    code = F.concat(
        prefix, F.regexp_extract(text, pattern, 2), F.lit("_"),
        F.regexp_extract(text, pattern, 3),
    )
    return F.when(kind != "", code)


def named_norm(text: Column, named: dict[str, str] = NAMED_NORMS) -> Column:
    """Code of the first norm cited by its name."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(code)) for code, p in named.items()])


def normalize_article(c: Column) -> Column:
    """Canonical article ("007 Bis" -> "7 bis"); null when the format is unknown."""
    text = F.regexp_replace(F.lower(strip(c)), "(?U)\\s+", " ")
    shape = rf"^(\d+)(?:\s*({_SUFFIX}))?\z"
    digits = F.regexp_replace(F.regexp_extract(text, shape, 1), "^0+(?=\\d)", "")
    suffix = F.regexp_extract(text, shape, 2)
    return F.when(text.rlike(shape), F.concat_ws(" ", digits, F.nullif(suffix, F.lit(""))))


def article_parts(expression: Column) -> Column:
    """Trimmed pieces of a coverage expression such as ``24, 36 y 40 bis``."""
    text = F.replace(F.lower(strip(expression)), F.lit(","), F.lit(" y "))
    return F.filter(
        F.transform(F.split(text, "(?U)\\s+y\\s+"), lambda p: strip(p)), lambda p: p != ""
    )


def expand_ranges(expression: Column) -> Column:
    """Sorted distinct articles of an expression; null when any piece is invalid.

    The result is an array inside the row: its size is the span of the ranges, so
    explode it only against a catalogue, never against a fact table.
    """
    rng, single = r"^(\d+)\s*-\s*(\d+)\z", rf"^(\d+)(?:\s*({_SUFFIX}))?\z"

    def bounds(p):
        return (
            F.regexp_extract(p, rng, 1).try_cast("long"),
            F.regexp_extract(p, rng, 2).try_cast("long"),
        )

    def valid(p):
        lo, hi = bounds(p)
        return p.rlike(single) | F.coalesce(lo <= hi, F.lit(False))

    def items(p):
        lo, hi = bounds(p)
        one = F.concat_ws(
            " ", F.regexp_extract(p, single, 1),
            F.nullif(F.regexp_extract(p, single, 2), F.lit("")),
        )
        return F.when(
            p.rlike(rng), F.transform(F.sequence(lo, hi), lambda n: n.cast("string"))
        ).otherwise(F.array(one))

    def sorted_items(parts):
        keyed = F.transform(
            F.array_distinct(F.flatten(F.transform(parts, items))),
            lambda a: F.struct(
                F.regexp_extract(a, "^\\d+", 0).try_cast("long").alias("n"), a.alias("a")))
        return F.when(F.forall(parts, valid), F.transform(F.sort_array(keyed), lambda s: s["a"]))

    return let(article_parts(expression), sorted_items)


def file_stem(name: Column) -> Column:
    """Last path component without its extension."""
    base = F.regexp_extract(name, "([^/]*)\\z", 1)
    return F.regexp_replace(base, "(?<=.)\\.[^.]*\\z", "")


def coverage_expression(name: Column) -> Column:
    """Part of a file name after "artículo(s)"; null means the whole norm is covered."""
    found = F.regexp_extract(file_stem(name), r"(?iU)\bart[ií]culos?\s+(.+)\z", 1)
    return F.nullif(strip(found), F.lit(""))


def code_prefix(code: Column) -> Column:
    """File-name prefix of a norm code; null for an unknown code."""
    out = F.lit(None).cast("string")
    for kind in ("L", "D", "LO", "DL"):
        out = F.when(
            code.startswith(kind),
            F.concat(F.lit(KIND_PREFIXES[kind]), F.substr(code, F.lit(len(kind) + 1))),
        ).otherwise(out)
    for special, prefix in SPECIAL_PREFIXES.items():
        out = F.when(code == special, F.lit(prefix)).otherwise(out)
    return out


def code_aliases(code: Column, *titles: Column) -> Column:
    """Normalised aliases of a norm, longest first: specials or pattern, plus titles."""
    shape = r"^(DL|LO|D|L)(\d+)_(\d{4})\z"
    kind = F.regexp_extract(code, shape, 1)
    ref = F.concat(F.regexp_extract(code, shape, 2), F.lit("/"), F.regexp_extract(code, shape, 3))
    out = (
        F.when(kind == "LO", F.array(F.concat(F.lit("ley organica "), ref)))
        .when(kind == "DL", F.array(
            F.concat(F.lit("decreto legislativo "), ref),
            F.concat(F.lit("real decreto legislativo "), ref),
        ))
        .when(kind == "D", F.array(F.concat(F.lit("decreto "), ref)))
        .when(kind == "L", F.array(F.concat(F.lit("ley "), ref)))
        .otherwise(F.array().cast("array<string>"))
    )
    for special, aliases in SPECIAL_ALIASES.items():
        out = F.when(code == special, F.array(*[F.lit(a) for a in aliases])).otherwise(out)
    everything = F.concat(out, F.array(*titles)) if titles else out
    normal = F.array_distinct(
        F.filter(F.transform(everything, normalize_spaces), lambda a: a != "")
    )
    ranked = F.array_sort(
        F.transform(normal, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))
    )
    return F.transform(ranked, lambda s: s["a"])
