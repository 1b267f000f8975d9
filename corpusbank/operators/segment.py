"""Splitting texts: articles, sections, questions, options.

All work stays inside the row (array expressions), so no text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbank.constants import CHUNK_CHARS, HEADING_SUFFIXES, LETTERS, PARSE_ERROR
from corpusbank.functions.text import strip

_MARK = "\u0001"

# fixed values: layout patterns
ARTICLE_HEADING = r"Artículo\s+(\d+)(?:\s+(" + "|".join(HEADING_SUFFIXES) + r"))?"
SECTION_LINE = r"\d+\."
LETTER_LINE = r"[A-Za-z]\)"
QUESTION_LINE = r"(\d{1,4})(?=[\s¿A-ZÁÉÍÓÚÑ])"
OPTION_LINE = r"(?mi)^\s*([a-d])\)\s*"


def split_at(text: Column, line_pattern: str) -> Column:
    """Pieces of the text cut before every line that starts with the pattern."""
    return F.split(F.regexp_replace(text, rf"(?m)^(?=\s*{line_pattern})", _MARK), _MARK)


def _filled(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, lambda p: strip(p)), lambda p: p != "")


def articles(text: Column, heading: str = ARTICLE_HEADING) -> Column:
    """array<struct<number, suffix, text>>; whatever precedes the first heading is dropped."""
    pieces = _filled(F.slice(split_at(text, heading), F.lit(2), F.lit(2**30)))
    return F.transform(pieces, lambda p: F.struct(
        F.regexp_extract(p, rf"^\s*{heading}", 1).alias("number"),
        F.nullif(F.lower(F.regexp_extract(p, rf"^\s*{heading}", 2)), F.lit("")).alias("suffix"),
        p.alias("text"),
    ))


def _fragment(kind: str, reference: Column, article: Column, section: Column | None,
              text: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), reference.alias("reference"), article.alias("article"),
        (F.lit(None).cast("string") if section is None else section).alias("section"),
        text.alias("text"),
    )


def all_fragments(text: Column, heading: str = ARTICLE_HEADING, section: str = SECTION_LINE,
                  letter: str = LETTER_LINE, limit: int = CHUNK_CHARS,
                  label: str = "Artículo") -> Column:
    """Fragments of a document in order, repeats included.

    Up to ``limit`` characters an article is one fragment; longer ones are cut at section
    lines, and sections still too long at letter lines (not any further).
    """
    def of_section(reference, article):
        def build(block, i):
            n = (i + 1).cast("string")
            ref = F.concat(reference, F.lit(", bloque "), n)
            whole = F.array(_fragment("APARTADO", ref, article, n, block))
            parts = F.transform(_filled(split_at(block, letter)), lambda sub, j: _fragment(
                "LETRA",
                F.concat(ref, F.lit("."), (j + 1).cast("string")), article,
                F.concat(n, F.lit("."), (j + 1).cast("string")), sub,
            ))
            return F.when(F.length(block) <= limit, whole).otherwise(parts)
        return build

    def of_article(a):
        name = F.concat_ws(" ", a["number"], a["suffix"])
        reference = F.concat(F.lit(label + " "), name)
        blocks = _filled(split_at(a["text"], section))
        return F.when(
            F.length(a["text"]) <= limit,
            F.array(_fragment("ARTICULO", reference, name, None, a["text"])),
        ).otherwise(F.flatten(F.transform(blocks, of_section(reference, name))))

    return F.flatten(F.transform(articles(text, heading), of_article))


def fragments(text: Column, **options) -> Column:
    """:func:`all_fragments` without exact repeats of (reference, text); the first one stays."""
    return F.array_distinct(all_fragments(text, **options))


def explode_fragments(df: DataFrame, keys: list[str], text: str, **options) -> DataFrame:
    """One row per fragment with its order 1..n inside the document."""
    return df.select(
        *keys, F.posexplode(fragments(F.col(text), **options)).alias("pos", "f")
    ).select(*keys, (F.col("pos") + 1).alias("ord"), "f.*")


def questions(text: Column) -> Column:
    """array<struct<number, text>>: blocks that start with a question number."""
    def starts(p):
        return p.rlike(r"^\s*\d{1,4}[\s¿A-ZÁÉÍÓÚÑ]")

    return F.transform(F.filter(split_at(text, QUESTION_LINE), starts), lambda p: F.struct(
        F.regexp_extract(p, r"^\s*(\d{1,4})", 1).cast("int").alias("number"),
        strip(F.regexp_replace(p, r"^\s*\d{1,4}", "")).alias("text"),
    ))


def marked_questions(text: Column) -> Column:
    """Blocks after the markers "Pregunta n:", "PREGUNTA:" or "n. ¿"."""
    marked = F.translate(text, "\ue008", "•")
    marked = F.regexp_replace(marked, r"(?mi)^\s*•?\s*Pregunta\s+\d+\s*:\s*", "\nPREGUNTA: ")
    marked = F.regexp_replace(marked, r"(?m)^\s*\d+\.\s+(?=¿)", "\nPREGUNTA: ")
    return _filled(F.split(marked, r"(?m)^\s*PREGUNTA:\s*"))


def _option_letters(block: Column) -> Column:
    return F.transform(F.regexp_extract_all(block, F.lit(OPTION_LINE), F.lit(1)),
                       lambda x: F.upper(x))


def parse_options(block: Column) -> Column:
    """struct<stem, options(map), reason>: exactly four options in the order A, B, C, D."""
    letters = _option_letters(block)
    pieces = F.transform(F.split(block, OPTION_LINE), lambda p: strip(p))
    stem = F.element_at(pieces, 1)
    texts = F.slice(pieces, 2, 4)
    abcd = F.array(*[F.lit(x) for x in LETTERS])
    reason = (
        F.when(F.size(letters) != 4, PARSE_ERROR["count"])
        .when(letters != abcd, PARSE_ERROR["order"])
        .when(stem == "", PARSE_ERROR["stem"])
        .when(F.exists(texts, lambda t: t == ""), PARSE_ERROR["blank"])
    )
    return F.struct(
        F.when(reason.isNull(), stem).alias("stem"),
        F.when(reason.isNull(), F.map_from_arrays(abcd, texts)).alias("options"),
        reason.alias("reason"),
    )


def parse_options_lenient(block: Column) -> Column:
    """struct<stem, options>, null unless the first four of at least four options are A-D."""
    bullets = F.regexp_replace(block, r"(?mi)^\s*•?\s*([a-d])\)\s*", "\n$1) ")
    letters = F.slice(_option_letters(bullets), 1, 4)
    pieces = F.transform(F.split(bullets, OPTION_LINE, 5), lambda p: strip(p))
    good = (
        (F.size(letters) == 4)
        & (F.array_sort(letters) == F.array(*[F.lit(x) for x in LETTERS]))
        & (F.element_at(pieces, 1) != "")
    )
    return F.when(good, F.struct(
        F.element_at(pieces, 1).alias("stem"),
        F.map_from_arrays(letters, F.slice(pieces, 2, 4)).alias("options"),
    ))
