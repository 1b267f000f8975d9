"""Text normalisation, tokenisation and fingerprints as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusbank.constants import LIGATURES, STOP_WORDS


def _latin_fold() -> tuple[str, str]:
    """Precomposed Latin letters (U+00C0..U+024F) that decompose to a base letter."""
    src, dst = [], []
    for code in range(0xC0, 0x250):
        folded = "".join(
            c for c in unicodedata.normalize("NFD", chr(code).lower())
            if unicodedata.category(c) != "Mn"
        )
        if folded != chr(code) and len(folded) == 1:
            src.append(chr(code))
            dst.append(folded)
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = _latin_fold()
_WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def normalize_accents(c: Column) -> Column:
    """Lower-case and drop diacritics; null becomes ''.

    Exact for precomposed Latin letters; combining marks are removed too.  Use
    :func:`fold_any_script` where other scripts have to be folded.
    """
    text = F.lower(F.coalesce(c, F.lit("")))
    folded = F.regexp_replace(F.translate(text, _FOLD_FROM, _FOLD_TO), "\\p{Mn}+", "")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(folded)  # ASCII: as is


@F.pandas_udf(StringType())
def fold_any_script(texts: pd.Series) -> pd.Series:
    """Arrow fallback of :func:`normalize_accents` for non-Latin scripts (full NFD)."""
    def fold(t):
        nfd = unicodedata.normalize("NFD", (t or "").lower())
        return "".join(ch for ch in nfd if unicodedata.category(ch) != "Mn")
    return texts.map(fold)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used inside a lambda is otherwise inlined there and computed per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim any Unicode white space (``trim`` only removes blanks); looks at the ends only."""
    return F.btrim(c, F.lit(_WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(normalize_accents(c), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(normalize_accents(c), "(?U)\\s+", " "))


def title_key(c: Column) -> Column:
    """Comparison key of a title; keeps accents."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-záéíóúüñ0-9]+", " "))


def tokens(c: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Alphanumeric runs of two or more characters, stop words removed."""
    found = F.regexp_extract_all(normalize_accents(c), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def clean_document(c: Column) -> Column:
    """Document text: nbsp to blank, soft hyphen and CR removed, runs collapsed."""
    out = F.translate(c, "\u00a0\u00ad\r", " ")
    out = F.regexp_replace(out, "[ \\t]+", " ")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def clean_question_sheet(c: Column) -> Column:
    """Question sheet text: CR to LF, nbsp to blank, runs collapsed."""
    out = F.translate(c, "\r\u00a0", "\n ")
    out = F.regexp_replace(out, "[ \\t]+", " ")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def clean_numbered_sheet(c: Column) -> Column:
    """CR to LF and a leading "n." turned into the question marker."""
    out = F.regexp_replace(F.translate(c, "\r", "\n"), "(?m)^\\s*\\d+\\.\\s+", "\nPREGUNTA: ")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def ligature_fix(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for glyph, letters in LIGATURES.items():
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    return out


def strip_code_fence(c: Column) -> Column:
    """JSON body between the first ``{`` and the last ``}``; null when there is none."""
    return F.nullif(F.regexp_extract(c, "(?s)\\{.*\\}", 0), F.lit(""))


def fingerprint(stem: Column, *options: Column) -> Column:
    """SHA-256 of stem and options, each stripped, one per line; a null is an empty line."""
    lines = [F.coalesce(strip(c), F.lit("")) for c in (stem, *options)]
    return F.sha2(F.concat_ws("\n", *lines), 256)
