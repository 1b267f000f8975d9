"""Scalar functions against Python on small literals."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusbank.constants import STOP_WORDS
from corpusbank.functions import citation, features, items, text

TEXTS = ["", "  Según el ARTÍCULO 52\n\tde la Ley ", "ñandú ÇÓDIGO año 2024", "ñó ya", "ﬁn ŐÜß  x "]


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).first()["r"]


def fold(s):
    nfd = unicodedata.normalize("NFD", (s or "").lower())
    return "".join(c for c in nfd if unicodedata.category(c) != "Mn")


@pytest.mark.parametrize("value", TEXTS + [None])
def test_accents_tokens_slug(spark, value):
    df = spark.createDataFrame([(value,)], "t string").select(
        text.normalize_accents(F.col("t")).alias("a"), text.fold_any_script(F.col("t")).alias("b"),
        text.tokens(F.col("t")).alias("k"), text.slugify(F.col("t")).alias("s"),
        text.normalize_spaces(F.col("t")).alias("n"), text.strip(F.col("t")).alias("p"))
    row = df.first()
    assert row["a"] == fold(value) == row["b"]
    assert row["k"] == [w for w in re.findall("[a-z0-9]{2,}", fold(value)) if w not in STOP_WORDS]
    assert row["s"] == re.sub("[^a-z0-9]+", "_", fold(value)).strip("_")
    assert row["n"] == re.sub(r"\s+", " ", fold(value)).strip()
    assert row["p"] == (None if value is None else value.strip())


def test_fingerprint(spark):
    got = one(spark, text.fingerprint(*[F.col(c) for c in "sabcd"]), s=" ¿Qué? \n", a="1\t", b=" 2", c="3", d="4 ")
    assert got == hashlib.sha256("¿Qué?\n1\n2\n3\n4".encode()).hexdigest()


def test_clean_and_fences(spark):
    raw = "a  b­\r\n\n\n\nc \t d "
    assert one(spark, text.clean_document(F.col("x")), x=raw) == "a b\n\nc d"
    assert one(spark, text.clean_question_sheet(F.col("x")), x="a\rb c") == "a\nb c"
    assert one(spark, text.clean_numbered_sheet(F.col("x")), x="12. Uno\n3. Dos") == "PREGUNTA: Uno\n\nPREGUNTA: Dos"
    assert one(spark, text.strip_code_fence(F.col("x")), x='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert one(spark, text.strip_code_fence(F.col("x")), x="nada") is None
    assert one(spark, text.ligature_fix(F.col("x")), x="oﬃcina ﬁn") == "officina fin"


@pytest.mark.parametrize("raw,want", [
    ("1-3", ["1", "2", "3"]), ("24, 36 y 40 bis", ["24", "36", "40 bis"]), ("5-2", None), ("x", None),
    ("4 y 11-13", ["4", "11", "12", "13"]), ("2 - 3 Y 3", ["2", "3"]), ("10, 9 bis, 9", ["9", "9 bis", "10"]),
])
def test_expand_ranges(spark, raw, want):
    assert one(spark, citation.expand_ranges(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw,want", [
    ("007", "7"), (" 12  Bis ", "12 bis"), ("3ter", "3 ter"), ("4 decies", None), ("anexo", None), ("0", "0")])
def test_normalize_article(spark, raw, want):
    assert one(spark, citation.normalize_article(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw,expr", [
    ("Ley 39_2015 articulos 1-33.pdf", "1-33"), ("Ley 6_2025 artículo 59.pdf", "59"), ("Decreto 77_2019.pdf", None)])
def test_coverage_expression(spark, raw, expr):
    assert one(spark, citation.coverage_expression(F.col("x")), x=raw) == expr


def test_codes(spark):
    codes = {"CE": "Constitucion Española", "LO3_2007": "Ley Orgánica 3_2007", "L9_2017": "Ley 9_2017",
             "DL5_2015": "Decreto Legislativo 5_2015", "D25_2017": "Decreto 25_2017", "X1": None}
    for code, prefix in codes.items():
        assert one(spark, citation.code_prefix(F.col("x")), x=code) == prefix
    assert one(spark, citation.code_aliases(F.col("x"), F.lit("Ley  39_2015")), x="L39_2015") == ["ley 39/2015", "ley 39_2015"]
    assert one(spark, citation.code_aliases(F.col("x")), x="TUE")[-1] == "tue"


@pytest.mark.parametrize("raw,article,norm", [
    ("Según el artículo 52 de la Ley 39/2015...", "52", "L39_2015"),
    ("ARTICULOS 40 BIS, Ley  Orgánica 3 / 2007", "40 bis", "LO3_2007"),
    ("real decreto legislativo 5/2015", None, "DL5_2015"), ("¿Cuál?", None, None),
])
def test_citations(spark, raw, article, norm):
    assert one(spark, citation.cited_article(F.col("x")), x=raw) == article
    assert one(spark, citation.cited_norm(F.col("x")), x=raw) == norm


@pytest.mark.parametrize("decision,confidence,state", [
    ("VALIDADA", 0.98, "VALIDADA"), ("VALIDADA", 0.80, "A_REVISAR"), ("VALIDADA", 0.30, "RECHAZADA"),
    ("RECHAZADA", 0.99, "RECHAZADA"), ("A_REVISAR", 0.99, "A_REVISAR"), ("A_REVISAR", 0.2, "RECHAZADA")])
def test_thresholds(spark, decision, confidence, state):
    assert one(spark, items.decide(F.col("d"), F.col("c")), d=decision, c=confidence) == state


@pytest.mark.parametrize("n,qtype", [(1, "ESPECIAL_TEORIA"), (50, "ESPECIAL_TEORIA"), (51, "ESPECIAL_PRACTICA"),
                                     (80, "ESPECIAL_INFORMATICA"), (110, "GENERAL"), (111, None), (0, None)])
def test_positions(spark, n, qtype):
    assert one(spark, items.position_type(F.col("n")), n=n) == qtype


def test_options(spark):
    df = spark.createDataFrame([({"A": "1", "B": "2", "C": "3", "D": "4"},), ({"A": "1", "B": "2", "C": "3", "D": " "},),
                                ({"A": "1", "B": "2", "C": "3"},), (None,)], "o map<string,string>")
    rows = df.select(items.letters_complete(F.col("o")).alias("c"), items.same_letters(F.col("o")).alias("s")).collect()
    assert [r["c"] for r in rows] == [True, False, False, False] and [r["s"] for r in rows[:3]] == [True, True, False]


def test_practical_score(spark):
    case = "Mariano solicita el 5 de mayo de 2024 a la AEAT el 10% y posteriormente presenta recurso"
    assert one(spark, features.practical_score(F.col("x")), x=case) == 2 + 2 + 2 + 2 + 2 + 1 + 2 + 1
    assert one(spark, features.practical_score(F.col("x"), strict=True), x="la mayoría") == 2
    assert one(spark, features.practical_score(F.col("x")), x="la mayoría") == 0
