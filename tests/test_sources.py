"""Readers and writers on real files."""

import hashlib
import os

from pyspark.sql import functions as F

from corpusbank.functions import features
from corpusbank.operators import dedup, grading
from corpusbank.queries import io as queries
from corpusbank.queries.registry import Tables
from corpusbank.sources import readers, writers
from corpusbank.session import work_dir

SYLLABUS = """[CONVOCATORIA]
cuerpo = X

[PARTES_TEMARIO]
1 = General
2 = Especial-Informática

; comentario
[TEMARIO_GENERAL]
1 = Título: uno|Ley 1_2000 articulos 1-3.pdf|Ley 1_2000 articulos 1-3.pdf
2 = Sin documentos

[TEMARIO_ESPECIAL_INFORMATICA]
15 = Hojas | I_Hojas.pdf | Sin extensión

[NORMAS_EXAMEN]
numero_preguntas = 110

[DISTRIBUCION_PREGUNTAS]
General = 30
"""


def test_syllabus(spark, tmp_path):
    (tmp_path / "a.cfg").write_text(SYLLABUS, encoding="utf-8")
    entries = readers.read_syllabus(spark, str(tmp_path / "a.cfg"))
    topics = readers.syllabus_topics(entries, "file")
    assert {(r["part"], r["number"], r["problem"]) for r in topics.collect()} == {
        ("General", 1, None), ("General", 2, "pieces"), ("Especial-Informática", 15, None)}
    docs = readers.topic_documents(topics, "file").collect()
    assert {(r["number"], r["document"], r["is_file"]) for r in docs} == {
        (1, "Ley 1_2000 articulos 1-3.pdf", True), (15, "I_Hojas.pdf", True), (15, "Sin extensión", False)}
    assert {(r["part"], r["n"]) for r in readers.syllabus_distribution(entries, "file").collect()} == {
        ("General", 30), (None, 110)}


def test_bundled_syllabus(spark, tmp_path):
    """Many texts a file: as many entries as from files of their own, in a bounded number of files."""
    rows = spark.createDataFrame([(n, SYLLABUS.replace("110", str(n))) for n in range(25)], "k long, text string")
    writers.write_bundles(rows.coalesce(1), str(tmp_path / "x"), "k", "text", most=10)
    assert len(list((tmp_path / "x").glob("part-*"))) == 3
    entries = readers.read_syllabus(spark, str(tmp_path / "x"), bundles=True)
    (tmp_path / "a.cfg").write_text(SYLLABUS, encoding="utf-8")
    one = readers.read_syllabus(spark, str(tmp_path / "a.cfg"))
    assert entries.count() == 25 * one.count()
    sizes = readers.syllabus_distribution(entries, "file").filter("part IS NULL").collect()
    assert {(int(r["file"].split("#")[1]), r["n"]) for r in sizes} == {(n, n) for n in range(25)}


def test_syllabus_query_writes_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "new_path", lambda *_: str(tmp_path / "out"))
    t = Tables(spark, "/root/testdata/sf0.01")
    assert queries.syllabus_files(t).select("k").distinct().count() == t.supplier.count()
    assert len(list((tmp_path / "out").rglob("part-*"))) < 10


def test_distribution_query_of_many_suppliers(spark, tmp_path, monkeypatch):
    """All parts and sizes of more suppliers than a bundle holds, from a few files."""
    count = 2 * queries.writers.BUNDLE + 500
    spark.range(count).select(
        F.col("id").alias("s_suppkey"), F.concat(F.lit("Supplier#"), "id").alias("s_name"),
        (F.col("id") % 25).cast("int").alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(queries, "new_path", lambda *_: str(tmp_path / "out"))
    got = queries.scan_distribution(Tables(spark, str(tmp_path))).collect()
    want = {x for n in range(count) for x in (
        (n, "General", n % 25), (n, "Especial-Teoría", 50), (n, None, n + 100))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert len(list((tmp_path / "out").rglob("part-*"))) < 10


def test_catalogue_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "normas.csv"
    path.write_bytes("﻿codigo;titulo_oficial;titulo_corto;tipo\nCE;Constitución Española;CE 78;C\n ;x;y;z\nL39_2015;Ley 39/2015, de 1 de octubre;;Ley\n".encode())
    rows = {r["code"]: r for r in readers.read_catalogue(spark, str(path)).collect()}
    assert set(rows) == {"CE", "L39_2015"}
    assert rows["L39_2015"]["prefix"] == "Ley 39_2015"
    assert rows["L39_2015"]["aliases"] == ["ley 39/2015, de 1 de octubre", "ley 39/2015"]


def test_hashed_files_and_newest(spark, tmp_path):
    for i, name in enumerate(["a.pdf", "b.pdf"]):
        (tmp_path / name).write_bytes(bytes([i]) * 10)
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    files = readers.read_hashed_files(spark, str(tmp_path))
    known = files.filter(F.col("file").endswith("a.pdf"))
    fresh = dedup.unseen(files, known, "hash").collect()
    assert [r["hash"] for r in fresh] == [hashlib.sha256(b"\x01" * 10).hexdigest()]
    assert readers.newest_file(files).first()["file"].endswith("b.pdf")


def test_question_file(spark, tmp_path):
    (tmp_path / "C1_x_extraido.json").write_text(
        '{"archivo_origen": "C1_x.pdf",\n "preguntas": [{"enunciado": "¿?", "opciones": {"A": "1"}, "pagina_pdf": 3,\n'
        ' "incidencias": ["i"]}, {"enunciado": null}]}', encoding="utf-8")
    rows = readers.read_question_files(spark, str(tmp_path / "*_extraido.json")).orderBy("indice").collect()
    assert [r["indice"] for r in rows] == [1, 2]
    assert rows[0]["pregunta"]["opciones"]["A"] == "1" and rows[1]["pregunta"]["enunciado"] is None
    group = spark.range(1).select(readers.source_group(F.lit("c1_7_extraido.json"))).first()[0]
    assert group == "C1"


def test_feature_examples(spark):
    df = spark.createDataFrame([(1, "a", "Mariano solicita 30 euros"), (2, "a", "nada")], "k int, c string, t string")
    rows = grading.feature_examples(df, "c", "k", features.phrase_flags(F.col("t"))).collect()
    assert {r["feature"] for r in rows} == {"person", "action", "amount", "subject_action", "action_datum"}
    assert {r["k"] for r in rows} == {1}


def test_work_dir_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        assert work_dir(spark) == shared.rstrip("/")
