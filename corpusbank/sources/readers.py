"""Readers: norm catalogue, syllabus, question files, many files, hashed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusbank.constants import RECORD
from corpusbank.functions.citation import code_aliases, code_prefix
from corpusbank.functions.text import slugify, strip
from corpusbank.session import stage

CATALOGUE_SCHEMA = "codigo string, titulo_oficial string, titulo_corto string, tipo string"

QUESTION_FILE_SCHEMA = T.StructType([
    T.StructField("archivo_origen", T.StringType()),
    T.StructField("preguntas", T.ArrayType(T.StructType([
        T.StructField("numero", T.LongType()),
        T.StructField("enunciado", T.StringType()),
        T.StructField("opciones", T.StructType(
            [T.StructField(x, T.StringType()) for x in "ABCD"])),
        T.StructField("respuesta_correcta", T.StringType()),
        T.StructField("pie_completo", T.StringType()),
        T.StructField("articulo", T.StringType()),
        T.StructField("norma", T.StringType()),
        T.StructField("confianza_extraccion", T.DoubleType()),
        T.StructField("incidencias", T.ArrayType(T.StringType())),
        T.StructField("pagina_pdf", T.LongType()),
    ]))),
])


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(code, official_title, short_title, kind, prefix, aliases) of a ``;`` CSV file."""
    raw = (
        spark.read.schema(CATALOGUE_SCHEMA).option("sep", ";").option("header", True)
        .option("encoding", "UTF-8").csv(path)
    )
    code = strip(F.translate("codigo", "﻿", ""))
    return raw.select(
        code.alias("code"), strip(F.col("titulo_oficial"))
        .alias("official_title"),
        strip(F.col("titulo_corto")).alias("short_title"), F.col("tipo").alias("kind"),
        code_prefix(code).alias("prefix"),
        code_aliases(code, F.coalesce("titulo_corto", F.lit("")),
                     F.coalesce("titulo_oficial", F.lit(""))).alias("aliases"),
    ).filter("code <> ''")


def syllabus_entries(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, pos, name, value) of INI texts, one text per row; comments dropped."""
    pieces = F.slice(F.split(F.regexp_replace(
        F.col(text), "(?m)^\\s*(?=\\[[^\\]\\n]+\\])", "\u0001"), "\u0001"), F.lit(2), F.lit(2**30))
    sections = texts.select(key, F.posexplode(pieces).alias("sec", "piece"))
    lines = sections.select(
        key, "sec", F.regexp_extract("piece", "^\\[([^\\]\\n]+)\\]", 1).alias("section"),
        F.posexplode(F.split("piece", "\n")).alias("pos", "line"))
    shape = "^\\s*([^#;=:\\[][^=:]*?)\\s*[=:](.*)\\z"
    return lines.filter(F.col("line").rlike(shape)).select(
        key, "section", "pos", F.regexp_extract("line", shape, 1).alias("name"),
        strip(F.regexp_extract("line", shape, 2)).alias("value"))


def syllabus_topics(entries: DataFrame, key: str) -> DataFrame:
    """(key, part, part_order, number, title, documents, problem) of the topic sections.

    ``problem`` names what is wrong: an unknown part, fewer than two pieces or a repeated
    (part, number); good topics have null.
    """
    parts = entries.filter("section = 'PARTES_TEMARIO'").select(
        key, slugify(F.col("value")).alias("slug"), F.col("value").alias("part"),
        F.col("name").try_cast("int").alias("part_order"))
    pieces = F.filter(F.transform(F.split("value", "\\|"), lambda p: strip(p)),
                      lambda p: p != "")
    topics = entries.filter(F.col("section").startswith("TEMARIO_")).select(
        key, slugify(F.regexp_replace("section", "^TEMARIO_", "")).alias("slug"),
        F.col("name").try_cast("int").alias("number"), pieces.alias("pieces"))
    joined = topics.join(parts, [key, "slug"], "left")
    counts = topics.groupBy(key, "slug", "number").agg(F.count(F.lit(1)).alias("_n"))
    problem = (
        F.when(F.col("part").isNull(), "part").when(F.size("pieces") < 2, "pieces")
        .when(F.col("_n") > 1, "repeated")
    )
    return joined.join(counts, [key, "slug", "number"]).select(
        key, "part", "part_order", "number", F.get("pieces", F.lit(0)).alias("title"),
        F.slice("pieces", F.lit(2), F.greatest(F.size("pieces"), F.lit(1))).alias("documents"),
        problem.alias("problem"))


def topic_documents(topics: DataFrame, key: str) -> DataFrame:
    """(key, part, number, title, document, is_file) without repeats inside a topic."""
    return topics.filter("problem IS NULL").select(
        key, "part", "number", "title", F.explode(F.array_distinct("documents")).alias("document")
    ).withColumn("is_file", F.lower("document").endswith(".pdf"))


def syllabus_distribution(entries: DataFrame, key: str) -> DataFrame:
    """(key, part, n) of the question distribution and the exam size as part null."""
    return entries.filter("section = 'DISTRIBUCION_PREGUNTAS'").select(
        key, F.col("name").alias("part"), F.col("value").try_cast("int").alias("n")
    ).unionByName(entries.filter(
        "section = 'NORMAS_EXAMEN' AND name = 'numero_preguntas'"
    ).select(key, F.lit(None).cast("string").alias("part"),
             F.col("value").try_cast("int").alias("n")))


def bundled(files: DataFrame, text: str) -> DataFrame:
    """The rows of bundles (see ``writers.write_bundles``), one for each of their texts, with ``member``.

    ``member`` is the name of the text; a bundle without texts gives one row with null.
    """
    pieces = F.slice(F.split(text, RECORD), F.lit(2), F.lit(2**30))
    return files.withColumn("_piece", F.explode_outer(pieces)).withColumn(
        "member", F.substring_index("_piece", "\n", 1)).withColumn(
        text, F.expr("substr(_piece, instr(_piece, '\\n') + 1)")).drop("_piece")


def member_path(file, member):
    """Path of a text of a bundle."""
    return F.concat(file, F.lit("#"), member)


def read_syllabus(spark: SparkSession, path: str, bundles: bool = False) -> DataFrame:
    """Entries of every syllabus file under the path (one whole file per row).

    With ``bundles`` every file holds many syllabuses, and ``file`` ends with ``#`` and their name.
    """
    texts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    if bundles:
        texts = bundled(texts, "text").filter("member IS NOT NULL").withColumn(
            "file", member_path(F.col("file"), F.col("member")))
    return syllabus_entries(texts, "file", "text")


def read_question_files(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(archivo_origen, file, indice, pregunta, problem) of extracted question files.

    A document whose ``preguntas`` is missing or empty and a file (or line) that is no JSON give
    a single row with a null question and a ``problem``: ``missing``, ``empty`` or ``broken``.
    """
    schema = T.StructType([*QUESTION_FILE_SCHEMA.fields, T.StructField("_broken", T.StringType())])
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").json(
        path, multiLine=multi_line)
    problem = (
        F.when(F.col("_broken").isNotNull(), "broken")
        .when(F.col("preguntas").isNull(), "missing").when(F.size("preguntas") == 0, "empty"))
    return raw.select(
        "archivo_origen", F.col("_metadata.file_path").alias("file"), problem.alias("problem"),
        F.posexplode_outer(F.when(problem.isNull(), F.col("preguntas"))).alias("pos", "pregunta"),
    ).select("archivo_origen", "file", (F.col("pos") + 1).alias("indice"), "pregunta", "problem")


def source_group(file_name):
    """Group key of a file: its name up to the first "_", upper-cased."""
    return F.upper(F.split_part(file_name, F.lit("_"), F.lit(1)))


def read_hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, hash, modified) of the files under a path; the bytes stay in the task."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"), F.sha2("content", 256).alias("hash"),
        F.col("modificationTime").alias("modified"))


def newest_file(files: DataFrame) -> DataFrame:
    """The most recently modified file (equal times: the last name)."""
    return files.agg(F.max_by(
        F.struct("file", "hash", "modified"), F.struct("modified", "file")).alias("f")).select("f.*")


LEDGER_SCHEMA = "hash string, file string, modified timestamp, length long, member string"
_BYTES = "ISO-8859-1"  # a character for every byte
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path`` (format ``binaryFile``), listed in tasks of many folders each.

    Spark makes a task for every folder up to 10,000, and starting it takes longer than to list one.
    """
    old = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    finally:
        spark.conf.set(_LISTING, old)


def ingest_files(spark: SparkSession, path: str, ledger: str, bundles: bool = False) -> DataFrame:
    """(file, hash, status) of the files below ``path`` that the ledger doesn't know, by content.

    The listing is compared with the append-only ledger by name, time and length; only the
    bytes of files that it lacks are read (a time range on the scan, then a semi-join).  A file is
    ``new`` if its content is neither in the ledger nor in an earlier file of the run, else
    ``known``; all of them are appended to the ledger.  Running again takes nothing.

    With ``bundles`` every file holds many texts (see ``writers.write_bundles``), each with the hash of
    its own bytes and a status; their ``file`` ends with ``#`` and their name.  A file that doesn't begin
    as a bundle is one text.
    """
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("append").parquet(ledger)
    seen = spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    files = list_files(spark, path)
    listed = files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"),
                          "length")
    keys = ["file", "modified", "length"]
    fresh = stage(listed.join(seen.select(keys).distinct(), keys, "left_anti"), "fresh-files")
    low, high = (F.timestamp_micros(F.lit(x)) for x in fresh.select(
        F.unix_micros("modified").alias("m")).agg(F.min("m"), F.max("m")).first())  # two times
    rows = files.filter((F.col("modificationTime") >= low) & (F.col("modificationTime") <= high))
    read = rows.join(fresh.select(F.col("file").alias("path")), "path", "left_semi").select(
        F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length", "content")
    if bundles:
        decoded = F.decode("content", _BYTES)
        read = bundled(read.select(
            *keys, F.when(~decoded.startswith(RECORD), F.col("content")).alias("_other"),
            F.when(decoded.startswith(RECORD), decoded).alias("content")), "content").withColumn(
            "content", F.coalesce("_other", F.encode("content", _BYTES)))
    else:
        read = read.withColumn("member", F.lit(None).cast("string"))
    whole = F.coalesce(member_path(F.col("file"), F.col("member")), "file")
    hashed = stage(read.select(F.sha2("content", 256).alias("hash"), *keys, "member",
                               whole.alias("whole")), "fresh-hashes")
    texts = hashed.filter("member IS NOT NULL OR length > 0") if bundles else hashed
    first = texts.groupBy("hash").agg(F.min("whole").alias("whole")).join(
        seen.select("hash").distinct(), "hash", "left_anti").withColumn("status", F.lit("new"))
    out = stage(texts.join(first, ["hash", "whole"], "left").select(
        F.col("whole").alias("file"), "hash", F.coalesce("status", F.lit("known")).alias("status")),
        "ingested")
    hashed.select("hash", *keys, "member").write.mode("append").parquet(ledger)
    return out
