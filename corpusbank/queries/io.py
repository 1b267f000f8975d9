"""Sources, sinks and streaming jobs over files written from the tables."""

from pyspark.sql import functions as F

from corpusbank.functions.items import call_cost, prepare_error
from corpusbank.plans.bank import import_questions, with_fingerprint
from corpusbank.plans.classify import classification_cascade, coverage_index
from corpusbank.queries.classification import (
    ALIASES_SQL, cascade_questions, corpus_terms, event_judge, norm_aliases, text_topics,
)
from corpusbank.queries.coverage import COV_SQL, coverage_table
from corpusbank.queries.items import ERROR_SQL, RAW_SQL, raw_questions
from corpusbank.queries.maintenance import (
    FOOTER_CTES, FOOTER_SELECT, IMPORT_SQL, LABEL_SQL, import_raw, labelled, stored_raw,
)
from corpusbank.queries.registry import SQL, query
from corpusbank.queries.search import allowed_sources
from corpusbank.queries.text import CODE_SQL, TAIL_SQL, norm_code, spaces_sql
from corpusbank.session import new_path, stage
from corpusbank.sources import readers, versions, writers
from corpusbank.streaming import jobs


@query("scan_catalog", f"""
WITH c AS (SELECT s_suppkey, {CODE_SQL} AS code, s_suppkey || '/' || (1980 + s_nationkey) AS ref, 'Título ' || s_name AS title FROM {TAIL_SQL}),
a AS (SELECT s_suppkey, unnest(list_concat(CASE s_suppkey % 7 WHEN 0 THEN ['ley ' || ref] WHEN 1 THEN ['ley organica ' || ref] WHEN 2 THEN ['decreto ' || ref]
   WHEN 3 THEN ['decreto legislativo ' || ref, 'real decreto legislativo ' || ref] WHEN 4 THEN ['constitucion española', 'constitucion', 'ce']
   WHEN 5 THEN ['tratado de la union europea', 'tratado union europea', 'tue'] ELSE [] END, [title])) AS raw FROM c),
n AS (SELECT DISTINCT s_suppkey, {spaces_sql('raw')} AS alias FROM a)
SELECT code, title AS official_title, CASE s_suppkey % 7 WHEN 0 THEN 'Ley ' || substr(code, 2) WHEN 1 THEN 'Ley Orgánica ' || substr(code, 3) WHEN 2 THEN 'Decreto ' || substr(code, 2)
  WHEN 3 THEN 'Decreto Legislativo ' || substr(code, 3) WHEN 4 THEN 'Constitucion Española' WHEN 5 THEN 'Tratado Union Europea' END AS prefix,
  (SELECT string_agg(alias, '|' ORDER BY length(alias) DESC, alias) FROM n WHERE n.s_suppkey = c.s_suppkey) AS aliases FROM c""")
def scan_catalog(t):
    path = new_path(t.spark, "catalogue")
    rows = t.supplier.select(
        F.concat(F.lit(" "), norm_code()).alias("codigo"),
        F.concat(F.lit("Título "), F.col("s_name")).alias("titulo_oficial"),
        F.lit(None).cast("string").alias("titulo_corto"), F.lit("Ley").alias("tipo"))
    blank = t.nation.select(F.lit(None).cast("string").alias("codigo"), F.col("n_name").alias("titulo_oficial"),
                            F.lit("x").alias("titulo_corto"), F.lit("Ley").alias("tipo"))
    rows.unionByName(blank).write.option("sep", ";").option("header", True).option(
        "ignoreLeadingWhiteSpace", False).csv(path)
    return readers.read_catalogue(t.spark, path).select(
        "code", "official_title", "prefix", F.array_join("aliases", "|").alias("aliases"))


def syllabus_files(t):
    """One INI text per supplier, written in bundles with a record separator and read back."""
    path = new_path(t.spark, "syllabus")
    n = F.col("s_suppkey").cast("string")
    topic = F.concat(n, F.lit(" = Tema: "), F.col("s_name"), F.lit("|Doc "), n, F.lit(".pdf| |Doc "), n,
                     F.lit(".pdf|Anexo "), (F.col("s_suppkey") % 7).cast("string"))
    text = F.concat(
        F.lit("[CONVOCATORIA]\nclave = "), n,
        F.lit("\n\n[PARTES_TEMARIO]\n1 = General\n2 = Especial-Teoría\n\n[TEMARIO_GENERAL]\n# nota = 1\n"), topic,
        F.lit("\n\n[TEMARIO_ESPECIAL_TEORIA]\n1 = "), F.when(F.col("s_suppkey") % 3 == 0, "Solo título").otherwise("Título|Ley.PDF"),
        F.when(F.col("s_suppkey") % 5 == 0, "\n1 = Otra vez|B.pdf").otherwise(""),
        F.lit("\n[TEMARIO_OTRA]\n9 = T|x.pdf\n[NORMAS_EXAMEN]\nnumero_preguntas = "), (F.col("s_suppkey") + 100).cast("string"),
        F.lit("\n[DISTRIBUCION_PREGUNTAS]\nGeneral = "), F.col("s_nationkey").cast("string"), F.lit("\nEspecial-Teoría = 50\n"))
    writers.write_bundles(t.supplier.select("s_suppkey", text.alias("value")), path, "s_suppkey", "value")
    key = F.regexp_extract("file", "#(\\d+)$", 1).cast("long")
    return readers.read_syllabus(t.spark, path, bundles=True).withColumn("k", key)


@query("scan_syllabus", """
WITH s AS (SELECT s_suppkey AS k, s_name, s_suppkey % 3 = 0 AS bare, s_suppkey % 5 = 0 AS rep FROM supplier),
d AS (SELECT k, 'General' AS part, CAST(k AS INTEGER) AS number, 'Tema: ' || s_name AS title, NULL AS problem, unnest(['Doc ' || k || '.pdf', 'Anexo ' || k % 7]) AS document FROM s
  UNION ALL SELECT k, 'Especial-Teoría', 1, CASE WHEN bare THEN 'Solo título' ELSE 'Título' END, CASE WHEN bare THEN 'pieces' WHEN rep THEN 'repeated' END, CASE WHEN NOT bare AND NOT rep THEN 'Ley.PDF' END FROM s
  UNION ALL SELECT k, 'Especial-Teoría', 1, 'Otra vez', 'repeated', NULL FROM s WHERE rep
  UNION ALL SELECT k, NULL, 9, 'T', 'part', NULL FROM s)
SELECT k, part, number, title, problem, document, lower(document) LIKE '%.pdf' AS is_file FROM d""")
def scan_syllabus(t):
    topics = readers.syllabus_topics(syllabus_files(t), "k")
    good = readers.topic_documents(topics, "k").withColumn("problem", F.lit(None).cast("string"))
    bad = topics.filter("problem IS NOT NULL").select(
        "k", "part", "number", "title", "problem", F.lit(None).cast("string").alias("document"),
        F.lit(None).cast("boolean").alias("is_file"))
    return good.select(bad.columns).unionByName(bad)


@query("scan_distribution", """
SELECT s_suppkey AS k, unnest(['General', 'Especial-Teoría', NULL]) AS part, unnest([s_nationkey, 50, CAST(s_suppkey + 100 AS INTEGER)]) AS n FROM supplier""")
def scan_distribution(t):
    return readers.syllabus_distribution(syllabus_files(t), "k")


def question_documents(t):
    """(p_partkey, archivo, doc): a question document per part; some have no or an empty list."""
    question = F.struct(
        F.col("p_size").cast("long").alias("numero"), F.col("p_name").alias("enunciado"),
        F.struct(F.col("p_brand").alias("A"), F.col("p_type").alias("B"), F.lit("c").alias("C"),
                 F.lit(None).cast("string").alias("D")).alias("opciones"),
        F.lit("A").alias("respuesta_correcta"), F.col("p_type").alias("norma"),
        F.array(F.lit("x"), F.col("p_brand")).alias("incidencias"), F.col("p_partkey").alias("pagina_pdf"))
    twice = F.when(F.col("p_type") == "PROMO", F.array().cast(f"array<{_struct_type()}>")).when(
        F.col("p_type") == "LARGE", F.array(question, question)).when(
        (F.col("p_type") == "SMALL") & (F.col("p_size") % 2 == 0), None).otherwise(F.array(question))
    return t.part.select(
        "p_partkey",
        F.concat(F.lower("p_type"), F.lit("_"), (F.col("p_size") % 4).cast("string"), F.lit("_extraido.json")).alias("archivo"),
        F.struct(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("archivo_origen"),
                 twice.alias("preguntas")).alias("doc"))


def _struct_type():
    return ("struct<numero:bigint,enunciado:string,opciones:struct<A:string,B:string,C:string,D:string>,"
            "respuesta_correcta:string,norma:string,incidencias:array<string>,pagina_pdf:bigint>")


# 50 documents a file; every seventh file is cut off and therefore broken
@query("scan_questions_json", """
WITH p AS (SELECT *, p_partkey // 50 AS grp, p_partkey // 50 % 7 = 5 AS cut FROM part)
SELECT grp, 'f' || p_partkey AS archivo_origen, i AS indice, CASE WHEN i IS NOT NULL THEN p_name END AS enunciado, CASE WHEN i IS NOT NULL THEN p_type END AS opt_b,
  CASE WHEN i IS NOT NULL THEN p_partkey END AS pagina_pdf, CASE WHEN i IS NOT NULL THEN p_brand END AS incidencia,
  CASE WHEN p_type = 'PROMO' THEN 'empty' WHEN i IS NULL THEN 'missing' END AS problem
FROM p, unnest(CASE WHEN p_type = 'PROMO' OR p_type = 'SMALL' AND p_size % 2 = 0 THEN [CAST(NULL AS INTEGER)] WHEN p_type = 'LARGE' THEN [1, 2] ELSE [1] END) u(i) WHERE NOT cut
UNION ALL SELECT DISTINCT grp, NULL, CAST(NULL AS INTEGER), NULL, NULL, CAST(NULL AS BIGINT), NULL, 'broken' FROM p WHERE cut""")
def scan_questions_json(t):
    """Whole multi-line files, each a JSON array of documents."""
    path = new_path(t.spark, "questions")
    grp = F.floor(F.col("p_partkey") / 50)
    pretty = F.to_json("doc", {"pretty": "true"})
    files = question_documents(t).groupBy(grp.alias("grp")).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", pretty.alias("j")))),
                    lambda r: r["j"]), ",\n").alias("body"))
    whole = F.concat(F.lit("[\n"), "body", F.lit("\n]"))
    cut = F.concat(F.lit("[\n"), F.expr("left(body, length(body) - 20)"))
    files.select("grp", F.when(F.col("grp") % 7 == 5, cut).otherwise(whole).alias("value")
                 ).write.partitionBy("grp").text(path)
    rows = readers.read_question_files(t.spark, path)
    return rows.select(
        F.regexp_extract("file", "grp=(\\d+)", 1).cast("long").alias("grp"), "archivo_origen", "indice",
        "pregunta.enunciado", F.col("pregunta.opciones.B").alias("opt_b"), "pregunta.pagina_pdf",
        F.get("pregunta.incidencias", F.lit(1)).alias("incidencia"), "problem")


@query("scan_many_files", """
SELECT upper(p_type) AS grp, COUNT(DISTINCT p_size % 4) AS files, SUM(CASE p_type WHEN 'LARGE' THEN 2 ELSE 1 END)::BIGINT AS questions FROM part WHERE p_type <> 'PROMO' AND NOT (p_type = 'SMALL' AND p_size % 2 = 0) GROUP BY p_type""")
def scan_many_files(t):
    path = new_path(t.spark, "many")
    question_documents(t).select("archivo", "doc.*").write.partitionBy("archivo").json(path)
    rows = readers.read_question_files(t.spark, f"{path}/archivo=*_extraido.json", multi_line=False)
    name = F.regexp_extract("file", "archivo=([^/]+)", 1)
    return rows.filter("pregunta IS NOT NULL").groupBy(readers.source_group(name).alias("grp")).agg(
        F.count_distinct(name).alias("files"), F.count(F.lit(1)).alias("questions"))


@query("write_parent_child", f"""
WITH {RAW_SQL}, q AS (SELECT row_number() OVER (ORDER BY p_partkey) + (SELECT MAX(o_orderkey) FROM orders) AS id, * FROM raw WHERE {ERROR_SQL} IS NULL)
SELECT id, stem, CAST(page AS BIGINT) AS page, letter, text FROM (SELECT id, stem, page, unnest(['A', 'B', 'C', 'D']) AS letter, unnest([a, b, c, d]) AS text FROM q)""")
def write_parent_child(t):
    path = new_path(t.spark, "import")
    page = F.col("page").try_cast("long")
    options = {x: F.col(f"opt_{x.lower()}") for x in "ABCD"}
    error = prepare_error(page, F.col("stem"), options, F.col("answer"))
    good = raw_questions(t).filter(error.isNull()).select(
        "p_partkey", page.alias("page"), "stem",
        F.create_map(*[x for letter in "abcd" for x in (F.lit(letter.upper()), F.col(f"opt_{letter}"))]).alias("options"))
    numbered = writers.assign_ids(
        good, t.orders.select(F.col("o_orderkey").alias("id")), ["p_partkey"])
    for _ in range(2):  # a retry replaces the batch
        writers.write_parent_child(numbered, path, "import")
    return writers.read_parents(t.spark, path).join(
        writers.read_children(t.spark, path, "id"), "id").select(
        "id", "stem", "page", "letter", "text")


@query("write_reports_json", f"""
WITH {LABEL_SQL}, s AS (SELECT source, COUNT(*) AS processed, COUNT(*) FILTER (label = 'NUEVA') AS imported, COUNT(*) FILTER (label LIKE 'DUPLICADA%') AS duplicates, greatest(CAST(ceil(COUNT(*) FILTER (label <> 'NUEVA') / 20.0) AS BIGINT), 1) AS pages FROM lab GROUP BY source),
i AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, doc_id, label, existing_id FROM lab WHERE label <> 'NUEVA')
SELECT source, coalesce((place - 1) // 20, 0) AS page, pages, processed, imported, duplicates, place, doc_id, label, existing_id FROM s LEFT JOIN i USING (source)""")
def write_reports_json(t):
    """Reports with their incidents, at most 20 a document, written twice and read back."""
    path = new_path(t.spark, "reports")
    new = F.col("label") == "NUEVA"
    summary = F.struct(
        F.count(F.lit(1)).alias("processed"), F.count_if(new).alias("imported"),
        F.count_if(F.col("label").startswith("DUPLICADA")).alias("duplicates"))
    reports = stage(writers.incident_reports(
        stage(labelled(t).select("source", "doc_id", "label", "existing_id"), "outcomes"), "source",
        "doc_id", summary, ~new, ["doc_id", "label", "existing_id"], most=20), "reports")
    for _ in range(2):  # a source written again replaces its documents
        writers.write_reports(reports, path, "source")
    back = t.spark.read.schema(reports.schema).json(path)
    return back.select("source", "page", "pages", "summary.*", F.inline_outer("incidents"))


@query("write_cost_log", """
SELECT event_type AS model, COUNT(*) AS calls, round(SUM(floor(value * 100) * 0.75 / 1000000), 6) AS cost FROM events GROUP BY event_type""")
def write_cost_log(t):
    path = new_path(t.spark, "costs")
    costs = t.events.select(
        F.col("event_type").alias("model"),
        call_cost(F.floor(F.col("value") * 100), F.lit(0), F.lit(0.75), F.lit(4.5)).alias("cost"))
    recent = F.col("model").isin("click", "view")
    writers.append_cost_log(costs.filter(recent), path)
    writers.append_cost_log(costs.filter(~recent), path)
    log = t.spark.read.schema("model string, cost double").option("header", True).csv(path)
    return log.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


# the first drop holds the lower half of the keys, the second one all rows: the lower half again
_SPLIT_SQL = "SELECT MAX(p_partkey) // 2 FROM part"
_IMPORT_CTES = IMPORT_SQL[:IMPORT_SQL.index("fst AS (")]
_LABELS = """CASE WHEN error IS NOT NULL THEN 'ERROR_EXTRACCION' WHEN s.fp IS NOT NULL THEN 'DUPLICADA_BD' WHEN f.pos IS NOT NULL THEN 'NUEVA' ELSE 'DUPLICADA_LOTE' END AS label, first_id AS existing_id"""


@query("stream_import", f"""
WITH {COV_SQL}, {ALIASES_SQL}, {_IMPORT_CTES}
items AS (SELECT p_partkey AS pos, CASE WHEN CAST(h.b AS INTEGER) % 3 > 0 THEN 'Norma S' || h.b END AS norm, CASE WHEN CAST(h.b AS INTEGER) % 7 > 0 THEN 'norma S' || (CAST(h.b AS INTEGER) // 2) END AS footer, stem, h.b AS article FROM h),
{FOOTER_CTES}, val AS (SELECT pos, {FOOTER_SELECT}),
h1 AS (SELECT * FROM h WHERE p_partkey <= ({_SPLIT_SQL})),
f1 AS (SELECT batch, fp, MIN(p_partkey) AS pos FROM h1 WHERE error IS NULL GROUP BY ALL),
l1 AS (SELECT h1.p_partkey AS pos, h1.fp, h1.batch, error, {_LABELS} FROM h1 LEFT JOIN sto s ON s.fp = h1.fp LEFT JOIN f1 f ON f.pos = h1.p_partkey),
sto2 AS (SELECT fp, MIN(first_id) AS first_id FROM (SELECT * FROM sto UNION ALL SELECT fp, pos FROM l1 WHERE label = 'NUEVA') GROUP BY fp),
f2 AS (SELECT batch, fp, MIN(p_partkey) AS pos FROM h WHERE error IS NULL GROUP BY ALL),
l2 AS (SELECT h.p_partkey AS pos, h.fp, h.batch, error, {_LABELS} FROM h LEFT JOIN sto2 s ON s.fp = h.fp LEFT JOIN f2 f ON f.pos = h.p_partkey),
l AS (SELECT 0 AS batch_id, * FROM l1 UNION ALL SELECT 1, * FROM l2)
SELECT CAST(batch_id AS BIGINT) AS batch_id, l.pos, l.batch, error, label, existing_id, CASE WHEN label = 'NUEVA' THEN state END AS state, CASE WHEN label = 'NUEVA' THEN val.norm END AS code,
  CASE WHEN label = 'NUEVA' THEN val.part END AS part, CASE WHEN label = 'NUEVA' THEN val.topic END AS topic FROM l LEFT JOIN val ON val.pos = l.pos""")
def stream_import(t):
    """Two drops of raw question files; the second one repeats the rows of the first."""
    root = new_path(t.spark, "stream")
    inbox, bank, out = f"{root}/inbox", f"{root}/bank", f"{root}/out"
    raw = stage(import_raw(t), "import-raw")
    jobs.create_bank(t.spark, bank, stored_raw(raw))
    aliases, index = stage(norm_aliases(t), "aliases"), coverage_index(coverage_table(t))

    def importer(batch, stored):
        return import_questions(batch, stored, ["batch"], aliases, index).select(
            "pos", "batch", "error", "label", "existing_id", "state", "code", "part", "topic")

    half = F.col("pos") <= F.floor(t.part.agg(F.max("p_partkey")).scalar() / 2)
    for drop in (raw.filter(half), raw):
        drop.write.mode("append").parquet(inbox)
        jobs.import_stream(
            t.spark.readStream.schema(raw.schema).parquet(inbox), bank, out, f"{root}/checkpoint",
            fingerprinted=with_fingerprint, importer=importer).awaitTermination()
    return t.spark.read.parquet(out).select(
        F.col("batch_id").cast("long").alias("batch_id"), "pos", "batch", "error", "label", "existing_id",
        "state", "code", "part", "topic")


@query("stream_classify_pending", f"SELECT item_id, branch, state, norm, chosen_id, topic, method FROM ({SQL['classification_cascade']})")
def stream_classify_pending(t):
    """Two drops of questions through the whole cascade, retrieval from a stored index."""
    root = new_path(t.spark, "pending")
    inbox, bank = f"{root}/inbox", f"{root}/index"
    versions.create_store(t.spark, bank, "name string")
    jobs.store_index(bank, "fragments", corpus_terms(t)[0], "doc_id", ["norm", "source"])
    aliases, index = stage(norm_aliases(t), "aliases"), coverage_index(coverage_table(t))
    informatics = stage(allowed_sources(t).select("source").distinct(), "informatics")
    ranked = {name: jobs.stored_ranker(
        t.spark, bank, "fragments", doc_id="doc_id", query_id="item_id", within=within,
        part="norm string, source string")
        for name, within in (("fragments", None), ("documents", informatics))}

    def classify(batch):
        return classification_cascade(
            batch, aliases, index, key="item_id", text="x", origin="origin", **ranked,
            judge=event_judge(t), topics=text_topics(t)
        ).select("item_id", "branch", "state", "norm", "chosen_id", "topic", "method")

    rows = cascade_questions(t)
    split = F.col("item_id") < t.benchmark.agg(F.percentile_approx("item_id", 0.5)).scalar()
    for drop in (rows.filter(split), rows.filter(~split)):
        drop.write.mode("append").parquet(inbox)
        stream = t.spark.readStream.schema("item_id bigint, origin string, x string").parquet(inbox)
        jobs.classify_stream(stream, f"{root}/out", f"{root}/checkpoint", classify).awaitTermination()
    schema = ("item_id bigint, branch string, state string, norm string, chosen_id bigint, "
              "topic string, method string, batch_id long")
    return t.spark.read.schema(schema).parquet(f"{root}/out").drop("batch_id")
