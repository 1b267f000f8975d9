"""Question records: cleaning, checks, categories and costs."""

from pyspark.sql import functions as F

from corpusbank.constants import MODEL_PRICES
from corpusbank.functions import items as it
from corpusbank.functions.text import blank_to_null, strip
from corpusbank.operators import joins
from corpusbank.queries.registry import query

# raw questions of the parts: the type decides which defect a record has
RAW_SQL = """raw AS (SELECT p_partkey, p_type, CASE WHEN p_type = 'ECONOMY' AND p_size % 2 = 0 THEN 'x' || p_size ELSE CAST(p_size AS VARCHAR) END AS page,
  CASE WHEN p_type = 'MEDIUM' AND p_size % 2 = 0 THEN '  ' WHEN p_type = 'SMALL' THEN ' ' || p_name || ' ' ELSE p_name END AS stem, p_brand AS a, CAST(p_size AS VARCHAR) AS b,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE 'c' || p_size END AS c, CASE WHEN p_type = 'ECONOMY' AND p_size % 3 = 0 THEN ' ' ELSE 'd ' END AS d,
  CASE WHEN p_type = 'LARGE' THEN 'E' WHEN p_type = 'SMALL' THEN ' b ' WHEN p_type = 'MEDIUM' THEN NULL ELSE 'A' END AS answer FROM part)"""


def raw_questions(t):
    """(p_partkey, p_type, page, stem, opt_a..opt_d, answer)."""
    kind, size = F.col("p_type"), F.col("p_size")
    text = size.cast("string")
    return t.part.select(
        "p_partkey", "p_type",
        F.when((kind == "ECONOMY") & (size % 2 == 0), F.concat(F.lit("x"), text)).otherwise(text).alias("page"),
        F.when((kind == "MEDIUM") & (size % 2 == 0), "  ").when(
            kind == "SMALL", F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).otherwise(
            F.col("p_name")).alias("stem"),
        F.col("p_brand").alias("opt_a"), text.alias("opt_b"),
        F.when(kind != "PROMO", F.concat(F.lit("c"), text)).alias("opt_c"),
        F.when((kind == "ECONOMY") & (size % 3 == 0), " ").otherwise("d ").alias("opt_d"),
        F.when(kind == "LARGE", "E").when(kind == "SMALL", " b ").when(
            kind != "MEDIUM", "A").alias("answer"))


def _options():
    return {x: F.col(f"opt_{x.lower()}") for x in "ABCD"}


ERROR_SQL = """CASE WHEN try_cast(page AS BIGINT) IS NULL THEN 'El número de página no es válido.' WHEN trim(stem) = '' THEN 'La pregunta no tiene enunciado.'
  WHEN c IS NULL THEN 'No se ha extraído la opción C.' WHEN trim(d) = '' THEN 'No se ha extraído la opción D.'
  WHEN coalesce(upper(trim(answer)), '') NOT IN ('A', 'B', 'C', 'D') THEN 'No se ha detectado una respuesta correcta válida.' END"""


@query("prepare_question", f"""
WITH {RAW_SQL}, e AS (SELECT *, {ERROR_SQL} AS error FROM raw)
SELECT p_partkey, error, CASE WHEN error IS NULL THEN CAST(page AS BIGINT) END AS page, CASE WHEN error IS NULL THEN trim(stem) END AS stem,
 CASE WHEN error IS NULL THEN trim(d) END AS opt_d, CASE WHEN error IS NULL THEN upper(trim(answer)) END AS answer FROM e""")
def prepare_question(t):
    page = F.col("page").try_cast("long")
    error = it.prepare_error(page, F.col("stem"), _options(), F.col("answer"))
    good = F.col("error").isNull()
    return raw_questions(t).withColumn("error", error).select(
        "p_partkey", "error", F.when(good, page).alias("page"),
        F.when(good, blank_to_null(F.col("stem"))).alias("stem"),
        F.when(good, blank_to_null(F.col("opt_d"))).alias("opt_d"),
        F.when(good, F.upper(strip(F.col("answer")))).alias("answer"))


@query("extraction_completeness", f"""
WITH {RAW_SQL}, x AS (SELECT *, try_cast(page AS BIGINT) AS number, CASE WHEN p_type = 'STANDARD' THEN '1.7' WHEN p_type = 'PROMO' THEN 'alta' WHEN p_type = 'LARGE' THEN '-2' ELSE '0.25' END AS conf,
  CASE WHEN p_type <> 'SMALL' THEN 'norma' END AS norm FROM raw)
SELECT p_partkey, coalesce(number, p_partkey) AS number, concat_ws(' | ', CASE WHEN number IS NULL THEN 'No se detectó el número visible; se utiliza el número de página.' END,
   CASE WHEN c IS NULL THEN 'No se extrajo la opción C.' END, CASE WHEN answer = 'E' THEN 'La respuesta correcta detectada no es válida.' END) AS notes,
  CASE WHEN upper(trim(answer)) IN ('A', 'B', 'C', 'D') THEN upper(trim(answer)) END AS answer,
  CASE p_type WHEN 'STANDARD' THEN CAST(1.0 AS DOUBLE) WHEN 'PROMO' THEN CAST(0.0 AS DOUBLE) WHEN 'LARGE' THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS confidence,
  c IS NOT NULL AND coalesce(upper(trim(answer)) IN ('A', 'B', 'C', 'D'), false) AND norm IS NOT NULL AND stem <> '' AS complete FROM x""")
def extraction_completeness(t):
    number = F.col("page").try_cast("long")
    confidence = F.when(F.col("p_type") == "STANDARD", "1.7").when(
        F.col("p_type") == "PROMO", "alta").when(F.col("p_type") == "LARGE", "-2").otherwise("0.25")
    norm = F.when(F.col("p_type") != "SMALL", "norma")
    none = F.lit(None).cast("array<string>")
    return raw_questions(t).select(
        "p_partkey", F.coalesce(number, "p_partkey").alias("number"),
        F.array_join(it.extraction_notes(none, number, _options(), F.col("answer")), " | ").alias("notes"),
        F.when(it.valid_answer(F.col("answer")), F.upper(strip(F.col("answer")))).alias("answer"),
        it.clamp_confidence(confidence).alias("confidence"),
        it.extraction_complete(F.col("stem"), _options(), F.col("answer"), norm, F.lit("1")).alias("complete"))


@query("valid_answer_filter", """
SELECT l_orderkey, l_linenumber, l_returnflag AS answer FROM lineitem WHERE l_returnflag IN ('A', 'B', 'C', 'D')""")
def valid_answer_filter(t):
    raw = F.concat(F.lit(" "), F.lower("l_returnflag"), F.lit("\n"))
    return t.lineitem.select("l_orderkey", "l_linenumber", raw.alias("answer")).filter(
        it.valid_answer(F.col("answer"))).withColumn("answer", F.upper(strip(F.col("answer"))))


# option rows of the orders: the line number gives the letter
OPT_SQL = """opt AS (SELECT l_orderkey, list_extract(['A', 'B', 'C', 'D', 'A', 'B', 'E'], l_linenumber) AS letter, 'p' || l_partkey AS text, l_linenumber FROM lineitem),
per AS (SELECT l_orderkey, letter, (max(struct_pack(n := l_linenumber, t := text))).t AS text, COUNT(*) AS n FROM opt GROUP BY ALL)"""


def option_rows(t):
    letters = F.array(*[F.lit(x) for x in ("a", " B", "c", "D ", "A", "b", "E")])
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.element_at(letters, F.col("l_linenumber")).alias("letter"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"))


def option_maps(t):
    return joins.options_to_map(option_rows(t), ["l_orderkey"], "letter", "text", "l_linenumber")


@query("options_to_map", f"""
WITH {OPT_SQL} SELECT l_orderkey, string_agg(letter || '=' || text, ';' ORDER BY letter) AS options, MAX(n) > 1 AS repeated FROM per GROUP BY l_orderkey""")
def options_to_map(t):
    pairs = F.transform(F.map_entries("options"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return option_maps(t).select("l_orderkey", F.array_join(pairs, ";").alias("options"), "repeated")


@query("options_exact_abcd", f"""
WITH {OPT_SQL} SELECT l_orderkey, string_agg(letter, '' ORDER BY letter) = 'ABCD' AS complete FROM per GROUP BY l_orderkey""")
def options_exact_abcd(t):
    return option_maps(t).select("l_orderkey", it.letters_complete(F.col("options")).alias("complete"))


@query("set_equality", f"""
WITH {OPT_SQL} SELECT l_orderkey, CAST(COUNT(*) AS INTEGER) AS n_letters, string_agg(letter, '' ORDER BY letter) = 'ABCD' AS same FROM per GROUP BY l_orderkey""")
def set_equality(t):
    return option_maps(t).select(
        "l_orderkey", F.size("options").alias("n_letters"), it.same_letters(F.col("options")).alias("same"))


@query("reshape_exam_item", f"""
WITH {OPT_SQL}, k AS (SELECT l_orderkey, MIN(l_returnflag) AS flag, MIN(l_linestatus) AS st FROM lineitem GROUP BY l_orderkey),
a AS (SELECT l_orderkey, CASE flag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'D' END AS answer, CASE WHEN st = 'F' THEN 'BANCO' ELSE 'IA' END AS origin FROM k),
w AS (SELECT l_orderkey, MAX(text) FILTER (letter = 'A') AS ta, MAX(text) FILTER (letter = 'B') AS tb, MAX(text) FILTER (letter = 'C') AS tc, MAX(text) FILTER (letter = 'D') AS td FROM per GROUP BY l_orderkey)
SELECT l_orderkey, 'A) ' || coalesce(ta, '-') || ' B) ' || coalesce(tb, '-') || ' C) ' || coalesce(tc, '-') || ' D) ' || coalesce(td, '-') AS options,
  CASE answer WHEN 'A' THEN ta WHEN 'B' THEN tb ELSE td END AS answer_text, origin FROM w JOIN a USING (l_orderkey)""")
def reshape_exam_item(t):
    keys = t.lineitem.groupBy("l_orderkey").agg(
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("st"))
    answer = F.when(F.col("flag") == "A", "A").when(F.col("flag") == "N", "B").otherwise("D")
    item = it.exam_item(F.col("options"), answer, F.when(F.col("st") != "F", "IA"))
    shown = F.transform(F.col("item.options"), lambda o: F.concat(
        o["letter"], F.lit(") "), F.coalesce(o["text"], F.lit("-"))))
    return option_maps(t).join(keys, "l_orderkey").withColumn("item", item).select(
        "l_orderkey", F.array_join(shown, " ").alias("options"), "item.answer_text", "item.origin")


@query("range_bucket", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) + l_linenumber * 10 AS position,
 CASE WHEN position BETWEEN 1 AND 50 THEN 'ESPECIAL_TEORIA' WHEN position BETWEEN 51 AND 65 THEN 'ESPECIAL_PRACTICA'
  WHEN position BETWEEN 66 AND 80 THEN 'ESPECIAL_INFORMATICA' WHEN position BETWEEN 81 AND 110 THEN 'GENERAL' END AS qtype FROM lineitem""")
def range_bucket(t):
    position = F.col("l_quantity").cast("int") + F.col("l_linenumber") * 10
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", position.alias("position"), it.position_type(position).alias("qtype"))


@query("category_map", """
SELECT p_partkey, CASE p_type WHEN 'LARGE' THEN 'Especial-Informática' WHEN 'SMALL' THEN 'General' ELSE 'Especial-Teoría' END AS origin,
 CASE WHEN p_size > 10 AND p_type = 'SMALL' THEN 'GENERAL' WHEN p_size > 10 AND p_type = 'LARGE' THEN 'ESPECIAL_INFORMATICA' END AS initial_type FROM part""")
def category_map(t):
    qtype = F.when(F.col("p_type") == "LARGE", "ESPECIAL_INFORMATICA").when(
        F.col("p_type") == "SMALL", "GENERAL").otherwise("ESPECIAL_TEORIA")
    state = F.when(F.col("p_size") > 10, "VALIDADA").otherwise("RECHAZADA")
    return t.part.select(
        "p_partkey", it.origin_part(qtype).alias("origin"),
        it.initial_type(state, it.origin_part(qtype)).alias("initial_type"))


@query("reason_concat", """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN props WHEN 'click' THEN event_type || ' | ' || props
  WHEN 'signup' THEN 'Incidencias de extracción: n1 | n' || user_id || ' | ' || event_type ELSE 'Incidencias de extracción: n1' END AS reason FROM events""")
def reason_concat(t):
    e = F.col("event_type")
    notes = F.when(e == "signup", F.array(F.lit("n1"), F.concat(F.lit("n"), F.col("user_id").cast("string")))).when(
        e == "purchase", F.array(F.lit("n1"))).otherwise(F.array().cast("array<string>"))
    plain = it.join_reasons(F.when(e == "click", e), F.when(e.isin("view", "click"), F.col("props")),
                            F.lit(" "))
    return t.events.select("event_id", F.when(e.isin("signup", "purchase"), it.import_reason(
        notes, F.when(e == "signup", e))).otherwise(plain).alias("reason"))


SUBJECT_SQL = "CASE event_type WHEN 'click' THEN 'WORD_365' WHEN 'view' THEN 'EXCEL_365' WHEN 'signup' THEN 'TEAMS_365' WHEN 'error' THEN 'COCINA' END"


def subjects(t):
    e = F.col("event_type")
    return t.events.withColumn("subject", F.when(e == "click", "WORD_365").when(e == "view", "EXCEL_365").when(
        e == "signup", "TEAMS_365").when(e == "error", "COCINA"))


@query("constant_map_join", f"""
SELECT event_id, {SUBJECT_SQL} AS subject, CASE event_type WHEN 'click' THEN 19 WHEN 'view' THEN 20 WHEN 'signup' THEN 21 END AS topic FROM events""")
def constant_map_join(t):
    return joins.subject_topics(subjects(t), F.col("subject")).select("event_id", "subject", "topic")


@query("evaluate_acceptance", f"""
WITH s AS (SELECT event_id, {SUBJECT_SQL} AS subject, CASE event_type WHEN 'click' THEN 19 WHEN 'view' THEN 20 WHEN 'signup' THEN 21 END AS topic,
  list_extract(['A', 'd', NULL, 'E'], CAST(user_id % 4 AS INTEGER) + 1) AS answer FROM events),
d AS (SELECT *, topic IS NOT NULL AND answer IN ('A', 'd') AS ok FROM s)
SELECT event_id, CASE WHEN ok THEN 'ACEPTADA' ELSE 'A_REVISAR' END AS decision, CASE WHEN ok THEN topic END AS topic, CASE WHEN ok THEN 4 END AS part,
 CASE WHEN ok THEN 'Materia ' || subject || ' vinculada al tema.' ELSE 'No puede incorporarse automáticamente: falta tema válido o respuesta correcta.' END AS reason FROM d""")
def evaluate_acceptance(t):
    answers = F.array(F.lit("A"), F.lit("d"), F.lit(None).cast("string"), F.lit("E"))
    rows = joins.subject_topics(subjects(t), F.col("subject")).withColumn(
        "answer", F.element_at(answers, (F.col("user_id") % 4 + 1).cast("int"))).withColumn("part", F.lit(4))
    return joins.evaluate(rows, topic="topic", part="part", answer="answer", subject="subject").select(
        "event_id", "decision", "topic", "part", "reason")


@query("call_cost", """
WITH c AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'gpt-5-mini' WHEN 'view' THEN 'gpt-5.4' WHEN 'signup' THEN 'gpt-5.4-mini' ELSE 'otro' END AS model,
 CAST(floor(value * 100) AS BIGINT) AS tin, event_id % 500 AS tout FROM events)
SELECT event_id, model, model = 'otro' AS unknown, round(CASE model WHEN 'gpt-5.4' THEN (tin * CAST(2.5 AS DOUBLE) + tout * CAST(15.0 AS DOUBLE)) / 1000000
  WHEN 'otro' THEN NULL ELSE (tin * CAST(0.75 AS DOUBLE) + tout * CAST(4.5 AS DOUBLE)) / 1000000 END, 8) AS cost FROM c""")
def call_cost(t):
    e = F.col("event_type")
    model = F.when(e == "click", "gpt-5-mini").when(e == "view", "gpt-5.4").when(e == "signup", "gpt-5.4-mini").otherwise("otro")
    prices = t.values([(m, i, o) for m, (i, o) in MODEL_PRICES.items()], "model string, p_in double, p_out double")
    calls = t.events.select(
        "event_id", model.alias("model"), F.floor(F.col("value") * 100).alias("tin"),
        (F.col("event_id") % 500).alias("tout"))
    return calls.join(prices, "model", "left").select(
        "event_id", "model", F.col("p_in").isNull().alias("unknown"),
        F.round(it.call_cost(F.col("tin"), F.col("tout"), F.col("p_in"), F.col("p_out")), 8).alias("cost"))


@query("pending_filter", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_totalprice < 400000""")
def pending_filter(t):
    blank = F.coalesce(F.trim(F.when(F.col("o_orderpriority") == "5-LOW", "BM25").otherwise(" ")), F.lit("")) == ""
    return t.orders.filter(F.col("o_orderstatus") == "P").filter(
        F.col("o_orderdate") >= "1996-01-01").filter("o_totalprice < 400000").filter(blank).select(
        "o_orderkey", "o_totalprice")
