"""Verdicts, rule cascades and type classification."""

from pyspark.sql import functions as F

from corpusbank.constants import SUBJECT_TOPICS
from corpusbank.functions.items import decide
from corpusbank.operators import search
from corpusbank.operators import verdicts as ver
from corpusbank.plans import classify
from corpusbank.queries.coverage import COV_SQL, coverage_table
from corpusbank.queries.registry import query
from corpusbank.queries.search import ALLOWED_SQL, allowed_sources, bm25_sql, candidates
from corpusbank.queries.text import PRACTICAL_SQL
from corpusbank.session import spread, stage

ALIASES_SQL = """ali AS (SELECT DISTINCT norm AS code, 'norma ' || lower(norm) AS alias FROM doc
  UNION SELECT DISTINCT 'Z' || (s_suppkey // 2), 'norma z' || (s_suppkey // 2) FROM supplier)"""


def norm_aliases(t):
    """(code, alias): norms of the catalogue and as many that are outside it."""
    n = F.floor(F.col("s_suppkey") / 2).cast("string")
    return t.supplier.select(F.inline(F.array(*[
        F.struct(F.concat(F.lit(p), n).alias("code"),
                 F.concat(F.lit(f"norma {p.lower()}"), n).alias("alias")) for p in "SZ"
    ]))).distinct()


FOOT_SQL = """foot AS (SELECT o_orderkey, o_custkey // 30 AS n, day(o_orderdate) AS d, o_orderpriority AS p, o_orderstatus AS s FROM orders),
items AS (SELECT o_orderkey,
  CASE WHEN p = '1-URGENT' THEN 'La Norma S' || n || ' vigente' WHEN p = '4-NOT SPECIFIED' THEN 'norma Z' || n
    WHEN p = '5-LOW' AND s <> 'F' THEN 'NORMA S' || n WHEN p = '2-HIGH' THEN '  ' END AS norm,
  CASE WHEN p = '2-HIGH' AND s = 'P' THEN 'norma S' || n || ' y norma S' || (n + 1) WHEN p = '2-HIGH' THEN 'Norma S' || n END AS footer,
  CASE WHEN p = '3-MEDIUM' THEN 'Pregunta sin referencia ' || o_orderkey ELSE ' ' END AS stem,
  CASE WHEN p = '5-LOW' AND s = 'O' THEN NULL WHEN p = '5-LOW' AND s = 'P' THEN 'anexo' WHEN p = '2-HIGH' THEN '0' || d ELSE CAST(d AS VARCHAR) END AS article FROM foot)"""


def footers(t):
    """(o_orderkey, norm, footer, stem, article): question footers, one per order."""
    n, day = F.floor(F.col("o_custkey") / 30), F.dayofmonth("o_orderdate").cast("string")
    ns, nxt = n.cast("string"), (n + 1).cast("string")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return spread(t.orders).select(
        "o_orderkey",
        F.when(p == "1-URGENT", F.concat(F.lit("La Norma S"), ns, F.lit(" vigente")))
        .when(p == "4-NOT SPECIFIED", F.concat(F.lit("norma Z"), ns))
        .when((p == "5-LOW") & (s != "F"), F.concat(F.lit("NORMA S"), ns))
        .when(p == "2-HIGH", "  ").alias("norm"),
        F.when((p == "2-HIGH") & (s == "P"), F.concat(F.lit("norma S"), ns, F.lit(" y norma S"), nxt))
        .when(p == "2-HIGH", F.concat(F.lit("Norma S"), ns)).alias("footer"),
        F.when(p == "3-MEDIUM", F.concat(F.lit("Pregunta sin referencia "), F.col("o_orderkey").cast("string")))
        .otherwise(" ").alias("stem"),
        F.when((p == "5-LOW") & (s == "O"), None).when((p == "5-LOW") & (s == "P"), "anexo")
        .when(p == "2-HIGH", F.concat(F.lit("0"), day)).otherwise(day).alias("article"))


# topics per (norm, article): those of the article plus those of whole-norm documents
_TOPICS_SQL = """art AS (SELECT norm, article, part, topic FROM cov UNION SELECT c.norm, c.article, f.part, f.topic FROM cov c JOIN full_norm f USING (norm)),
arts AS (SELECT norm, article, COUNT(*) AS n, MIN(part) AS part, MIN(topic) AS topic FROM art GROUP BY ALL),
fulls AS (SELECT norm, COUNT(*) AS n, MIN(part) AS part, MIN(topic) AS topic FROM full_norm GROUP BY norm),
norms AS (SELECT DISTINCT norm FROM doc)"""


def footer_sql(key: str) -> str:
    """CTEs and SELECT of the footer rules over ``items`` (key, norm, footer, stem, article)."""
    return f"""{_TOPICS_SQL},
g AS (SELECT {key}, nullif(trim(coalesce(nullif(trim(norm), ''), nullif(trim(footer), ''), stem)), '') AS x, nullif(trim(article), '') AS raw FROM items),
m AS (SELECT {key}, x, raw, COUNT(code) AS k, MIN(code) AS code FROM g LEFT JOIN ali ON contains(' ' || lower(x) || ' ', ' ' || alias || ' ') GROUP BY ALL),
c AS (SELECT {key}, x, raw, k, CASE WHEN k = 1 THEN code END AS code, CASE WHEN regexp_matches(raw, '^\\d+$') THEN CAST(CAST(raw AS BIGINT) AS VARCHAR) END AS article FROM m),
j AS (SELECT c.*, norms.norm IS NOT NULL AS belongs, coalesce(arts.n, fulls.n, 0) AS n,
  CASE WHEN arts.n IS NOT NULL THEN arts.part ELSE fulls.part END AS tp, CASE WHEN arts.n IS NOT NULL THEN arts.topic ELSE fulls.topic END AS tt
  FROM c LEFT JOIN norms ON norms.norm = code LEFT JOIN arts ON arts.norm = code AND arts.article = c.article LEFT JOIN fulls ON fulls.norm = code),
r AS (SELECT *, CASE WHEN x IS NULL THEN 1 WHEN k = 0 THEN 2 WHEN k > 1 THEN 3 WHEN NOT belongs THEN 2 WHEN raw IS NULL THEN 4 WHEN article IS NULL THEN 5
  WHEN n = 0 THEN 6 WHEN n > 1 THEN 7 ELSE 8 END AS rule FROM j)
SELECT {key}, CASE WHEN rule IN (2, 6) THEN 'RECHAZADA' WHEN rule = 8 THEN 'VALIDADA' ELSE 'A_REVISAR' END AS state,
  list_extract(['No se ha podido identificar la norma del pie.', 'La norma no pertenece al temario.', 'La referencia normativa coincide con varias normas.',
   'La norma pertenece al temario, pero no se ha identificado el artículo.', 'El artículo extraído no tiene un formato reconocible.',
   'La norma pertenece al temario, pero el artículo no está incluido.',
   'La norma y el artículo pertenecen al temario, pero están asociados a varios temas.', 'La norma y el artículo del pie pertenecen al temario.'], rule) AS reason,
  code AS norm, coalesce(article, raw) AS article, CASE WHEN rule = 8 THEN tp END AS part, CASE WHEN rule = 8 THEN tt END AS topic FROM r"""


@query("footer_validation", f"WITH {COV_SQL}, {ALIASES_SQL}, {FOOT_SQL}, {footer_sql('o_orderkey')}")
def footer_validation(t):
    return classify.validate_footers(
        footers(t), norm_aliases(t), classify.coverage_index(coverage_table(t)), key="o_orderkey",
        norm="norm", footer="footer", stem="stem", article="article")


STATEMENT_SQL = """stm AS (SELECT o_orderkey, CASE o_orderpriority
  WHEN '1-URGENT' THEN 'Según el artículo ' || day(o_orderdate) || ' de la norma S' || (o_custkey // 30) || '...'
  WHEN '2-HIGH' THEN 'La norma S' || (o_custkey // 30) || CASE WHEN o_orderstatus = 'F' THEN ' y la norma Z' || (o_custkey // 30) ELSE '' END
  WHEN '3-MEDIUM' THEN 'Norma Z' || (o_custkey // 30) || ', artículo ' || day(o_orderdate)
  WHEN '4-NOT SPECIFIED' THEN 'Según la Ley ' || (o_custkey % 60) || '/2015, artículo ' || day(o_orderdate)
  ELSE '¿Cuál de las siguientes afirmaciones es correcta?' END AS x FROM orders)"""


def statements(t):
    """(o_orderkey, x): question statements with and without citations, one per order."""
    n, day = F.floor(F.col("o_custkey") / 30).cast("string"), F.dayofmonth("o_orderdate").cast("string")
    p = F.col("o_orderpriority")
    return spread(t.orders).select("o_orderkey", F.when(
        p == "1-URGENT", F.concat(F.lit("Según el artículo "), day, F.lit(" de la norma S"), n, F.lit("...")))
        .when((p == "2-HIGH") & (F.col("o_orderstatus") == "F"),
              F.concat(F.lit("La norma S"), n, F.lit(" y la norma Z"), n))
        .when(p == "2-HIGH", F.concat(F.lit("La norma S"), n))
        .when(p == "3-MEDIUM", F.concat(F.lit("Norma Z"), n, F.lit(", artículo "), day))
        .when(p == "4-NOT SPECIFIED", F.concat(
            F.lit("Según la Ley "), (F.col("o_custkey") % 60).cast("string"), F.lit("/2015, artículo "), day))
        .otherwise("¿Cuál de las siguientes afirmaciones es correcta?").alias("x"))


def direct_ctes(key: str) -> str:
    """CTEs from ``stm`` (key, x) to ``rules``: what citations in the statement decide."""
    return rf"""{_TOPICS_SQL},
m AS (SELECT {key}, x, COUNT(code) AS k, MIN(code) AS code FROM stm LEFT JOIN ali
  ON contains(' ' || trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}/_]+', ' ', 'g')) || ' ', ' ' || alias || ' ') GROUP BY ALL),
c AS (SELECT {key}, greatest(k, CASE WHEN x LIKE '%Ley %' THEN 1 ELSE 0 END) AS k,
  CASE WHEN k = 1 THEN code WHEN k = 0 AND x LIKE '%Ley %' THEN 'L' || regexp_extract(x, 'Ley (\d+)', 1) || '_2015' END AS code,
  nullif(regexp_extract(x, 'artículo (\d+)', 1), '') AS article FROM m),
j AS (SELECT c.*, norms.norm IS NOT NULL AS belongs, arts.n, arts.part AS tp, arts.topic AS tt
  FROM c LEFT JOIN norms ON norms.norm = code LEFT JOIN arts ON arts.norm = code AND arts.article = c.article),
r AS (SELECT *, CASE WHEN k = 0 THEN 1 WHEN k > 1 THEN 2 WHEN NOT belongs THEN 3 WHEN article IS NULL THEN 4 WHEN n IS NULL THEN 5 WHEN n = 1 THEN 6 ELSE 7 END AS rule FROM j),
rules AS (SELECT {key}, rule NOT IN (1, 4) AS resolved, list_extract(['PENDIENTE', 'RECHAZADA', 'RECHAZADA', 'PENDIENTE', 'RECHAZADA', 'VALIDADA', 'A_REVISAR'], rule) AS state,
  list_extract(['No se ha detectado una norma explícita.', 'La pregunta hace referencia a varias normas distintas y no sigue el formato admitido por el proyecto.',
  'La norma citada no pertenece al temario.', 'La norma pertenece al temario, pero no se cita artículo.',
  'La norma pertenece al temario, pero el artículo citado no está incluido.', 'La norma y el artículo citados pertenecen al temario.',
  'La norma y el artículo pertenecen al temario, pero están asociados a varios temas.'], rule) AS reason,
  CASE WHEN rule <> 2 THEN code END AS norm, CASE WHEN rule <> 2 THEN article END AS article, CASE WHEN rule = 6 THEN tp END AS part, CASE WHEN rule = 6 THEN tt END AS topic,
  CASE WHEN rule NOT IN (1, 4) THEN CAST(1.0 AS DOUBLE) END AS confidence, CASE WHEN rule NOT IN (1, 4) THEN 'DIRECTA' END AS method FROM r)"""


@query("direct_classification",
       f"WITH {COV_SQL}, {ALIASES_SQL}, {STATEMENT_SQL}, {direct_ctes('o_orderkey')} SELECT * FROM rules")
def direct_classification(t):
    return classify.classify_direct(
        statements(t), norm_aliases(t), classify.coverage_index(coverage_table(t)),
        key="o_orderkey", text="x")


@query("threshold_decision", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'RECHAZADA' WHEN value / 100 < 0.50 THEN 'RECHAZADA' WHEN event_type = 'view' THEN 'A_REVISAR'
  WHEN value / 100 < 0.95 THEN 'A_REVISAR' ELSE 'VALIDADA' END AS state FROM events""")
def threshold_decision(t):
    decision = F.when(F.col("event_type") == "error", "RECHAZADA").when(
        F.col("event_type") == "view", "A_REVISAR").otherwise("VALIDADA")
    return t.events.select("event_id", decide(decision, F.col("value") / 100).alias("state"))


# a verdict per event: the user is the question, the decision follows the type
VERDICT_SQL = """vd AS (SELECT event_id, user_id AS item_id, event_type AS e, CAST(floor(value) AS BIGINT) AS w, doc_id AS picked,
  CASE WHEN event_id % 7 = 6 THEN 999999999 ELSE doc_id END AS chosen
  FROM events LEFT JOIN ranked ON item_id = user_id AND rank = event_id % 7 + 1)"""
_CONF = "CASE WHEN w >= 200 THEN 1.5 ELSE (w % 100) / 100.0 END"


def raw_verdicts(t, ranked):
    """(event_id, item_id, verdict): reply texts, some wrong or malformed."""
    e, w = F.col("event_type"), F.floor("value").cast("long")
    picks = ranked.select(
        F.col("item_id").alias("user_id"), F.col("rank").cast("long").alias("_rank"),
        F.col("doc_id").alias("_doc"))
    rows = t.events.withColumn("_rank", F.col("event_id") % 7 + 1).join(
        picks, ["user_id", "_rank"], "left")
    chosen = F.when(F.col("event_id") % 7 == 6, F.lit(999999999).cast("long")).otherwise(F.col("_doc"))
    confidence = F.when(w >= 200, "1.5").otherwise(
        F.concat(F.lit("0."), F.lpad((w % 100).cast("string"), 2, "0")))
    decision = F.when(e == "click", "VALIDADA").when(e == "view", " a_revisar ").when(
        e == "purchase", "ACEPTADA").otherwise("RECHAZADA")
    body = F.concat(
        F.lit('{"decision": "'), decision, F.lit('", "fragmento_id": '),
        F.when(e == "signup", "null").otherwise(F.coalesce(chosen.cast("string"), F.lit('"x"'))),
        F.lit(', "confianza": '), confidence, F.lit(', "motivo": " r'), w.cast("string"), F.lit(' "}'))
    return rows.select(
        "event_id", F.col("user_id").alias("item_id"),
        F.when(e == "error", F.concat(F.lit("no es JSON {"), w.cast("string"), F.lit("}")))
        .otherwise(body).alias("verdict"))


CHECKED_SQL = f"""ck AS (SELECT event_id, item_id, w, picked, upper(CASE e WHEN 'click' THEN 'VALIDADA' WHEN 'view' THEN 'A_REVISAR' WHEN 'purchase' THEN 'ACEPTADA' WHEN 'signup' THEN 'RECHAZADA' ELSE '' END) AS decision,
  CASE WHEN e = 'error' THEN 1 WHEN e = 'purchase' THEN 2 WHEN w >= 200 THEN 3 WHEN e = 'signup' THEN 0 WHEN chosen IS NULL THEN 4 WHEN chosen = 999999999 THEN 5 ELSE 0 END AS err, {_CONF} AS conf FROM vd),
st AS (SELECT event_id, item_id, CASE WHEN err = 1 THEN '' ELSE decision END AS decision, CASE WHEN err = 0 THEN CAST(conf AS DOUBLE) END AS confidence,
  CASE WHEN err = 0 AND decision <> 'RECHAZADA' THEN picked END AS chosen_id, err,
  list_extract(['La respuesta de la IA no es un objeto JSON.', 'Decisión IA no válida: ACEPTADA', 'La confianza debe estar entre 0 y 1.', 'fragmento_id debe ser un entero.',
    'La IA ha seleccionado un fragmento que no estaba entre los candidatos.'], err) AS error, w,
  CASE WHEN err > 0 THEN 'A_REVISAR' WHEN decision = 'RECHAZADA' OR conf < 0.50 THEN 'RECHAZADA' WHEN decision = 'A_REVISAR' OR conf < 0.95 THEN 'A_REVISAR' ELSE 'VALIDADA' END AS state FROM ck)"""


@query("verdict_candidate_join", f"""
WITH {bm25_sql()}, {VERDICT_SQL}, {CHECKED_SQL}
SELECT event_id, item_id, decision, confidence, chosen_id, error, state,
 CASE WHEN err > 0 THEN 'No se pudo interpretar de forma segura la respuesta de la IA: ' || error ELSE 'r' || w END AS reason FROM st""")
def verdict_candidate_join(t):
    ranked = stage(candidates(t), "ranked")
    return ver.check_verdicts(
        raw_verdicts(t, ranked), ranked, question="item_id", text="verdict", candidate_id="doc_id"
    ).drop("verdict")


@query("verdict_parse", """
SELECT event_id, e <> 'error' AS is_object, CASE e WHEN 'click' THEN 'VALIDADA' WHEN 'view' THEN 'A_REVISAR' WHEN 'purchase' THEN 'ACEPTADA' WHEN 'signup' THEN 'RECHAZADA' ELSE '' END AS decision,
  CASE WHEN e <> 'error' THEN CAST(CASE WHEN w >= 200 THEN 1.5 ELSE (w % 100) / 100.0 END AS DOUBLE) END AS confidence,
  CASE WHEN e = 'error' THEN '' ELSE 'r' || w END AS reason
FROM (SELECT event_id, event_type AS e, CAST(floor(value) AS BIGINT) AS w FROM events)""")
def verdict_parse(t):
    empty = t.benchmark.select("item_id").limit(0).select(
        "item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"))
    parsed = raw_verdicts(t, empty).select("event_id", ver.parse_verdict(F.col("verdict")).alias("v"))
    return parsed.select("event_id", "v.is_object", "v.decision", "v.confidence", "v.reason")


_LAST = "lastv AS (SELECT item_id, arg_max(event_id, event_id) AS event_id FROM st GROUP BY item_id)"


def settle(t, ranked, documents=False, topic="source"):
    """Last verdict of every question against its candidates; topics of a document."""
    verdicts = raw_verdicts(t, ranked)
    last = verdicts.groupBy("item_id").agg(F.max("event_id").alias("event_id"))
    verdicts = verdicts.join(last, ["item_id", "event_id"], "left_semi").drop("event_id")
    topics = ver.candidate_topics(
        t.documents, ranked.select("doc_id"), doc_id="doc_id", text="text", part="lang", topic=topic)
    if documents:
        verdicts = verdicts.withColumn("verdict", F.replace("verdict", F.lit("fragmento_id"), F.lit("documento_id")))
    return classify.settle_candidates(
        t.benchmark, ranked.select("item_id", F.col("doc_id").alias("candidate_id")), verdicts,
        topics, key="item_id", verdict="verdict", documents=documents)


def _cascade_sql(extra: str, docs: str, method: str, method_model: str, none: str, many: str) -> str:
    return f"""
WITH {extra} {bm25_sql(docs)}, {VERDICT_SQL}, {CHECKED_SQL}, {_LAST},
tp AS (SELECT text, COUNT(DISTINCT (lang, source)) AS n, CASE WHEN MIN(lang) = MAX(lang) THEN MIN(lang) END AS part, CASE WHEN MIN(source) = MAX(source) THEN MIN(source) END AS topic FROM documents GROUP BY text),
v AS (SELECT st.*, tp.n, tp.part, tp.topic FROM st JOIN lastv USING (item_id, event_id) LEFT JOIN documents d ON d.doc_id = chosen_id LEFT JOIN tp ON tp.text = d.text),
o AS (SELECT b.item_id, v.*, b.item_id IN (SELECT item_id FROM ranked) AS has, v.err = 0 AND v.state <> 'RECHAZADA' AS opn FROM benchmark b LEFT JOIN v ON v.item_id = b.item_id)
SELECT item_id, CASE WHEN NOT has THEN 'RECHAZADA' WHEN err IS NULL THEN 'PENDIENTE' WHEN opn AND n <> 1 THEN 'A_REVISAR' ELSE state END AS state,
 CASE WHEN NOT has THEN '{none}' WHEN err > 0 THEN 'No se pudo interpretar de forma segura la respuesta de la IA: ' || error
   WHEN opn AND n > 1 THEN '{many}' ELSE 'r' || w END AS reason,
 CASE WHEN has AND err = 0 AND state <> 'RECHAZADA' THEN chosen_id END AS chosen_id,
 CASE WHEN has AND opn AND n = 1 THEN part END AS part, CASE WHEN has AND opn AND n = 1 THEN topic END AS topic,
 CASE WHEN NOT has THEN CAST(0.0 AS DOUBLE) ELSE confidence END AS confidence,
 CASE WHEN NOT has THEN '{method}' WHEN err IS NOT NULL THEN '{method_model}' END AS method FROM o"""


# a quarter of the questions each: informatics, norm and article cited, norm cited, no citation
CASCADE_Q_SQL = """q AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Especial-Informática' ELSE 'General' END AS origin,
  CASE item_id % 4 WHEN 1 THEN 'Según el artículo ' || (item_id % 28 + 1) || ' de la norma S' || (item_id // 4 % 5) || '. ' || text
    WHEN 2 THEN 'La norma S' || (item_id // 4 % 5) || '. ' || text ELSE text END AS x FROM benchmark)"""


def cascade_questions(t):
    """(item_id, origin, x): benchmark texts as questions with and without citations."""
    kind, norm = F.col("item_id") % 4, (F.floor(F.col("item_id") / 4) % 5).cast("string")
    return t.benchmark.select(
        "item_id", F.when(kind == 0, "Especial-Informática").otherwise("General").alias("origin"),
        F.when(kind == 1, F.concat(
            F.lit("Según el artículo "), (F.col("item_id") % 28 + 1).cast("string"),
            F.lit(" de la norma S"), norm, F.lit(". "), "text"))
        .when(kind == 2, F.concat(F.lit("La norma S"), norm, F.lit(". "), "text"))
        .otherwise(F.col("text")).alias("x"))


def corpus_terms(t):
    """(fragments with the norm they belong to, informatics documents) as document terms."""
    norm = F.concat(F.lit("S"), (F.col("doc_id") % 5).cast("string"))
    terms = stage(search.document_terms(
        t.documents.withColumn("norm", norm), "doc_id", "text", ["norm", "source"]),
        "cascade-terms")
    return terms, terms.join(allowed_sources(t), "source", "left_semi")


def ranker(terms):
    """Rankings over stored document terms, inside the given part columns."""
    def ranked(questions, part):
        found = search.ranked_documents(terms, questions, doc_id="doc_id", query_id="item_id",
                                        query_text="text", part=part)
        return found.withColumnRenamed("doc_id", "candidate_id")
    return ranked


def event_judge(t):
    """Last verdict of every question on its candidates, for both kinds of candidates."""
    def judge(found):
        verdicts = raw_verdicts(t, found.withColumnRenamed("candidate_id", "doc_id"))
        last = verdicts.groupBy("item_id").agg(F.max("event_id").alias("event_id"))
        its = found.select("item_id", F.lit(True).alias("_it")).filter(
            F.col("branch") == classify.DOCUMENTS).distinct()
        renamed = F.replace("verdict", F.lit("fragmento_id"), F.lit("documento_id"))
        return verdicts.join(last, ["item_id", "event_id"], "left_semi").join(
            its, "item_id", "left").select(
            "item_id", F.when(F.col("_it"), renamed).otherwise(F.col("verdict")).alias("verdict"))
    return judge


def text_topics(t):
    def topics(found):
        return ver.candidate_topics(
            t.documents, found.select(F.col("candidate_id").alias("doc_id")), doc_id="doc_id",
            text="text", part="lang", topic="source")
    return topics


def _ranked_sql(docs: str, queries: str, part: str | None = None) -> str:
    return f"SELECT item_id, doc_id, score, rank FROM (WITH {bm25_sql(docs, queries, part)} SELECT * FROM ranked)"


CASCADE_SQL = f"""
WITH {COV_SQL}, {ALIASES_SQL}, {CASCADE_Q_SQL}, stm AS (SELECT item_id, x FROM q WHERE item_id % 4 <> 0), {direct_ctes('item_id')},
frag AS (SELECT *, 'S' || (doc_id % 5) AS norm FROM documents), itdocs AS (SELECT * FROM documents WHERE source IN ({ALLOWED_SQL})),
q_it AS (SELECT item_id, x AS text FROM q WHERE item_id % 4 = 0),
q_any AS (SELECT item_id, x AS text FROM q JOIN rules USING (item_id) WHERE NOT resolved AND norm IS NULL),
q_norm AS (SELECT item_id, x AS text, norm FROM q JOIN rules USING (item_id) WHERE NOT resolved AND norm IS NOT NULL),
ranked AS ({_ranked_sql('itdocs', 'q_it')} UNION ALL {_ranked_sql('frag', 'q_any')} UNION ALL {_ranked_sql('frag', 'q_norm', 'norm')}),
{VERDICT_SQL}, {CHECKED_SQL}, {_LAST},
tp AS (SELECT text, COUNT(DISTINCT (lang, source)) AS n, CASE WHEN MIN(lang) = MAX(lang) THEN MIN(lang) END AS part, CASE WHEN MIN(source) = MAX(source) THEN MIN(source) END AS topic FROM documents GROUP BY text),
v AS (SELECT st.*, tp.n, tp.part, tp.topic FROM st JOIN lastv USING (item_id, event_id) LEFT JOIN documents d ON d.doc_id = chosen_id LEFT JOIN tp ON tp.text = d.text),
o AS (SELECT q.item_id, q.item_id % 4 = 0 AS it, rules.norm, rules.article, v.* EXCLUDE (item_id), q.item_id IN (SELECT item_id FROM ranked) AS has, v.err = 0 AND v.state <> 'RECHAZADA' AS opn
  FROM q LEFT JOIN rules USING (item_id) LEFT JOIN v ON v.item_id = q.item_id WHERE q.item_id % 4 = 0 OR NOT rules.resolved)
SELECT item_id, 'REGLA' AS branch, state, reason, norm, article, CAST(NULL AS BIGINT) AS chosen_id, part, CAST(topic AS VARCHAR) AS topic, confidence, method FROM rules WHERE resolved
UNION ALL SELECT item_id, CASE WHEN it THEN 'INFORMATICA' ELSE 'RECUPERACION' END, CASE WHEN NOT has THEN 'RECHAZADA' WHEN err IS NULL THEN 'PENDIENTE' WHEN opn AND n <> 1 THEN 'A_REVISAR' ELSE state END,
 CASE WHEN NOT has THEN CASE WHEN it THEN 'BM25 no ha localizado documentos candidatos de Informática.' ELSE 'BM25 no ha localizado fragmentos candidatos dentro del temario.' END
   WHEN err > 0 THEN 'No se pudo interpretar de forma segura la respuesta de la IA: ' || error
   WHEN opn AND n > 1 THEN CASE WHEN it THEN 'El documento respalda la respuesta, pero está asociado a varios temas.' ELSE 'El fragmento respalda la respuesta, pero está asociado a varios temas.' END ELSE 'r' || w END,
 norm, article, CASE WHEN has AND err = 0 AND state <> 'RECHAZADA' THEN chosen_id END, CASE WHEN has AND opn AND n = 1 THEN part END, CASE WHEN has AND opn AND n = 1 THEN topic END,
 CASE WHEN NOT has THEN CAST(0.0 AS DOUBLE) ELSE confidence END, CASE WHEN NOT has THEN CASE WHEN it THEN 'BM25_DOCUMENTO' ELSE 'BM25' END WHEN err IS NOT NULL THEN CASE WHEN it THEN 'BM25_IA_DOCUMENTO' ELSE 'BM25_IA' END END FROM o"""


@query("classification_cascade", CASCADE_SQL)
def classification_cascade(t):
    fragments, documents = corpus_terms(t)
    return classify.classification_cascade(
        cascade_questions(t), norm_aliases(t), classify.coverage_index(coverage_table(t)),
        key="item_id", text="x", origin="origin", fragments=ranker(fragments),
        documents=ranker(documents), judge=event_judge(t), topics=text_topics(t))


@query("it_classification", _cascade_sql(
    f"docs AS (SELECT * FROM documents WHERE source IN ({ALLOWED_SQL})),", "docs", "BM25_DOCUMENTO", "BM25_IA_DOCUMENTO",
    "BM25 no ha localizado documentos candidatos de Informática.", "El documento respalda la respuesta, pero está asociado a varios temas."))
def it_classification(t):
    docs = t.documents.join(allowed_sources(t), "source", "left_semi")
    return settle(t, stage(candidates(t, corpus=docs), "ranked"), documents=True)


@query("batch_result_align", """
WITH last AS (SELECT user_id AS c_custkey, max(event_id) AS event_id FROM events GROUP BY user_id),
r AS (SELECT c_custkey, event_type AS e, value FROM last JOIN events USING (event_id))
SELECT c.c_custkey, CASE e WHEN 'click' THEN 'A' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'D' END AS answer,
  CASE WHEN e IN ('click', 'signup') THEN 'WORD_365' WHEN e = 'view' THEN 'EXCEL_365' END AS subject, CASE WHEN e IS NULL THEN 0.0 ELSE value END AS confidence,
  CASE e WHEN 'purchase' THEN 'Materia no válida.' WHEN 'signup' THEN 'Respuesta correcta no válida.'
    WHEN 'error' THEN 'Respuesta correcta no válida. Materia no válida.' WHEN 'click' THEN NULL WHEN 'view' THEN NULL ELSE 'La IA no devolvió resultado.' END AS note
FROM customer c LEFT JOIN r USING (c_custkey)""")
def batch_result_align(t):
    e = F.col("event_type")
    results = t.events.select(
        F.col("user_id").alias("c_custkey"), F.col("event_id").alias("position"),
        F.when(e == "click", " a").when(e == "view", "C").when(e == "purchase", "d ").when(
            e == "signup", "E").alias("answer"),
        F.when(e.isin("click", "signup"), "word_365").when(e == "view", "EXCEL_365 ").otherwise(
            "COCINA").alias("subject"), F.col("value").alias("confidence"))
    return ver.align_results(
        t.customer.select("c_custkey"), results, ["c_custkey"], "position", tuple(SUBJECT_TOPICS))


OVERRIDES = [("1-URGENT", "VALIDADA", None, 1.0), ("3-MEDIUM", "VALIDADA", "General", 1.0)]


@query("override_join", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'VALIDADA' ELSE o_orderstatus END AS state,
  CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '3-MEDIUM' THEN 'General' ELSE 'p' || o_custkey % 5 END AS part,
  CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN CAST(1.0 AS DOUBLE) ELSE o_totalprice END AS confidence FROM orders""")
def override_join(t):
    overrides = t.values(OVERRIDES, "o_orderpriority string, state string, part string, confidence double")
    rows = t.orders.select(
        "o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("state"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string")).alias("part"),
        F.col("o_totalprice").alias("confidence"))
    return ver.apply_overrides(
        rows, overrides, "o_orderpriority", ["state", "part", "confidence"]).drop("o_orderpriority")


@query("type_classification", f"""
WITH {PRACTICAL_SQL}, p AS (SELECT doc_id, lang, quality, a + b + c + e + f + g + h + i AS points FROM r JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN quality = 0 THEN 'ESPECIAL_PRACTICA' WHEN lang = 'de' THEN 'GENERAL' WHEN lang = 'fr' THEN 'ESPECIAL_INFORMATICA' WHEN lang = 'es' THEN NULL
  WHEN points >= 5 THEN 'ESPECIAL_PRACTICA' ELSE 'ESPECIAL_TEORIA' END AS qtype, CAST(points AS INTEGER) AS points, quality IS DISTINCT FROM 0 AND lang = 'es' AS error FROM p""")
def type_classification(t):
    part = F.when(F.col("lang") == "de", "General").when(F.col("lang") == "fr", "Especial-Informática").when(
        F.col("lang") == "es", "Especial-Práctica").otherwise("Especial-Teoría")
    overrides = t.labels.filter("quality = 0").select("doc_id", F.lit("ESPECIAL_PRACTICA").alias("qtype"))
    return classify.classify_type(
        t.documents.withColumn("part", part), overrides, key="doc_id", part="part", stem="text",
        strict=True)
