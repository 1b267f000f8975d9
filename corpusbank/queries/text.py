"""Scalar text functions over whole texts."""

from pyspark.sql import functions as F

from corpusbank.constants import STOP_WORDS
from corpusbank.functions import citation, features, text
from corpusbank.queries.registry import query

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(c: str) -> str:
    return (
        f"list_filter(regexp_extract_all(strip_accents(lower({c})), '[a-z0-9]{{2,}}'), "
        f"lambda x: x NOT IN ({STOP_SQL}))"
    )


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def spaces_sql(c: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({c})), '\\s+', ' ', 'g'))"


@query("normalize_accents",
       "SELECT doc_id, strip_accents(lower(text)) AS norm FROM documents")
def normalize_accents(t):
    return t.documents.select("doc_id", text.normalize_accents(F.col("text")).alias("norm"))


@query("normalize_spaces", f"SELECT doc_id, {spaces_sql('text')} AS norm FROM documents")
def normalize_spaces(t):
    return t.documents.select("doc_id", text.normalize_spaces(F.col("text")).alias("norm"))


@query("slugify", """
SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '_', 'g'), '_') AS slug
FROM documents""")
def slugify(t):
    return t.documents.select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("title_key", """
SELECT doc_id, trim(regexp_replace(lower(text), '[^a-záéíóúüñ0-9]+', ' ', 'g')) AS title
FROM documents""")
def title_key(t):
    return t.documents.select("doc_id", text.title_key(F.col("text")).alias("title"))


@query("tokenize", f"""
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS toks
FROM (SELECT doc_id, {tokens_sql('text')} AS toks FROM documents)""")
def tokenize(t):
    toks = text.tokens(F.col("text"))
    return t.documents.select(
        "doc_id", F.size(toks).alias("n_tokens"), F.array_join(toks, " ").alias("toks"))


@query("clean_text", f"""
WITH raw AS (SELECT doc_id, replace(replace(replace(text, ', ', ',' || chr(160) || chr(9)),
  chr(10), chr(13) || chr(10) || chr(10) || chr(10)), 'th', 't' || chr(173) || 'h') AS x FROM documents),
a AS (SELECT doc_id, regexp_replace(replace(replace(replace(x, chr(160), ' '), chr(173), ''), chr(13), ''),
  '[ \\t]+', ' ', 'g') AS d,
  regexp_replace(replace(replace(x, chr(13), chr(10)), chr(160), ' '), '[ \\t]+', ' ', 'g') AS s FROM raw)
SELECT doc_id, {strip_sql("regexp_replace(d, '\\n{3,}', chr(10) || chr(10), 'g')")} AS document_text,
  {strip_sql("regexp_replace(s, '\\n{3,}', chr(10) || chr(10), 'g')")} AS sheet_text FROM a""")
def clean_text(t):
    raw = F.replace(F.replace(F.replace(
        F.col("text"), F.lit(", "), F.lit(", \t")), F.lit("\n"), F.lit("\r\n\n\n")),
        F.lit("th"), F.lit("t­h"))
    return t.documents.select(
        "doc_id", text.clean_document(raw).alias("document_text"),
        text.clean_question_sheet(raw).alias("sheet_text"))


@query("ligature_fix", """
SELECT doc_id, replace(replace(text, 'fi', 'ﬁ'), 'st', 'ﬆ') <> text AS had_ligatures, text AS fixed
FROM documents""")
def ligature_fix(t):
    raw = F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit("st"), F.lit("ﬆ"))
    return t.documents.select(
        "doc_id", (raw != F.col("text")).alias("had_ligatures"),
        text.ligature_fix(raw).alias("fixed"))


@query("strip_code_fence", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS body FROM events""")
def strip_code_fence(t):
    reply = F.when(F.col("event_type") == "error", F.concat(F.lit("sin datos "), F.col("ts").cast("string"))
                   ).when(F.col("event_type") == "click", F.concat(
                       F.lit("```json\n"), F.col("props"), F.lit("\n```"))
                   ).otherwise(F.concat(F.lit("Respuesta: "), F.col("props"), F.lit(" fin")))
    return t.events.select("event_id", text.strip_code_fence(reply).alias("body"))


@query("fingerprint", f"""
SELECT doc_id, sha256({strip_sql('text')} || chr(10) || lang || chr(10) || source || chr(10)
  || CAST(n_chars AS VARCHAR) || chr(10) || '') AS fp FROM documents""")
def fingerprint(t):
    return t.documents.select("doc_id", text.fingerprint(
        F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars").cast("string"),
        F.lit(" ")).alias("fp"))


ARTICLE_SQL = r"(?i)\bart[íi]culo(?:s)?\s+(\d+)(?:\s*(bis|ter|quater))?"
NORM_SQL = (r"(?i)\b(ley\s+org[aá]nica|real\s+decreto\s+legislativo|decreto\s+legislativo"
            r"|ley|decreto)\s+(\d+)\s*/\s*(\d{4})\b")
CITED = """
 CASE o_orderpriority
  WHEN '1-URGENT' THEN 'Según el artículo ' || day(o_orderdate) || ' de la Ley ' || (o_custkey % 60) || '/2015...'
  WHEN '2-HIGH' THEN 'ARTICULOS  ' || day(o_orderdate) || ' BIS; Real  Decreto Legislativo ' || (o_custkey % 60) || ' / ' || year(o_orderdate)
  WHEN '3-MEDIUM' THEN '¿Qué dice la Ley Orgánica ' || (o_custkey % 60) || '/' || year(o_orderdate) || ', artículo ' || day(o_orderdate) || '?'
  WHEN '4-NOT SPECIFIED' THEN 'Según el Código Civil y el decreto ' || (o_custkey % 60) || '/' || year(o_orderdate)
  ELSE 'Pedido ' || o_orderkey || ' sin cita' END"""


def cited_text():
    """Statements with citations, one per order (the SQL twin is CITED)."""
    day, n = F.dayofmonth("o_orderdate").cast("string"), (F.col("o_custkey") % 60).cast("string")
    year, key = F.year("o_orderdate").cast("string"), F.col("o_orderkey").cast("string")
    p = F.col("o_orderpriority")
    return (
        F.when(p == "1-URGENT", F.concat(F.lit("Según el artículo "), day, F.lit(" de la Ley "), n, F.lit("/2015...")))
        .when(p == "2-HIGH", F.concat(F.lit("ARTICULOS  "), day, F.lit(" BIS; Real  Decreto Legislativo "), n, F.lit(" / "), year))
        .when(p == "3-MEDIUM", F.concat(F.lit("¿Qué dice la Ley Orgánica "), n, F.lit("/"), year, F.lit(", artículo "), day, F.lit("?")))
        .when(p == "4-NOT SPECIFIED", F.concat(F.lit("Según el Código Civil y el decreto "), n, F.lit("/"), year))
        .otherwise(F.concat(F.lit("Pedido "), key, F.lit(" sin cita")))
    )


@query("extract_citation", f"""
WITH q AS (SELECT o_orderkey, {CITED} AS x FROM orders),
k AS (SELECT *, regexp_replace(lower(regexp_extract(x, '{NORM_SQL}', 1)), '\\s+', ' ', 'g') AS kind FROM q)
SELECT o_orderkey,
  CASE WHEN regexp_extract(x, '{ARTICLE_SQL}', 1) = '' THEN NULL ELSE
    regexp_extract(x, '{ARTICLE_SQL}', 1) || CASE WHEN regexp_extract(x, '{ARTICLE_SQL}', 2) = '' THEN ''
      ELSE ' ' || lower(regexp_extract(x, '{ARTICLE_SQL}', 2)) END END AS article,
  CASE WHEN kind <> '' THEN CASE WHEN kind IN ('ley orgánica', 'ley organica') THEN 'LO'
    WHEN kind LIKE '%legislativo' THEN 'DL' WHEN kind = 'decreto' THEN 'D' ELSE 'L' END
    || regexp_extract(x, '{NORM_SQL}', 2) || '_' || regexp_extract(x, '{NORM_SQL}', 3) END AS norm,
  CASE WHEN x LIKE '%Código Civil%' THEN 'CODIGO_CIVIL' END AS named_norm
FROM k""")
def extract_citation(t):
    x = F.col("x")
    return t.orders.select("o_orderkey", cited_text().alias("x")).select(
        "o_orderkey", citation.cited_article(x).alias("article"),
        citation.cited_norm(x).alias("norm"), citation.named_norm(x).alias("named_norm"))


@query("normalize_article", """
SELECT o_orderkey, CASE o_orderpriority
  WHEN '1-URGENT' THEN CAST(day(o_orderdate) AS VARCHAR)
  WHEN '2-HIGH' THEN day(o_orderdate) || ' bis'
  WHEN '3-MEDIUM' THEN day(o_orderdate) || ' quater' ELSE NULL END AS article
FROM orders""")
def normalize_article(t):
    day, p = F.dayofmonth("o_orderdate").cast("string"), F.col("o_orderpriority")
    raw = (
        F.when(p == "1-URGENT", F.concat(F.lit(" 00"), day, F.lit("\n")))
        .when(p == "2-HIGH", F.concat(F.lit("0"), day, F.lit("BIS")))
        .when(p == "3-MEDIUM", F.concat(day, F.lit(" \t Quater ")))
        .when(p == "4-NOT SPECIFIED", F.concat(day, F.lit(" decies")))
    )
    return t.orders.select("o_orderkey", citation.normalize_article(raw).alias("article"))


def norm_code():
    """Norm code of a supplier: special names for a few, patterns for the rest."""
    key = F.col("s_suppkey")
    tail = F.concat(key.cast("string"), F.lit("_"), (F.lit(1980) + F.col("s_nationkey")).cast("string"))
    return F.element_at(F.array(
        F.concat(F.lit("L"), tail), F.concat(F.lit("LO"), tail), F.concat(F.lit("D"), tail),
        F.concat(F.lit("DL"), tail), F.lit("CE"), F.lit("TUE"), F.concat(F.lit("X"), tail)),
        (key % 7 + 1).cast("int"))


CODE_SQL = """CASE s_suppkey % 7 WHEN 0 THEN 'L' || tail WHEN 1 THEN 'LO' || tail WHEN 2 THEN 'D' || tail
 WHEN 3 THEN 'DL' || tail WHEN 4 THEN 'CE' WHEN 5 THEN 'TUE' ELSE 'X' || tail END"""
TAIL_SQL = "(SELECT *, s_suppkey || '_' || (1980 + s_nationkey) AS tail FROM supplier)"


@query("code_to_prefix", f"""
SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'Ley ' || tail WHEN 1 THEN 'Ley Orgánica ' || tail
  WHEN 2 THEN 'Decreto ' || tail WHEN 3 THEN 'Decreto Legislativo ' || tail
  WHEN 4 THEN 'Constitucion Española' WHEN 5 THEN 'Tratado Union Europea' ELSE NULL END AS prefix
FROM {TAIL_SQL}""")
def code_to_prefix(t):
    return t.supplier.select("s_suppkey", citation.code_prefix(norm_code()).alias("prefix"))


@query("alias_generation", f"""
WITH c AS (SELECT s_suppkey, {CODE_SQL} AS code, s_suppkey || '/' || (1980 + s_nationkey) AS ref, s_name FROM {TAIL_SQL}),
a AS (SELECT s_suppkey, unnest(list_concat(CASE s_suppkey % 7
   WHEN 0 THEN ['ley ' || ref] WHEN 1 THEN ['ley organica ' || ref] WHEN 2 THEN ['decreto ' || ref]
   WHEN 3 THEN ['decreto legislativo ' || ref, 'real decreto legislativo ' || ref]
   WHEN 4 THEN ['constitucion española', 'constitucion', 'ce']
   WHEN 5 THEN ['tratado de la union europea', 'tratado union europea', 'tue'] ELSE [] END,
   [s_name || '  Título'])) AS raw FROM c),
n AS (SELECT DISTINCT s_suppkey, {spaces_sql('raw')} AS alias FROM a)
SELECT s_suppkey, string_agg(alias, ';' ORDER BY length(alias) DESC, alias) AS aliases, COUNT(*) AS n
FROM n GROUP BY s_suppkey""")
def alias_generation(t):
    aliases = citation.code_aliases(norm_code(), F.concat(F.col("s_name"), F.lit("  Título")))
    return t.supplier.select(
        "s_suppkey", F.array_join(aliases, ";").alias("aliases"),
        F.size(aliases).cast("long").alias("n"))


PRACTICAL_SQL = r"""d AS (SELECT doc_id, text, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')) AS n FROM documents),
r AS (SELECT doc_id,
  CASE WHEN regexp_matches(n, '(^|[^\w\x{DF}])(?:suponga que|supongamos que|imagine que|en el supuesto de que|supuesto de hecho|caso planteado)($|[^\w\x{DF}])') THEN 4 ELSE 0 END AS a,
  CASE WHEN regexp_matches(n, '(^|[^\w\x{DF}])(?:fructuosa|mariano|(?:el|un) funcionario|(?:la|una) funcionaria|(?:el|un) interesado|(?:la|una) interesada|(?:el|un) particular|(?:la|una) ciudadana|(?:el|un) ciudadano|(?:la|una) conselleria|conselleria [a-z]|(?:la|una) direccion general|(?:el|un) director general|(?:el|un) ayuntamiento|(?:el|un) organo de contratacion|(?:la|una) intervencion delegada|(?:la|una) empresa|(?:el|un) licitador|persona tecnica encargada|jefa de seccion)($|[^\w\x{DF}])')
    OR regexp_matches(n, '(^|[^\w\x{DF}])[a-z]{2,}(?:\s+[a-z]\.){0,3}\s+(?:es|se encuentra|ha|presenta|solicita|interpone|pretende|ocupa)($|[^\w\x{DF}])') THEN 2 ELSE 0 END AS b,
  CASE WHEN regexp_matches(n, '\b20\d{2}\b') THEN 2 ELSE 0 END AS c,
  CASE WHEN regexp_matches(n, 'enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre') THEN 2 ELSE 0 END AS e,
  CASE WHEN regexp_matches(n, '\d+\s*%') THEN 2 ELSE 0 END AS f,
  CASE WHEN regexp_matches(n, '\b\d+[.,]?\d*\b') THEN 1 ELSE 0 END AS g,
  CASE WHEN regexp_matches(n, '(^|[^\w\x{DF}])(?:solicita|presenta|modifica|resuelve|dicta|notifica|tramita|incoa|adjudica|autoriza|deniega|aprueba|acuerda)($|[^\w\x{DF}])') THEN 2 ELSE 0 END AS h,
  CASE WHEN regexp_matches(n, '(^|[^\w\x{DF}])(?:posteriormente|despues|tras|mas tarde|de nuevo|finalmente)($|[^\w\x{DF}])') THEN 1 ELSE 0 END AS i,
  CASE WHEN regexp_matches(text, '(^|[^\w\x{C0}-\x{24F}])[A-Z]{2,}($|[^\w\x{C0}-\x{24F}])') THEN 2 ELSE 0 END AS acro FROM d)"""


@query("practical_score", f"""WITH {PRACTICAL_SQL}
SELECT doc_id, CAST(a + b + c + e + f + g + h + i AS INTEGER) AS strict_points, acro > 0 AS has_acronym FROM r""")
def practical_score(t):
    return t.documents.select(
        "doc_id", features.practical_score(F.col("text"), strict=True).alias("strict_points"),
        features.practical_rules(F.col("text"))[2][1].alias("has_acronym"))


FLAG_ARGS = dict(
    openings=("the", "la", "es", "que"), persons=("the", "elle", "sch", "un"),
    organs=("la", "der", "with", "los"), actions=("on", "pour", "und", "por"),
)
FLAG_SQL = r"""f AS (SELECT doc_id, n, text,
  starts_with(n, 'the') AS opens_00, starts_with(n, 'la') AS opens_01, starts_with(n, 'es') AS opens_02,
  starts_with(n, 'que') AS opens_03, regexp_matches(n, '(^|[^\w\x{DF}])(?:the|elle|sch|un)($|[^\w\x{DF}])') AS person,
  regexp_matches(n, '(^|[^\w\x{DF}])(?:la|der|with|los)($|[^\w\x{DF}])') AS organ, regexp_matches(n, '(^|[^\w\x{DF}])(?:on|pour|und|por)($|[^\w\x{DF}])') AS action,
  regexp_matches(text, '(?i)\b\d{1,2}\s+de\s+(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)(?:\s+de\s+\d{4})?\b') AS date,
  regexp_matches(text, '(?i)\b\d{1,3}(?:\.\d{3})*(?:,\d+)?\s*euros\b') AS amount
  FROM (SELECT doc_id, text, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')) AS n FROM documents))"""


@query("feature_flags", f"""WITH {FLAG_SQL}
SELECT doc_id, opens_00, opens_01, opens_02, opens_03, person, organ, action, date, amount,
  action AND (person OR organ) AS subject_action, action AND (date OR amount) AS action_datum FROM f""")
def feature_flags(t):
    flags = features.phrase_flags(F.col("text"), **FLAG_ARGS)
    return t.documents.select("doc_id", *[c.alias(n) for n, c in flags.items()])
