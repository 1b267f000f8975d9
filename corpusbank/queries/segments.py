"""Splitting whole texts into fragments, questions and options."""

from pyspark.sql import functions as F

from corpusbank.functions.text import let
from corpusbank.operators import segment
from corpusbank.operators.context import context_budget
from corpusbank.operators.joins import explode_options as explode_option_map
from corpusbank.queries.registry import query
from corpusbank.queries.text import strip_sql

# headings of the test texts: a line whose first word starts with a vowel; the level
# below starts with B-M, the lowest with N-Z
HEADING = r"([AEIOU]\w*)(?:\s+(bis|ter))?"
LEVELS = dict(heading=HEADING, section="[B-M]", letter="[N-Z]", limit=300)

_PIECES = r"""h AS (SELECT doc_id, i, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM
  (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (SELECT doc_id, string_split(
    regexp_replace(text, '(?m)^(\s*[AEIOU])', chr(1) || '\1', 'g'), chr(1)) AS ps FROM documents)) WHERE i > 0),
art AS (SELECT doc_id, i, regexp_extract(p, '^([AEIOU]\w*)', 1) AS number,
  nullif(lower(regexp_extract(p, '^[AEIOU]\w*\s+(bis|ter)', 1)), '') AS suffix, p FROM h WHERE p <> '')"""


@query("segment_by_heading", f"""
WITH {_PIECES}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS ord, number, suffix, p AS text FROM art""")
def segment_by_heading(t):
    return t.documents.select(
        "doc_id", F.posexplode(segment.articles(F.col("text"), HEADING)).alias("pos", "a")
    ).select("doc_id", (F.col("pos") + 1).alias("ord"), "a.*")


_FRAGMENTS = _PIECES + r""",
named AS (SELECT doc_id, i, 'Artículo ' || concat_ws(' ', number, suffix) AS ref, concat_ws(' ', number, suffix) AS article, p FROM art),
b0 AS (SELECT doc_id, i, ref, article, p, unnest(bs) AS b, unnest(range(len(bs))) AS j FROM (SELECT *, list_filter(list_transform(
  string_split(regexp_replace(p, '(?m)^(\s*[B-M])', chr(1) || '\1', 'g'), chr(1)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS bs FROM named WHERE length(p) > 300)),
s0 AS (SELECT doc_id, i, j, ref, article, unnest(ss) AS s, unnest(range(len(ss))) AS k FROM (SELECT *, list_filter(list_transform(
  string_split(regexp_replace(b, '(?m)^(\s*[N-Z])', chr(1) || '\1', 'g'), chr(1)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM b0 WHERE length(b) > 300)),
everything AS (
  SELECT doc_id, i, 0 AS j, 0 AS k, 'ARTICULO' AS kind, ref AS reference, article, NULL AS section, p AS text FROM named WHERE length(p) <= 300
  UNION ALL SELECT doc_id, i, j, 0, 'APARTADO', ref || ', bloque ' || (j + 1), article, CAST(j + 1 AS VARCHAR), b FROM b0 WHERE length(b) <= 300
  UNION ALL SELECT doc_id, i, j, k, 'LETRA', ref || ', bloque ' || (j + 1) || '.' || (k + 1), article, (j + 1) || '.' || (k + 1), s FROM s0),
frag AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) AS INTEGER) AS ord, kind, reference, article, section, text
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, reference, text ORDER BY i, j, k) AS copy FROM everything) WHERE copy = 1)"""


def document_fragments(t):
    """(doc_id, ord, kind, reference, article, section, text) of all documents."""
    return segment.explode_fragments(t.documents, ["doc_id"], "text", **LEVELS)


@query("hierarchical_chunk", f"WITH {_FRAGMENTS} SELECT * FROM frag")
def hierarchical_chunk(t):
    return document_fragments(t)


@query("fragment_dedup", f"""
WITH {_FRAGMENTS}
SELECT doc_id, e.before, f.after FROM (SELECT doc_id, CAST(COUNT(*) AS INTEGER) AS before FROM everything GROUP BY doc_id) e
JOIN (SELECT doc_id, CAST(COUNT(*) AS INTEGER) AS after FROM frag GROUP BY doc_id) f USING (doc_id)""")
def fragment_dedup(t):
    levels = t.documents.select(
        "doc_id", F.size(segment.all_fragments(F.col("text"), **LEVELS)).alias("before"),
        F.size(segment.fragments(F.col("text"), **LEVELS)).alias("after"))
    return levels.filter("before > 0")


_QUESTION_SHEET_SQL = r"regexp_replace(regexp_replace(text, '(?m)^([A-ZÉ])', '7 \1', 'g'), '\. ([A-Z])', '.' || chr(10) || '12\1', 'g')"


def question_sheet():
    """Documents as numbered question sheets: every line and sentence gets a number."""
    out = F.regexp_replace("text", "(?m)^([A-ZÉ])", "7 $1")
    return F.regexp_replace(out, r"\. ([A-Z])", ".\n12$1")


@query("segment_questions", rf"""
WITH p AS (SELECT doc_id, i, piece FROM (SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM
  (SELECT doc_id, string_split(regexp_replace({_QUESTION_SHEET_SQL}, '(?m)^(\s*\d{{1,4}}[\s¿A-ZÁÉÍÓÚÑ])', chr(1) || '\1', 'g'), chr(1)) AS ps FROM documents)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS ord,
  CAST(regexp_extract(piece, '^\s*(\d{{1,4}})', 1) AS INTEGER) AS number,
  {strip_sql(r"regexp_replace(piece, '^\s*\d{1,4}', '')")} AS text
FROM p WHERE regexp_matches(piece, '^\s*\d{{1,4}}[\s¿A-ZÁÉÍÓÚÑ]')""")
def segment_questions(t):
    return t.documents.select(
        "doc_id", F.posexplode(segment.questions(question_sheet())).alias("pos", "q")
    ).select("doc_id", (F.col("pos") + 1).alias("ord"), "q.*")


OPTION_SHEET_SQL = """CASE p_type
  WHEN 'STANDARD' THEN p_name || chr(10) || '  a) ' || p_brand || chr(10) || 'b)' || p_size || chr(10) || 'C) tipo ' || p_type || chr(10) || 'd) ninguna'
  WHEN 'ECONOMY' THEN p_name || chr(10) || 'A) ' || p_brand || chr(10) || 'B) ' || p_size || chr(10) || 'C) ' || p_type
  WHEN 'MEDIUM' THEN p_name || chr(10) || 'b) ' || p_brand || chr(10) || 'a) ' || p_size || chr(10) || 'c) ' || p_type || chr(10) || 'd) otra'
  WHEN 'PROMO' THEN 'a) ' || p_brand || chr(10) || 'b) ' || p_size || chr(10) || 'c) ' || p_type || chr(10) || 'd) otra'
  WHEN 'LARGE' THEN p_name || chr(10) || 'a) ' || p_brand || chr(10) || 'b) ' || p_size || chr(10) || 'c) ' || p_type || chr(10) || 'd) '
  ELSE p_name || chr(10) || 'a) ' || p_brand || chr(10) || 'b) x' || chr(10) || 'c) y' || chr(10) || 'd) z' || chr(10) || 'a) sobra' END"""


def option_sheet():
    """Question blocks with good and defective option lists, one per part."""
    nl, name, brand = F.lit("\n"), F.col("p_name"), F.col("p_brand")
    size, kind = F.col("p_size").cast("string"), F.col("p_type")
    return (
        F.when(kind == "STANDARD", F.concat(name, nl, F.lit("  a) "), brand, nl, F.lit("b)"), size, nl, F.lit("C) tipo "), kind, nl, F.lit("d) ninguna")))
        .when(kind == "ECONOMY", F.concat(name, nl, F.lit("A) "), brand, nl, F.lit("B) "), size, nl, F.lit("C) "), kind))
        .when(kind == "MEDIUM", F.concat(name, nl, F.lit("b) "), brand, nl, F.lit("a) "), size, nl, F.lit("c) "), kind, nl, F.lit("d) otra")))
        .when(kind == "PROMO", F.concat(F.lit("a) "), brand, nl, F.lit("b) "), size, nl, F.lit("c) "), kind, nl, F.lit("d) otra")))
        .when(kind == "LARGE", F.concat(name, nl, F.lit("a) "), brand, nl, F.lit("b) "), size, nl, F.lit("c) "), kind, nl, F.lit("d) ")))
        .otherwise(F.concat(name, nl, F.lit("a) "), brand, nl, F.lit("b) x\nc) y\nd) z\na) sobra")))
    )


@query("parse_options", """
SELECT p_partkey,
  CASE WHEN p_type = 'STANDARD' THEN p_name END AS stem, CASE WHEN p_type = 'STANDARD' THEN p_brand END AS a,
  CASE WHEN p_type = 'STANDARD' THEN CAST(p_size AS VARCHAR) END AS b,
  CASE WHEN p_type = 'STANDARD' THEN 'tipo STANDARD' END AS c, CASE WHEN p_type = 'STANDARD' THEN 'ninguna' END AS d,
  CASE p_type WHEN 'STANDARD' THEN NULL WHEN 'ECONOMY' THEN 'No se detectaron exactamente cuatro opciones.'
    WHEN 'MEDIUM' THEN 'Las opciones no siguen el orden A, B, C y D.' WHEN 'PROMO' THEN 'El enunciado está vacío.'
    WHEN 'LARGE' THEN 'Alguna opción está vacía.' ELSE 'No se detectaron exactamente cuatro opciones.' END AS reason,
  CASE WHEN p_type IN ('STANDARD', 'MEDIUM', 'LARGE', 'SMALL') THEN p_name END AS lenient_stem,
  CASE p_type WHEN 'STANDARD' THEN p_brand WHEN 'MEDIUM' THEN CAST(p_size AS VARCHAR) WHEN 'LARGE' THEN p_brand
    WHEN 'SMALL' THEN p_brand END AS lenient_a
FROM part""")
def parse_options(t):
    parsed = t.part.select(
        "p_partkey", segment.parse_options(option_sheet()).alias("q"),
        segment.parse_options_lenient(option_sheet()).alias("l"))
    return parsed.select(
        "p_partkey", "q.stem", *[F.col("q.options")[x].alias(x.lower()) for x in "ABCD"],
        "q.reason", F.col("l.stem").alias("lenient_stem"),
        F.col("l.options")["A"].alias("lenient_a"))


@query("explode_options", """
SELECT p_partkey, unnest(['A', 'B', 'C', 'D']) AS letter,
  unnest([p_brand, CAST(p_size AS VARCHAR), 'tipo STANDARD', 'ninguna']) AS text
FROM part WHERE p_type = 'STANDARD'""")
def explode_options(t):
    parsed = t.part.select("p_partkey", segment.parse_options(option_sheet())["options"].alias("options"))
    return explode_option_map(parsed.filter("options IS NOT NULL"), ["p_partkey"])


@query("context_budget", rf"""
WITH {_FRAGMENTS},
blocks AS (SELECT source, d.doc_id, 0 AS ord, chr(10) || repeat('=', 70) || chr(10) || 'DOCUMENTO: ' || source || '-' || d.doc_id || chr(10) || repeat('=', 70) AS block FROM documents d
  UNION ALL SELECT source, doc_id, ord, chr(10) || '[' || reference || ']' || chr(10) || frag.text FROM frag JOIN documents USING (doc_id)
  UNION ALL SELECT source, d.doc_id, 1, chr(10) || d.text FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM frag) AND d.text <> '')
SELECT source, substr(string_agg(block, chr(10) ORDER BY doc_id, ord), 1, 18000) AS context FROM blocks GROUP BY source""")
def context_budget_query(t):
    fragments = segment.fragments(F.col("text"), **LEVELS)
    header = F.concat(
        F.lit("\n" + "=" * 70 + "\nDOCUMENTO: "), F.col("source"), F.lit("-"),
        F.col("doc_id").cast("string"), F.lit("\n" + "=" * 70))
    fallback = F.when(F.col("text") != "", F.array(F.concat(F.lit("\n"), F.col("text")))).otherwise(
        F.array().cast("array<string>"))
    blocks = let(fragments, lambda found: F.concat(F.array(header), F.when(
        F.size(found) > 0, F.transform(found, lambda f: F.concat(
            F.lit("\n["), f["reference"], F.lit("]\n"), f["text"]))).otherwise(fallback)))
    return context_budget(t.documents, ["source"], "doc_id", blocks)
