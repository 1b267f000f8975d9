"""Retrieval queries: corpus statistics, BM25 rankings, candidate packs."""

from pyspark.sql import functions as F

from corpusbank.constants import STOP_WORDS
from corpusbank.functions.text import slugify
from corpusbank.operators import search
from corpusbank.queries.registry import query
from corpusbank.queries.text import strip_sql, tokens_sql

LANGS = ("de", "en", "es", "fr", "xx")


def bm25_sql(docs: str = "documents", queries: str = "benchmark", part: str | None = None) -> str:
    """CTEs from the tables (doc_id, text[, part]) and (item_id, text[, part]) to ``ranked``."""
    p, on = (f"{part}, ", f" AND t.{part} = d.{part}") if part else ("", "")
    tp, dp = (f"t.{part}, ", f"d.{part}, ") if part else ("", "")
    return f"""dtok AS (SELECT {p}doc_id, {tokens_sql('text')} AS toks FROM {docs}),
stats AS (SELECT {p}COUNT(*) AS n, AVG(len(toks)) AS avgdl FROM dtok {'GROUP BY ' + part if part else ''}),
tf AS (SELECT {p}doc_id, dl, tok, COUNT(*) AS tf FROM (SELECT {p}doc_id, len(toks) AS dl, unnest(toks) AS tok FROM dtok) GROUP BY ALL),
df AS (SELECT {p}tok, COUNT(*) AS df FROM tf GROUP BY ALL),
terms AS (SELECT DISTINCT {p}item_id, unnest({tokens_sql('text')}) AS tok FROM {queries}),
scored AS (SELECT item_id, doc_id, round(SUM(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
    / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))), 6) AS score
  FROM terms t JOIN tf d ON t.tok = d.tok{on} JOIN df ON df.tok = d.tok{f' AND df.{part} = d.{part}' if part else ''}
  {f'JOIN stats ON stats.{part} = d.{part}' if part else 'CROSS JOIN stats'} GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0 QUALIFY rank <= 5)"""


def candidates(t, corpus=None, queries=None, part=None, k=5):
    """(item_id, doc_id, score, rank) over all documents and all benchmark texts."""
    return search.bm25_topk(
        t.documents if corpus is None else corpus,
        t.benchmark if queries is None else queries,
        doc_id="doc_id", text="text", query_id="item_id", query_text="text", k=k, part=part)


@query("bm25_topk_fragments",
       f"WITH {bm25_sql()} SELECT item_id, doc_id, score, rank FROM ranked")
def bm25_topk_fragments(t):
    return candidates(t).select("item_id", "doc_id", "score", "rank")


ALLOWED_SQL = "SELECT DISTINCT source FROM documents WHERE contains(strip_accents(lower(source)), 'src1')"


def allowed_sources(t):
    """Sources of the wanted kind: their normalised name contains the word."""
    return t.documents.select("source").distinct().filter(
        slugify(F.col("source")).contains("src1"))


@query("docs_of_topic_kind", f"""
SELECT DISTINCT source, lang FROM documents WHERE source IN ({ALLOWED_SQL})""")
def docs_of_topic_kind(t):
    return t.documents.select("source", "lang").distinct().join(
        allowed_sources(t), "source", "left_semi")


@query("inlist_prune", f"""
SELECT doc_id, source, n_chars FROM documents WHERE source IN ({ALLOWED_SQL})""")
def inlist_prune(t):
    return t.documents.select("doc_id", "source", "n_chars").join(
        allowed_sources(t), "source", "left_semi")


@query("bm25_topk_documents", f"""
WITH docs AS (SELECT * FROM documents WHERE source IN ({ALLOWED_SQL})), {bm25_sql('docs')}
SELECT item_id, doc_id, score, rank, source FROM ranked JOIN docs USING (doc_id)""")
def bm25_topk_documents(t):
    docs = t.documents.join(allowed_sources(t), "source", "left_semi")
    ranked = candidates(t, corpus=docs)
    return ranked.join(t.documents.select("doc_id", "source"), "doc_id").select(
        "item_id", "doc_id", "score", "rank", "source")


LANG_SQL = f"list_extract({list(LANGS)}, CAST(item_id % 5 AS INTEGER) + 1)"


@query("bm25_per_partition", f"""
WITH q AS (SELECT item_id, text, {LANG_SQL} AS lang FROM benchmark), {bm25_sql('documents', 'q', 'lang')}
SELECT item_id, q.lang, doc_id, score, rank FROM ranked JOIN q USING (item_id)""")
def bm25_per_partition(t):
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (F.col("item_id") % 5 + 1).cast("int"))
    items = t.benchmark.withColumn("lang", lang)
    ranked = candidates(t, queries=items, part=["lang"])
    return ranked.join(items.select("item_id", "lang"), "item_id").select(
        "item_id", "lang", "doc_id", "score", "rank")


@query("corpus_stats", f"""
WITH dtok AS (SELECT lang, doc_id, {tokens_sql('text')} AS toks FROM documents),
stats AS (SELECT lang, COUNT(*) AS n, round(AVG(len(toks)), 6) AS avgdl FROM dtok GROUP BY lang)
SELECT lang, tok, COUNT(DISTINCT doc_id) AS df, n, avgdl FROM
 (SELECT lang, doc_id, unnest(toks) AS tok FROM dtok) JOIN stats USING (lang) GROUP BY lang, tok, n, avgdl""")
def corpus_stats(t):
    docs = search.document_terms(t.documents, "doc_id", "text", ["lang"], STOP_WORDS)
    stats, df = search.corpus_stats(docs, ["lang"])
    return df.join(stats, "lang").select("lang", "tok", "df", "n", F.round("avgdl", 6).alias("avgdl"))


@query("candidate_pack", f"""
WITH {bm25_sql()}
SELECT item_id, string_agg(chr(10) || repeat('=', 60) || chr(10) || 'Fragmento ' || rank || chr(10) || 'fragmento_id=' || doc_id || chr(10)
  || 'documento=' || source || chr(10) || 'referencia=' || lang || '-' || doc_id || chr(10) || chr(10) || {strip_sql("text")} || chr(10), '' ORDER BY rank) AS pack
FROM ranked JOIN documents USING (doc_id) GROUP BY item_id""")
def candidate_pack(t):
    docs = t.documents.withColumn("reference", F.concat_ws("-", "lang", F.col("doc_id").cast("string")))
    return search.pack_fragments(
        candidates(t), docs, doc_id="doc_id", text="text", query_id="item_id", name="source",
        reference="reference")


@query("document_pack", f"""
WITH {bm25_sql()}
SELECT item_id, string_agg(chr(10) || chr(10) || repeat('-', 70) || chr(10) || 'DOCUMENTO ' || rank || chr(10) || repeat('-', 70) || chr(10) || 'ID: ' || doc_id || chr(10)
  || 'Nombre: ' || source || CASE WHEN lang <> 'xx' THEN chr(10) || 'Título: ' || lang ELSE '' END || chr(10) || chr(10) || 'Contenido:' || chr(10) || chr(10)
  || {strip_sql("substr(text, 1, 3000)")}, '' ORDER BY rank) AS pack
FROM ranked JOIN documents USING (doc_id) GROUP BY item_id""")
def document_pack(t):
    """Whole documents as candidates: the first 3,000 characters of each, as the feature asks."""
    docs = t.documents.withColumn("title", F.when(F.col("lang") != "xx", F.col("lang")))
    return search.pack_documents(
        candidates(t), docs, doc_id="doc_id", text="text", query_id="item_id", name="source",
        title="title")
