"""Coverage catalogue derived from the suppliers, citations derived from the orders."""

from pyspark.sql import functions as F

from corpusbank.functions import citation
from corpusbank.operators import coverage as cov
from corpusbank.queries.registry import query

# one document per supplier: two suppliers share a norm, the nation is the topic
DOC_SQL = """doc AS (SELECT s_suppkey, 'S' || (s_suppkey // 2) AS norm, r_name AS part, s_nationkey AS topic,
  s_suppkey % 20 + 1 AS lo, s_suppkey % 20 + 1 + s_nationkey AS hi, s_suppkey % 4 AS v,
  'Norma S' || (s_suppkey // 2) || CASE s_suppkey % 4
    WHEN 0 THEN ' articulos ' || (s_suppkey % 20 + 1) || '-' || (s_suppkey % 20 + 1 + s_nationkey)
    WHEN 1 THEN ' artículos ' || (s_suppkey % 20 + 1) || ', ' || (s_suppkey % 20 + 1 + s_nationkey) || ' y 40 bis'
    WHEN 2 THEN ' Articulo ' || (s_suppkey % 20 + 1) || ' - ' || (s_suppkey % 20 + 1 + s_nationkey) ELSE '' END || '.pdf' AS document
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
COV_SQL = DOC_SQL + """,
cov AS (SELECT s_suppkey, norm, part, topic, document, CAST(unnest(range(lo, hi + 1)) AS VARCHAR) AS article FROM doc WHERE v IN (0, 2)
  UNION SELECT s_suppkey, norm, part, topic, document, unnest([CAST(lo AS VARCHAR), CAST(hi AS VARCHAR), '40 bis']) FROM doc WHERE v = 1),
full_norm AS (SELECT DISTINCT norm, part, topic FROM doc WHERE v = 3)"""


def associations(t):
    """(s_suppkey, norm, part, topic, document): one covering document per supplier."""
    key = F.col("s_suppkey")
    lo = key % 20 + 1
    hi = lo + F.col("s_nationkey")
    lo_s, hi_s = lo.cast("string"), hi.cast("string")
    norm = F.concat(F.lit("S"), F.floor(key / 2).cast("string"))
    suffix = (
        F.when(key % 4 == 0, F.concat(F.lit(" articulos "), lo_s, F.lit("-"), hi_s))
        .when(key % 4 == 1, F.concat(F.lit(" artículos "), lo_s, F.lit(", "), hi_s, F.lit(" y 40 bis")))
        .when(key % 4 == 2, F.concat(F.lit(" Articulo "), lo_s, F.lit(" - "), hi_s))
        .otherwise("")
    )
    return (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", norm.alias("norm"), F.col("r_name").alias("part"),
                F.col("s_nationkey").alias("topic"),
                F.concat(F.lit("Norma "), norm, suffix, F.lit(".pdf")).alias("document"))
    )


def coverage_table(t):
    return cov.coverage_from_documents(associations(t))


CIT_SQL = """cit AS (SELECT o_orderkey, 'S' || (o_custkey // 30) AS norm,
  CAST(day(o_orderdate) AS VARCHAR) || CASE WHEN o_orderpriority = '2-HIGH' THEN ' bis' ELSE '' END AS article FROM orders)"""


def citations(t):
    """(o_orderkey, norm, article): one citation per order."""
    return t.orders.select(
        "o_orderkey",
        F.concat(F.lit("S"), F.floor(F.col("o_custkey") / 30).cast("string")).alias("norm"),
        F.concat(F.dayofmonth("o_orderdate").cast("string"), F.when(
            F.col("o_orderpriority") == "2-HIGH", " bis").otherwise("")).alias("article"))


@query("coverage_from_name", f"""
WITH {DOC_SQL} SELECT s_suppkey, v = 3 AS whole, CASE v WHEN 0 THEN lo || '-' || hi WHEN 1 THEN lo || ', ' || hi || ' y 40 bis'
  WHEN 2 THEN lo || ' - ' || hi END AS expression FROM doc""")
def coverage_from_name(t):
    expression = citation.coverage_expression(F.col("document"))
    return associations(t).select(
        "s_suppkey", expression.isNull().alias("whole"), expression.alias("expression"))


@query("expand_ranges", """
WITH e AS (SELECT s_suppkey, s_suppkey % 20 + 1 AS lo, s_suppkey % 20 + 1 + s_nationkey AS hi, s_suppkey % 6 AS v FROM supplier),
a AS (SELECT s_suppkey, unnest(range(lo, hi + 1)) AS n, CAST(n AS VARCHAR) AS a FROM e WHERE v = 0
  UNION SELECT s_suppkey, x, CAST(x AS VARCHAR) FROM (SELECT s_suppkey, unnest([lo, hi]) AS x FROM e WHERE v = 1)
  UNION SELECT s_suppkey, lo, lo || ' bis' FROM e WHERE v = 1
  UNION SELECT s_suppkey, x, CAST(x AS VARCHAR) FROM (SELECT s_suppkey, unnest(list_concat(range(lo, lo + 4), range(lo + 2, hi + 3))) AS x FROM e WHERE v = 2)
  UNION SELECT s_suppkey, lo, CAST(lo AS VARCHAR) FROM e WHERE v = 3 AND lo = hi)
SELECT e.s_suppkey, g.articles FROM e LEFT JOIN (SELECT s_suppkey, string_agg(a, ',' ORDER BY n, a) AS articles FROM a GROUP BY 1) g USING (s_suppkey)""")
def expand_ranges(t):
    key = F.col("s_suppkey")
    lo = (key % 20 + 1).cast("string")
    hi_n = key % 20 + 1 + F.col("s_nationkey")
    hi = hi_n.cast("string")
    expression = (
        F.when(key % 6 == 0, F.concat(lo, F.lit("-"), hi))
        .when(key % 6 == 1, F.concat(F.lit(" "), lo, F.lit(" Bis, "), hi, F.lit(" Y "), lo))
        .when(key % 6 == 2, F.concat(lo, F.lit(" - "), (key % 20 + 4).cast("string"), F.lit(" y "),
                                     (key % 20 + 3).cast("string"), F.lit("-"), (hi_n + 2).cast("string")))
        .when(key % 6 == 3, F.concat(hi, F.lit("-"), lo))
        .when(key % 6 == 4, F.concat(lo, F.lit(" y anexo")))
        .otherwise(F.concat(lo, F.lit(" decies")))
    )
    return t.supplier.select(
        "s_suppkey", F.array_join(citation.expand_ranges(expression), ",").alias("articles"))


@query("coverage_join", f"""
WITH {COV_SQL}, {CIT_SQL} SELECT DISTINCT o_orderkey, norm, article, part, topic FROM cit JOIN cov USING (norm, article)""")
def coverage_join(t):
    return cov.coverage_join(citations(t), coverage_table(t), include_full=False).select(
        "o_orderkey", "norm", "article", "part", "topic")


@query("coverage_join_full_docs", f"""
WITH {COV_SQL}, {CIT_SQL} SELECT o_orderkey, norm, article, part, topic FROM cit JOIN cov USING (norm, article)
UNION SELECT o_orderkey, norm, article, part, topic FROM cit JOIN full_norm USING (norm)""")
def coverage_join_full_docs(t):
    return cov.coverage_join(citations(t), coverage_table(t)).select(
        "o_orderkey", "norm", "article", "part", "topic")


@query("semi_join_membership", f"""
WITH {COV_SQL}, {CIT_SQL} SELECT o_orderkey, norm FROM cit WHERE norm IN (SELECT norm FROM doc WHERE v < 3)""")
def semi_join_membership(t):
    return citations(t).select("o_orderkey", "norm").join(
        coverage_table(t).filter(~F.col("full")).select("norm"), "norm", "left_semi")


@query("single_or_null", f"""
WITH {COV_SQL}, {CIT_SQL}, topics AS (SELECT DISTINCT o_orderkey, topic FROM cit JOIN cov USING (norm, article))
SELECT o_orderkey, CASE WHEN COUNT(DISTINCT topic) = 1 THEN MIN(topic) END AS topic, COUNT(*) AS n_topics FROM topics GROUP BY o_orderkey""")
def single_or_null(t):
    topics = cov.coverage_join(citations(t), coverage_table(t), include_full=False).select(
        "o_orderkey", "topic").distinct()
    return topics.groupBy("o_orderkey").agg(
        cov.single_value("topic").alias("topic"), F.count(F.lit(1)).alias("n_topics"))


@query("prefer_matching_associations", f"""
WITH {COV_SQL}, {CIT_SQL},
x AS (SELECT o_orderkey, s_suppkey, topic, v = 3 OR EXISTS (SELECT 1 FROM cov WHERE cov.s_suppkey = doc.s_suppkey AND cov.article = cit.article) AS m
  FROM cit JOIN doc USING (norm))
SELECT o_orderkey, s_suppkey, topic, m AS matches FROM (SELECT *, bool_or(m) OVER (PARTITION BY o_orderkey) AS any_m FROM x) WHERE m OR NOT any_m""")
def prefer_matching_associations(t):
    # an order cites one norm, so a group holds the documents of that norm only
    assoc = citations(t).join(coverage_table(t), "norm")
    match = F.col("full") | F.array_contains("articles", F.col("article"))
    assoc = assoc.withColumn("matches", F.coalesce(match, F.lit(False)))
    return cov.prefer_matching(assoc, ["o_orderkey"], F.col("matches")).select(
        "o_orderkey", "s_suppkey", "topic", "matches")


@query("syllabus_stats", f"""
WITH {COV_SQL} SELECT (SELECT COUNT(DISTINCT part) FROM doc) AS parts, (SELECT COUNT(*) FROM (SELECT DISTINCT part, topic FROM doc)) AS topics,
 (SELECT COUNT(DISTINCT document) FROM doc) AS documents, (SELECT COUNT(DISTINCT norm) FROM doc) AS norms,
 (SELECT COUNT(*) FROM (SELECT DISTINCT norm, article FROM cov)) AS articles""")
def syllabus_stats(t):
    table = coverage_table(t)
    return cov.syllabus_stats(table.select("part", "topic"), table)


@query("distinct_documents", f"""
WITH {COV_SQL} SELECT DISTINCT part, document FROM doc ORDER BY part, document""")
def distinct_documents(t):
    return associations(t).select("part", "document").distinct().orderBy("part", "document")


@query("longest_prefix_join", """
WITH c AS (SELECT DISTINCT 'Brand#' || (i + 1) AS prefix, 'B' || (i + 1) AS code, i AS pos FROM (SELECT s_nationkey AS i FROM supplier)),
m AS (SELECT p_partkey, code, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC, pos) AS r
  FROM part JOIN c ON starts_with(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '_', 'g'), regexp_replace(lower(prefix), '[^a-z0-9]+', '_', 'g')))
SELECT p_partkey, code FROM part LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (p_partkey)""")
def longest_prefix_join(t):
    catalogue = t.supplier.select(F.col("s_nationkey").alias("pos")).distinct().select(
        F.concat(F.lit("Brand#"), (F.col("pos") + 1).cast("string")).alias("prefix"),
        F.concat(F.lit("B"), (F.col("pos") + 1).cast("string")).alias("code"), "pos")
    names = t.part.select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("name"))
    return cov.longest_prefix(names, "name", catalogue).select("p_partkey", "code")


_WORDS = r"trim(regexp_replace(trim(regexp_replace(strip_accents(lower({})), '\s+', ' ', 'g')), '[^\p{{L}}\p{{N}}/_]+', ' ', 'g'))"


@query("alias_containment_join", f"""
WITH d AS (SELECT doc_id, ' ' || {_WORDS.format('text')} || ' ' AS n FROM documents),
b AS (SELECT item_id, ' ' || {_WORDS.format('text')} || ' ' AS n FROM benchmark)
SELECT d.doc_id, COUNT(item_id) AS n_codes, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS codes
FROM d LEFT JOIN b ON contains(d.n, b.n) AND b.n <> '  ' GROUP BY d.doc_id""")
def alias_containment_join(t):
    aliases = t.benchmark.select(F.col("item_id").cast("string").alias("code"), F.col("text").alias("alias"))
    found = cov.contained_codes(t.documents.select("doc_id", "text"), "text", aliases)
    return found.select(
        "doc_id", F.size("codes").cast("long").alias("n_codes"),
        F.nullif(F.array_join("codes", ","), F.lit("")).alias("codes"))
