"""Relational joins on the star tables."""

from pyspark.sql import functions as F

from corpusbank.operators import joins
from corpusbank.queries.registry import query


@query("fragment_document_join", """
SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def fragment_document_join(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "o_orderstatus")


@query("question_exam_join", """
SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def question_exam_join(t):
    exams = t.customer.filter(F.col("c_mktsegment") == "BUILDING")
    return t.orders.join(exams, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("bank_star_join", """
WITH ev AS (SELECT l_orderkey AS q, l_suppkey AS c, MIN(l_partkey) AS topic_id, MIN(l_partkey) % 25 AS part_id FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey AS question_id, l_suppkey AS call_id, l_quantity AS qty, s_name AS call, n_name AS part, p_name AS topic, o_orderstatus AS question_state, c_name AS exam
FROM lineitem JOIN ev ON q = l_orderkey AND c = l_suppkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = ev.part_id JOIN part ON p_partkey = ev.topic_id
LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') o ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def bank_star_join(t):
    bank = t.lineitem.select(F.col("l_orderkey").alias("question_id"), F.col("l_suppkey").alias("call_id"),
                             F.col("l_quantity").alias("qty"))
    evaluations = t.lineitem.groupBy(F.col("l_orderkey").alias("question_id"), F.col("l_suppkey").alias("call_id")).agg(
        F.min("l_partkey").alias("topic_id"), (F.min("l_partkey") % 25).alias("part_id"))
    return joins.bank_star(
        bank, evaluations,
        t.supplier.select(F.col("s_suppkey").alias("call_id"), F.col("s_name").alias("call")),
        t.nation.select(F.col("n_nationkey").alias("part_id"), F.col("n_name").alias("part")),
        t.part.select(F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("topic")),
        t.orders.filter("o_orderstatus <> 'F'").select(
            F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("exam_id"),
            F.col("o_orderstatus").alias("question_state")),
        t.customer.select(F.col("c_custkey").alias("exam_id"), F.col("c_name").alias("exam")),
    ).select("question_id", "call_id", "qty", "call", "part", "topic", "question_state", "exam")


@query("topic_documents_join", """
SELECT n_nationkey, s_suppkey, l_returnflag, COUNT(*) AS fragments, SUM(CAST(l_quantity AS BIGINT))::BIGINT AS chars FROM nation JOIN supplier ON s_nationkey = n_nationkey
JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""")
def topic_documents_join(t):
    bridge = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", "s_suppkey")
    parts = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag").agg(
        F.count(F.lit(1)).alias("fragments"), F.sum(F.col("l_quantity").cast("long")).alias("chars"))
    return bridge.join(parts, "s_suppkey").select("n_nationkey", "s_suppkey", "l_returnflag", "fragments", "chars")


@query("topic_fragments", """
SELECT n_nationkey, s_suppkey, l_orderkey, l_linenumber, l_partkey,
  row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey, l_orderkey, l_linenumber, l_partkey) AS place
FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey""")
def topic_fragments(t):
    """Every fragment of a topic (nation) in the order of its documents (suppliers)."""
    bridge = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    parts = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_linenumber", "l_partkey")
    return joins.topic_fragments(
        bridge, parts, "n_nationkey", "s_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"])


DIM_SQL = """parts AS (SELECT DISTINCT c_nationkey AS call, c_mktsegment AS part, c_nationkey * 10 + length(c_mktsegment) % 6 AS part_id FROM customer WHERE c_mktsegment <> 'MACHINERY'),
topics AS (SELECT s_nationkey AS call, s_nationkey * 10 + s_suppkey % 6 AS part_id, CAST(s_suppkey % 10 AS INTEGER) AS number, MIN(s_suppkey) AS topic_id FROM supplier GROUP BY ALL)"""


def dimensions(t):
    """parts (call, part, part_id) and topics (call, part_id, number, topic_id)."""
    parts = t.customer.filter("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_nationkey").alias("call"), F.col("c_mktsegment").alias("part"),
        (F.col("c_nationkey") * 10 + F.length("c_mktsegment") % 6).cast("long").alias("part_id")).distinct()
    topics = t.supplier.groupBy(
        F.col("s_nationkey").alias("call"),
        (F.col("s_nationkey") * 10 + F.col("s_suppkey") % 6).alias("part_id"),
        (F.col("s_suppkey") % 10).cast("int").alias("number")).agg(F.min("s_suppkey").alias("topic_id"))
    return parts, topics


@query("dimension_lookup", f"""
WITH {DIM_SQL} SELECT c_custkey, CAST(parts.part_id AS BIGINT) AS part_id, topic_id FROM customer LEFT JOIN parts ON call = c_nationkey AND part = c_mktsegment
LEFT JOIN topics ON topics.call = c_nationkey AND topics.part_id = parts.part_id AND number = c_custkey % 10""")
def dimension_lookup(t):
    parts, topics = dimensions(t)
    rows = t.customer.select(
        "c_custkey", F.col("c_nationkey").alias("call"), F.col("c_mktsegment").alias("part"),
        (F.col("c_custkey") % 10).cast("int").alias("number"))
    return joins.lookup_part_topic(rows, parts, topics).select("c_custkey", "part_id", "topic_id")


@query("unique_match_join", """
WITH ti AS (SELECT p_size, p_name, p_partkey AS title_id FROM part WHERE p_type = 'STANDARD')
SELECT p.p_partkey, COUNT(title_id) AS n_matches, CASE WHEN COUNT(title_id) = 1 THEN MIN(title_id) END AS title_id
FROM part p LEFT JOIN ti USING (p_size, p_name) GROUP BY p.p_partkey""")
def unique_match_join(t):
    titles = t.part.filter("p_type = 'STANDARD'").select(
        "p_size", F.upper(F.concat(F.lit("¿"), F.replace("p_name", F.lit(" "), F.lit("  - ")))).alias("p_name"),
        F.col("p_partkey").alias("title_id"))
    return joins.unique_match(t.part, titles, ["p_partkey"], number="p_size", title="p_name", match_id="title_id")


@query("anti_join_used", """
SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def anti_join_used(t):
    used = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey", "p_name").join(used, "p_partkey", "left_anti")


CACHE_SQL = """it AS (SELECT p_partkey, md5(p_name || p_brand) AS fp, CASE WHEN p_size > 25 THEN p_size END AS fragment_id, CASE WHEN p_type <> 'PROMO' THEN p_type END AS justification FROM part),
cache AS (SELECT md5(p_name || p_brand) AS fp, 'b' || MIN(p_partkey) AS short, 'e' || MAX(p_partkey) AS long FROM part WHERE p_type = 'STANDARD' GROUP BY 1)"""


def explained_items(t):
    return t.part.select(
        "p_partkey", F.md5(F.concat("p_name", "p_brand")).alias("fp"),
        F.when(F.col("p_size") > 25, F.col("p_size")).alias("fragment_id"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("justification"))


def explanation_cache(t):
    return t.part.filter("p_type = 'STANDARD'").groupBy(F.md5(F.concat("p_name", "p_brand")).alias("fp")).agg(
        F.concat(F.lit("b"), F.min("p_partkey").cast("string")).alias("short"),
        F.concat(F.lit("e"), F.max("p_partkey").cast("string")).alias("long"))


EXPLAIN_SQL = """SELECT p_partkey, it.fp, CASE WHEN cache.fp IS NOT NULL THEN 'reused' WHEN fragment_id IS NOT NULL THEN 'needed' ELSE 'placeholder' END AS source,
  CASE WHEN cache.fp IS NOT NULL THEN short WHEN fragment_id IS NULL THEN coalesce(justification, 'Explicación pendiente.') END AS short,
  CASE WHEN cache.fp IS NOT NULL THEN long WHEN fragment_id IS NULL THEN '' END AS long FROM it LEFT JOIN cache USING (fp)"""


@query("cache_lookup", f"WITH {CACHE_SQL} {EXPLAIN_SQL}")
def cache_lookup(t):
    return joins.cached_explanations(
        explained_items(t), explanation_cache(t), "fp", fragment="fragment_id", fallback="justification"
    ).select("p_partkey", "fp", "source", "short", "long")


@query("title_lookup", """
SELECT l_orderkey, l_linenumber, l_partkey, p_name AS title FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_type <> 'PROMO') p ON p_partkey = l_partkey""")
def title_lookup(t):
    titles = t.part.filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(titles, "l_partkey", "left")
