"""Grading, error reports, profiles and counters."""

from pyspark.sql import functions as F

from corpusbank.functions import features
from corpusbank.operators import grading
from corpusbank.operators.context import fixed_batches as batches
from corpusbank.plans.bank import grade_report
from corpusbank.queries.registry import query
from corpusbank.queries.text import FLAG_ARGS, FLAG_SQL

# answered items: one per order line, the supplier is the attempt
ANSWERED_SQL = """li AS (SELECT l_orderkey * 10 + l_linenumber AS number, MIN(l_suppkey) AS attempt, MIN(l_partkey) AS pk, MIN(l_quantity) AS q, MIN(l_returnflag) AS rf FROM lineitem GROUP BY l_orderkey, l_linenumber),
ans AS (SELECT number, attempt, 'T' || pk % 12 AS topic, CASE WHEN pk % 5 = 0 THEN ' ' ELSE 'N' || pk % 7 END AS norm, CASE WHEN pk % 3 = 0 THEN NULL ELSE CAST(pk % 4 AS VARCHAR) END AS article,
  CASE WHEN q > 45 THEN 'En blanco' WHEN q > 30 THEN 'B' ELSE 'A' END AS answer, CASE rf WHEN 'R' THEN 'B' ELSE 'A' END AS key FROM li),
answered AS (SELECT *, CASE WHEN answer = 'En blanco' THEN 'blank' WHEN answer = key THEN 'hit' ELSE 'error' END AS outcome FROM ans)"""
COUNT_SQL = """COUNT(*) AS total, COUNT(*) FILTER (outcome = 'hit') AS hits, COUNT(*) FILTER (outcome = 'error') AS errors, COUNT(*) FILTER (outcome = 'blank') AS blanks"""


def answered(t):
    """(number, attempt, topic, norm, article, answer, key, outcome)."""
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("attempt"), F.min("l_partkey").alias("pk"),
        F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("rf"))
    pk = F.col("pk")
    rows = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number"), "attempt",
        F.concat(F.lit("T"), (pk % 12).cast("string")).alias("topic"),
        F.when(pk % 5 == 0, " ").otherwise(F.concat(F.lit("N"), (pk % 7).cast("string"))).alias("norm"),
        F.when(pk % 3 != 0, (pk % 4).cast("string")).alias("article"),
        F.when(F.col("q") > 45, "En blanco").when(F.col("q") > 30, "B").otherwise("A").alias("answer"),
        F.when(F.col("rf") == "R", "B").otherwise("A").alias("key"))
    return rows.withColumn("outcome", grading.outcome(F.col("answer"), F.col("key")))


@query("grade", f"""
WITH {ANSWERED_SQL}, g AS (SELECT attempt, {COUNT_SQL} FROM answered GROUP BY attempt)
SELECT *, round(greatest(0.0::DOUBLE, (hits - errors / 3) / total * 10), 6) AS mark FROM g""")
def grade(t):
    return grading.grade(answered(t), ["attempt"]).withColumn("mark", F.round("mark", 6))


@query("outcome_by_topic", f"""
WITH {ANSWERED_SQL} SELECT attempt, topic, {COUNT_SQL} FROM answered GROUP BY attempt, topic""")
def outcome_by_topic(t):
    return grading.outcome_by(answered(t), ["attempt", "topic"])


ERROR_SQL = """bad AS (SELECT attempt, number, unnest(['topic', 'norm', 'reference']) AS dimension,
  unnest([nullif(trim(topic), ''), nullif(trim(norm), ''), CASE WHEN trim(norm) <> '' AND article IS NOT NULL THEN norm || ' · ' || article END]) AS key FROM answered WHERE outcome <> 'hit'),
cnt AS (SELECT attempt, dimension, key, COUNT(*) AS n, MIN(number) AS first_seen FROM bad WHERE key IS NOT NULL GROUP BY ALL),
top AS (SELECT attempt, dimension, key, n, CAST(row_number() OVER (PARTITION BY attempt, dimension ORDER BY n DESC, first_seen) AS INTEGER) AS rank FROM cnt QUALIFY rank <= 8)"""


@query("error_topk", f"WITH {ANSWERED_SQL}, {ERROR_SQL} SELECT * FROM top")
def error_topk(t):
    return grading.error_topk(answered(t), ["attempt"], topic="topic", norm="norm",
                              article="article", number="number")


EXAMPLE_SQL = """err AS (SELECT attempt, number, topic, trim(norm) AS norm, row_number() OVER (PARTITION BY attempt, topic, trim(norm) ORDER BY number) > 1 AS again,
  COUNT(*) OVER (PARTITION BY attempt) AS total FROM answered WHERE outcome <> 'hit'),
ex AS (SELECT attempt, number, topic, norm, CAST(row_number() OVER (PARTITION BY attempt ORDER BY again, number) AS INTEGER) AS place, total FROM err
  QUALIFY place <= CASE WHEN total <= 10 THEN total WHEN total <= 25 THEN 12 ELSE 15 END)"""


@query("representative_selection", f"""
WITH {ANSWERED_SQL}, {EXAMPLE_SQL} SELECT attempt, number, topic, norm, place FROM ex""")
def representative_selection(t):
    return grading.representatives(answered(t), ["attempt"], topic="topic", norm="norm", number="number")


@query("grade_and_report", f"""
WITH {ANSWERED_SQL}, {ERROR_SQL}, {EXAMPLE_SQL}, g AS (SELECT attempt, {COUNT_SQL} FROM answered GROUP BY attempt)
SELECT attempt, round(greatest(0.0::DOUBLE, (hits - errors / 3) / total * 10), 6) AS mark, worst_topic, n_worst, examples FROM g
LEFT JOIN (SELECT attempt, key AS worst_topic, n AS n_worst FROM top WHERE dimension = 'topic' AND rank = 1) USING (attempt)
LEFT JOIN (SELECT attempt, COUNT(*) AS examples FROM ex GROUP BY attempt) USING (attempt)""")
def grade_and_report(t):
    report = grade_report(answered(t), ["attempt"], topic="topic", norm="norm", article="article", number="number")
    worst = report["errors"].filter("dimension = 'topic' AND rank = 1").select(
        "attempt", F.col("key").alias("worst_topic"), F.col("n").alias("n_worst"))
    examples = report["examples"].groupBy("attempt").agg(F.count(F.lit(1)).alias("examples"))
    return report["marks"].select("attempt", F.round("mark", 6).alias("mark")).join(
        worst, "attempt", "left").join(examples, "attempt", "left")


_FLAGS = [f"opens_{i:02d}" for i in range(4)] + [
    "person", "organ", "action", "date", "amount", "subject_action", "action_datum"]


@query("feature_profile", f"""
WITH {FLAG_SQL}, g AS (SELECT *, action AND (person OR organ) AS subject_action, action AND (date OR amount) AS action_datum FROM f JOIN labels USING (doc_id)),
u AS (SELECT quality, feature, AVG(CAST(v AS DOUBLE)) * 100 AS pct FROM (SELECT quality, unnest({_FLAGS}) AS feature, unnest([{', '.join(f'CAST({x} AS INTEGER)' for x in _FLAGS)}]) AS v FROM g) GROUP BY ALL),
l AS (SELECT quality, AVG(length(text)) AS m FROM documents JOIN labels USING (doc_id) GROUP BY quality)
SELECT feature, round(MAX(pct) FILTER (quality = 1), 6) AS pct_a, round(MAX(pct) FILTER (quality = 0), 6) AS pct_b,
  round(MAX(pct) FILTER (quality = 1) - MAX(pct) FILTER (quality = 0), 6) AS difference,
  round((SELECT m FROM l WHERE quality = 1) - (SELECT m FROM l WHERE quality = 0), 6) AS length_difference FROM u GROUP BY feature""")
def feature_profile(t):
    items = t.documents.join(t.labels, "doc_id")
    flags = features.phrase_flags(F.col("text"), **FLAG_ARGS)
    profile = grading.feature_profile(items, "quality", flags, (1, 0))
    lengths = grading.length_profile(items, "quality", "text")
    difference = lengths.agg(
        F.max(F.when(F.col("quality") == 1, F.col("avg_len")))
        - F.max(F.when(F.col("quality") == 0, F.col("avg_len")))).scalar()
    return profile.select(
        "feature", *[F.round(c, 6).alias(c) for c in ("pct_a", "pct_b", "difference")],
        F.round(difference, 6).alias("length_difference"))


@query("length_profile", """
SELECT quality, COUNT(*) AS items, round(AVG(length(text)), 6) AS avg_len, MIN(length(text))::INTEGER AS min_len, MAX(length(text))::INTEGER AS max_len
FROM documents JOIN labels USING (doc_id) GROUP BY quality""")
def length_profile(t):
    lengths = grading.length_profile(t.documents.join(t.labels, "doc_id"), "quality", "text")
    return lengths.withColumn("avg_len", F.round("avg_len", 6))


@query("feature_examples", f"""
WITH {FLAG_SQL} SELECT quality, feature, doc_id FROM (SELECT quality, doc_id, unnest({_FLAGS[:-2]}) AS feature,
  unnest([{', '.join(_FLAGS[:-2])}]) AS v FROM f JOIN labels USING (doc_id)) WHERE v""")
def feature_examples(t):
    """The documents that show each feature."""
    flags = features.phrase_flags(F.col("text"), **FLAG_ARGS)
    own = {name: flags[name] for name in _FLAGS[:-2]}
    return grading.feature_examples(t.documents.join(t.labels, "doc_id"), "quality", "doc_id", own)


@query("counts_by_label", """
SELECT o_orderstatus AS state, o_orderpriority AS method, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())""")
def counts_by_label(t):
    state, method = F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("method")
    rows = t.orders.select(state, method)
    return rows.cube("state", "method").agg(F.count(F.lit(1)).alias("n"))


@query("batch_rollup", """
SELECT upper(split_part(o_orderpriority, '-', 1)) AS grp, COUNT(*) AS processed, COUNT(*) FILTER (o_orderstatus = 'F') AS imported, COUNT(*) FILTER (o_orderstatus = 'O') AS duplicates
FROM orders GROUP BY ROLLUP (1)""")
def batch_rollup(t):
    # one report per customer and group, then totals over all reports
    reports = t.orders.groupBy(
        "o_custkey", F.upper(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("grp")).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("o_orderstatus") == "F").alias("imported"),
        F.count_if(F.col("o_orderstatus") == "O").alias("duplicates"))
    return reports.rollup("grp").agg(*[F.sum(c).alias(c) for c in ("processed", "imported", "duplicates")])


@query("latest_row", """
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_row(t):
    return t.events.groupBy("user_id").agg(
        F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("r")
    ).select("user_id", "r.event_id", "r.event_type")


@query("ordered_limit", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def ordered_limit(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(
        F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("fixed_batches", """
SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 20 AS BIGINT) AS batch FROM orders""")
def fixed_batches(t):
    return batches(t.orders.select("o_orderkey"), ["o_orderkey"])


