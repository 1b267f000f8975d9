"""Quotas, stratified draws and exams over the customers as a question bank.

Block = market segment, topic = nation; the model distribution comes from the orders; the
bank has no questions of the African nations, so their quotas have to be back-filled.
"""

import re

from pyspark.sql import functions as F

from corpusbank.operators import quota
from corpusbank.operators.ranking import hash_order
from corpusbank.plans import bank as plans
from corpusbank.queries.registry import query
from corpusbank.session import stage

TARGETS = [("AUTOMOBILE", 50), ("BUILDING", 15), ("FURNITURE", 15), ("HOUSEHOLD", 30), ("MACHINERY", 30)]
EXAM_SIZE = sum(n for _, n in TARGETS)
NO_BACKFILL = ("FURNITURE",)

COUNTS_SQL = """targets AS (SELECT * FROM (VALUES ('AUTOMOBILE', 50), ('BUILDING', 15), ('FURNITURE', 15), ('HOUSEHOLD', 30), ('MACHINERY', 30)) v(block, target)),
counts AS (SELECT c_mktsegment AS block, c_nationkey AS topic, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
tot AS (SELECT *, SUM(n) OVER (PARTITION BY block) AS total FROM counts JOIN targets USING (block)),
fl AS (SELECT *, CAST(n * target // total AS BIGINT) AS f, (n * target) % total AS rest FROM tot),
quotas AS (SELECT block, topic, n, CAST(f + CASE WHEN row_number() OVER (PARTITION BY block ORDER BY rest DESC, topic) <= target - SUM(f) OVER (PARTITION BY block) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM fl)"""
BANK_SQL = COUNTS_SQL + """,
bank AS (SELECT c_custkey AS item, c_mktsegment AS block, c_nationkey AS topic FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA'),
rk AS (SELECT bank.*, quota, CAST(row_number() OVER (PARTITION BY block, topic ORDER BY md5(CAST(item AS VARCHAR))) AS BIGINT) AS rn FROM bank JOIN quotas USING (block, topic)),
chosen AS (SELECT * FROM rk WHERE rn <= quota),
short AS (SELECT block, topic, quota, COUNT(item) AS obtained, greatest(0, quota - COUNT(item)) AS missing FROM quotas LEFT JOIN chosen USING (block, topic, quota) GROUP BY block, topic, quota),
deficit AS (SELECT block, SUM(missing) AS d FROM short WHERE block <> 'FURNITURE' GROUP BY block),
extra AS (SELECT item, block, topic FROM rk JOIN deficit USING (block) WHERE rn > quota
  QUALIFY row_number() OVER (PARTITION BY block ORDER BY rn - quota, md5(CAST(topic AS VARCHAR))) <= d),
drawn AS (SELECT item, block, topic, 'quota' AS origin FROM chosen UNION ALL SELECT item, block, topic, 'backfill' FROM extra),
exam AS (SELECT *, CAST(row_number() OVER (ORDER BY block, md5('s|' || item)) AS INTEGER) AS number FROM drawn)"""


def targets(t):
    return t.values(TARGETS, "block string, target int")


def model_counts(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_mktsegment").alias("block"), F.col("c_nationkey").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


def question_bank(t):
    nations = t.nation.join(t.region.filter("r_name <> 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("block"), F.col("c_nationkey").alias("topic"))


def quotas(t):
    return stage(quota.largest_remainder(model_counts(t), targets(t)), "quotas")


@query("distribution_count", """
SELECT c_mktsegment AS block, c_nationkey AS topic, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, c_nationkey)""")
def distribution_count(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).rollup(
        F.col("c_mktsegment").alias("block"), F.col("c_nationkey").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query("largest_remainder", f"WITH {COUNTS_SQL} SELECT block, topic, n, quota FROM quotas")
def largest_remainder(t):
    return quota.largest_remainder(model_counts(t), targets(t))


def sample(t, strata):
    return quota.stratified_sample(
        question_bank(t), strata, block="block", topic="topic", order=hash_order(F.col("item")))


@query("stratified_sample", f"WITH {BANK_SQL} SELECT item, block, topic, quota, CAST(rn AS INTEGER) AS rn FROM chosen")
def stratified_sample(t):
    return sample(t, quotas(t)).select("item", "block", "topic", "quota", "rn")


def drawn(t, strata=None):
    return quota.draw_with_backfill(
        question_bank(t), quotas(t) if strata is None else strata, block="block", topic="topic",
        order=hash_order(F.col("item")), topic_order=hash_order(F.col("topic")),
        no_backfill=NO_BACKFILL)


@query("quota_backfill", f"WITH {BANK_SQL} SELECT * FROM drawn")
def quota_backfill(t):
    return drawn(t).select("item", "block", "topic", "origin")


@query("block_shuffle_number", f"WITH {BANK_SQL} SELECT item, block, number FROM exam")
def block_shuffle_number(t):
    return quota.number_items(
        drawn(t), [], F.col("block"), F.md5(F.concat(F.lit("s|"), F.col("item").cast("string")))
    ).select("item", "block", "number")


def built_exam(t):
    return plans.build_exam(
        question_bank(t), model_counts(t), targets(t), order=hash_order(F.col("item")),
        topic_order=hash_order(F.col("topic")), block_position=F.col("block"),
        shuffle=F.md5(F.concat(F.lit("s|"), F.col("item").cast("string"))), no_backfill=NO_BACKFILL)


@query("build_exam", f"WITH {BANK_SQL} SELECT item, block, topic, origin, number FROM exam")
def build_exam(t):
    return built_exam(t).select("item", "block", "topic", "origin", "number")


def exams_sql(exams: int, used: str) -> str:
    """CTEs ``exam1`` .. of exams drawn one after another, without items met before."""
    bank = BANK_SQL[:BANK_SQL.index("rk AS (")]
    draw = BANK_SQL[BANK_SQL.index("rk AS ("):]
    out = bank
    for n in range(1, exams + 1):
        gone = " UNION ALL ".join([used, *[f"SELECT item FROM exam{k}" for k in range(1, n)]])
        one = draw.replace("FROM bank JOIN", f"FROM (SELECT * FROM bank WHERE item NOT IN ({gone})) bank JOIN")
        for name in ("rk", "chosen", "short", "deficit", "extra", "drawn", "exam"):
            one = re.sub(rf"\b{name}\b", f"{name}{n}", one)
        out += one + ", " * (n < exams)
    return out


# items of the customers in debt are used up before
_USED_SQL = "SELECT c_custkey AS item FROM customer WHERE c_acctbal < 0"


@query("build_exams", f"WITH {exams_sql(3, _USED_SQL)} " + " UNION ALL ".join(
    f"SELECT {n} AS exam, item, block, topic, origin, number FROM exam{n}" for n in (1, 2, 3)))
def build_exams(t):
    return plans.build_exams(
        question_bank(t), model_counts(t), targets(t), 3,
        used=t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("item")),
        order=hash_order(F.col("item")), topic_order=hash_order(F.col("topic")),
        block_position=F.col("block"), shuffle=F.md5(F.concat(F.lit("s|"), F.col("item").cast("string"))),
        no_backfill=NO_BACKFILL).select("exam", "item", "block", "topic", "origin", "number")


@query("block_shortfall", f"""
WITH {BANK_SQL}, g AS (SELECT block, target, COUNT(item) AS obtained, greatest(0, target - COUNT(item)) AS missing FROM targets LEFT JOIN drawn USING (block) GROUP BY block, target)
SELECT block, target, obtained, missing, (SELECT bool_and(missing = 0) FROM g) AS complete FROM g""")
def block_shortfall(t):
    return quota.block_summary(drawn(t), targets(t))


@query("total_check", f"""
WITH {BANK_SQL}, g AS (SELECT block, COUNT(*) AS obtained FROM chosen GROUP BY block)
SELECT block, coalesce(target, 0) AS target, coalesce(obtained, 0) AS obtained, coalesce(target = obtained, false) AS ok FROM targets FULL JOIN g USING (block)""")
def total_check(t):
    return quota.total_check(sample(t, quotas(t)), targets(t))


@query("union_extras", f"""
WITH {BANK_SQL}, more AS (SELECT item, block, topic FROM drawn UNION SELECT c_custkey, c_mktsegment, c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 495000)
SELECT item, block, topic FROM more""")
def union_extras(t):
    extras = t.customer.join(t.orders.filter("o_totalprice > 495000"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("block"), F.col("c_nationkey").alias("topic"))
    both = drawn(t).select("item", "block", "topic", F.lit(0).alias("origin")).unionByName(
        extras.withColumn("origin", F.lit(1)))
    return both.groupBy("item", "block", "topic").agg(F.min("origin").alias("origin")).drop("origin")


GAP_SQL = BANK_SQL + """,
gap AS (SELECT block, topic, missing FROM short WHERE block = 'FURNITURE' AND missing > 0),
gen AS (SELECT block, topic, -1 - s_suppkey AS item, s_acctbal >= 0 OR s_suppkey % 3 = 0 AS ok FROM gap JOIN supplier ON s_nationkey = topic),
fill AS (SELECT block, topic, item FROM gen WHERE ok AND (block, topic) IN (SELECT (block, topic) FROM gap JOIN gen g2 USING (block, topic) WHERE g2.ok GROUP BY block, topic, missing HAVING COUNT(*) = missing)),
alls AS (SELECT block, topic, item, false AS needs_review FROM drawn UNION ALL SELECT block, topic, item, true FROM fill)"""


@query("exam_gap_fill", f"""
WITH {GAP_SQL} SELECT block, topic, item, needs_review, CAST(row_number() OVER (ORDER BY block, md5('s|' || item)) AS INTEGER) AS number FROM alls""")
def exam_gap_fill(t):
    strata = quotas(t)
    exam = stage(drawn(t, strata), "exam")
    gaps = quota.shortfalls(exam.filter("origin = 'quota'"), strata, "block", "topic").filter(
        "block = 'FURNITURE' AND missing > 0")
    # generated items: one per supplier of the nation, some of them without an option
    abcd = F.create_map(*[F.lit(x) for x in ("A", "1", "B", "2", "C", "3", "D", "4")])
    ok = (F.col("s_acctbal") >= 0) | (F.col("s_suppkey") % 3 == 0)
    generated = t.supplier.select(
        F.lit("FURNITURE").alias("block"), F.col("s_nationkey").alias("topic"),
        (F.lit(-1) - F.col("s_suppkey")).alias("item"),
        F.when(ok, abcd).otherwise(F.create_map(F.lit("A"), F.lit("1"))).alias("options"), F.lit("b").alias("answer"))
    return plans.fill_gaps(
        exam, generated, gaps, block_position=F.col("block"),
        order=F.md5(F.concat(F.lit("s|"), F.col("item").cast("string")))
    ).select("block", "topic", "item", "needs_review", "number")


