"""Operators against loops, brute force and the cases of the domain."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusbank.functions.text import tokens
from corpusbank.operators import coverage as cov
from corpusbank.operators import dedup, grading, maintenance, quota, ranking, search, segment, verdicts
from corpusbank.operators.context import context_budget
from corpusbank.plans import classify


def test_bm25_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["la", "de"]
    docs = [(i, "p" if i % 3 else "q", " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(60)]
    docs[7] = (7, "p", docs[8][2])  # a copy: equal scores keep id order
    queries = [(i, "p" if i % 2 else "zz", " ".join(rng.choices(words, k=5))) for i in range(8)]
    d = spark.createDataFrame(docs, "doc long, part string, text string")
    q = spark.createDataFrame(queries, "q long, part string, text string")
    toks = {r["doc"]: r["t"] for r in d.select("doc", tokens(F.col("text")).alias("t")).collect()}

    def brute(query, pool):
        n, avg = len(pool), sum(len(toks[i]) for i in pool) / max(len(pool), 1)
        df = Counter(w for i in pool for w in set(toks[i]))
        out = []
        for i in pool:
            tf = Counter(toks[i])
            s = sum(
                math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * tf[w] * 2.5
                / (tf[w] + 1.5 * (.25 + .75 * len(toks[i]) / max(avg, 1)))
                for w in set(query.split()) - {"la", "de"} if tf[w])
            if s > 0:
                out.append((-round(s, 6), i))
        return [i for _, i in sorted(out)[:5]]

    for part, prune, block in [(None, True, 10**6), (["part"], True, 10**6), (None, False, 10**6),
                               (None, True, 7), (["part"], False, 7)]:
        got = search.bm25_topk(d, q, doc_id="doc", text="text", query_id="q", query_text="text",
                               part=part, prune=prune, block=block)
        ranks = {}
        for r in got.orderBy("q", "rank").collect():
            ranks.setdefault(r["q"], []).append(r["doc"])
        for qid, p, text in queries:
            pool = [i for i, dp, _ in docs if part is None or dp == p]
            assert ranks.get(qid, []) == brute(text, pool)


def ranked(spark, folder, prune):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return search.bm25_topk(docs, items, doc_id="doc_id", text="text", query_id="item_id",
                            query_text="text", prune=prune)


def test_bm25_pruning_leaves_the_rows(spark):
    folder = "/root/testdata/sf0.001"
    with_bounds = {tuple(r) for r in ranked(spark, folder, True).collect()}
    assert with_bounds == {tuple(r) for r in ranked(spark, folder, False).collect()}
    assert len(with_bounds) > 100


def test_bm25_prunes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    terms = search.query_terms(items, "item_id", "text")
    posts = search.block_postings(search.document_terms(docs, "doc_id", "text"), terms, "doc_id")
    weights = search.query_weights(posts, terms)
    none = weights.select("item_id").distinct().withColumn("threshold", F.lit(None).cast("double"))
    pairs = []
    for least in (none, search.score_thresholds(posts, weights, "doc_id", "item_id", 5)):
        marked = search.essential_tokens(weights, least, "item_id")
        pairs.append(search.bm25_scores(posts, marked, "doc_id", "item_id").count())
    assert pairs[1] < pairs[0] / 2


def test_bm25_exchanges(spark):
    plan = ranked(spark, "/root/testdata/sf0.001", True)._jdf.queryExecution().toString()
    plan = plan[plan.index("Physical Plan"):]
    assert plan.count("Exchange hashpartitioning(item_id") == 1
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning(item_id")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line]
    assert dealt and all("REPARTITION_BY_COL" in line for line in dealt)


def test_row_numbers_and_sums(spark):
    rng = random.Random(1)
    rows = [(("hot" if rng.random() < .5 else "cold"), i, rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = ranking.range_numbers(df, ["g"], ["i"])
    sums = ranking.range_running_sum(df, ["g"], ["i"], "v")
    rn, total = Counter(), Counter()
    want_rn, want_sum = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        rn[g] += 1
        total[g] += v
        want_rn[i], want_sum[i] = rn[g], total[g]
    assert {r["i"]: r["rn"] for r in got.collect()} == want_rn
    assert {r["i"]: r["running"] for r in sums.collect()} == want_sum
    hashed = df.withColumn("h", ranking.hash_order(F.col("i")))
    everything = ranking.range_numbers(hashed, [], ["h"]).orderBy("rn").collect()
    assert [r["rn"] for r in everything] == list(range(1, 501))
    assert [r["h"] for r in everything] == sorted(r["h"] for r in everything)


def test_range_numbers(spark):
    rows = [(("a" if i % 3 else None) if i % 2 else "hot", (i * 7919) % 501) for i in range(501)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(7)
    got = ranking.range_numbers(df, ["g"], ["i"]).collect()
    seen = Counter()
    for g, i in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        seen[g] += 1
        assert (g, i, seen[g]) in {(r.g, r.i, r.rn) for r in got if r.i == i}
    whole = ranking.range_numbers(df.select("i"), [], ["i"], "n").orderBy("n").collect()
    assert [(r.i, r.n) for r in whole] == [(i, i + 1) for i in range(501)]


def test_cluster_needs_a_shared_folder(spark):
    from corpusbank.session import local_master

    assert local_master("local[4]") and local_master("local")
    assert not any(map(local_master, ("local-cluster[3,2,1000]", "yarn", "spark://host:7077")))


def test_largest_remainder_property(spark):
    rng = random.Random(5)
    counts, targets = [], []
    for b in range(40):
        targets.append((f"b{b}", rng.randint(1, 60)))
        counts += [(f"b{b}", k, rng.randint(1, 30)) for k in range(rng.randint(1, 12))]
    got = quota.largest_remainder(
        spark.createDataFrame(counts, "block string, topic int, n long"),
        spark.createDataFrame(targets, "block string, target long"))
    quotas = {(r["block"], r["topic"]): r["quota"] for r in got.collect()}
    for b, target in targets:
        own = [(k, n) for bb, k, n in counts if bb == b]
        total = sum(n for _, n in own)
        want = {k: n * target // total for k, n in own}
        left = target - sum(want.values())
        for k, n in sorted(own, key=lambda x: (-(x[1] * target % total), x[0]))[:left]:
            want[k] += 1
        assert {k: quotas[(b, k)] for k, _ in own} == want and sum(want.values()) == target


def test_backfill_matches_loop(spark):
    rng = random.Random(9)
    bank, quotas = [], []
    item = 0
    for b in range(25):
        for k in range(rng.randint(1, 5)):
            quotas.append((f"b{b}", k, rng.randint(0, 6)))
            for _ in range(rng.randint(0, 8)):
                bank.append((f"b{b}", k, item))
                item += 1
    got = quota.draw_with_backfill(
        spark.createDataFrame(bank, "block string, topic int, item long"),
        spark.createDataFrame(quotas, "block string, topic int, quota long"), block="block", topic="topic",
        order=F.col("item"), topic_order=F.col("topic"), no_backfill=("b3",))
    chosen = {r["item"]: r["origin"] for r in got.collect()}
    want = {}
    for b in {q[0] for q in quotas}:
        strata = {k: [i for bb, kk, i in bank if (bb, kk) == (b, k)] for bb, k, _ in quotas if bb == b}
        missing = 0
        for bb, k, n in quotas:
            if bb == b:
                taken, strata[k] = strata[k][:n], strata[k][n:]
                want.update({i: "quota" for i in taken})
                missing += n - len(taken)
        while b != "b3" and missing and any(strata.values()):
            for k in sorted(strata):
                if missing and strata[k]:
                    want[strata[k].pop(0)] = "backfill"
                    missing -= 1
    assert chosen == want


def test_representatives_match_loop(spark):
    rng = random.Random(2)
    rows = []
    for a in range(30):
        for n in range(rng.choice([3, 10, 11, 25, 26, 60])):
            rows.append((a, n, f"t{rng.randint(0, 6)}", f"n{rng.randint(0, 2)}", rng.choice(["hit", "error", "blank"])))
    got = grading.representatives(
        spark.createDataFrame(rows, "a int, n long, topic string, norm string, outcome string"), ["a"],
        topic="topic", norm="norm", number="n")
    out = {}
    for r in got.orderBy("a", "place").collect():
        out.setdefault(r["a"], []).append(r["n"])
    for a in range(30):
        wrong = [r for r in rows if r[0] == a and r[4] != "hit"]
        limit = len(wrong) if len(wrong) <= 10 else 12 if len(wrong) <= 25 else 15
        seen, picked = set(), []
        for r in wrong:
            if (r[2], r[3]) not in seen and len(picked) < limit:
                seen.add((r[2], r[3]))
                picked.append(r[1])
        picked += [r[1] for r in wrong if r[1] not in picked][:limit - len(picked)]
        assert out.get(a, []) == picked


def test_fragments(spark):
    long = "\n".join(f"{i}. " + "x" * 120 for i in range(1, 4))
    letters = "9. intro\na) " + "y" * 200 + "\nb) " + "z" * 200
    doc = f"PREÁMBULO\n\n  Artículo 1. Uno\nArtículo 2 bis. Dos\n{long}\n{letters}\nArtículo 1. Uno\n"
    rows = segment.explode_fragments(
        spark.createDataFrame([(1, doc), (2, "sin artículos")], "k int, t string"), ["k"], "t", limit=150).collect()
    got = [(r["ord"], r["kind"], r["reference"], r["article"], r["section"]) for r in sorted(rows, key=lambda r: r["ord"])]
    assert got == [
        (1, "ARTICULO", "Artículo 1", "1", None),
        (2, "APARTADO", "Artículo 2 bis, bloque 1", "2 bis", "1"),
        (3, "APARTADO", "Artículo 2 bis, bloque 2", "2 bis", "2"),
        (4, "APARTADO", "Artículo 2 bis, bloque 3", "2 bis", "3"),
        (5, "APARTADO", "Artículo 2 bis, bloque 4", "2 bis", "4"),
        (6, "LETRA", "Artículo 2 bis, bloque 5.1", "2 bis", "5.1"),
        (7, "LETRA", "Artículo 2 bis, bloque 5.2", "2 bis", "5.2"),
        (8, "LETRA", "Artículo 2 bis, bloque 5.3", "2 bis", "5.3"),
    ]


def test_questions_and_options(spark):
    sheet = "Título\n1 ¿Qué es?\na) uno\nb) dos\nc) tres\nd) cuatro\n\n2Otra\na) x\n"
    row = spark.createDataFrame([(sheet,)], "t string").select(
        segment.questions(F.col("t")).alias("q"), segment.marked_questions(F.lit(
            "• Pregunta 1: Hola\na) s\n2. ¿Eh?\nPREGUNTA: fin")).alias("m")).first()
    assert [(q["number"], q["text"].split("\n")[0]) for q in row["q"]] == [(1, "¿Qué es?"), (2, "Otra")]
    assert [m.split("\n")[0] for m in row["m"]] == ["Hola", "¿Eh?", "fin"]
    block = spark.createDataFrame([(row["q"][0]["text"],), (row["q"][1]["text"],)], "t string")
    good, bad = block.select(segment.parse_options(F.col("t")).alias("p")).collect()
    assert good["p"]["stem"] == "¿Qué es?" and good["p"]["options"] == {"A": "uno", "B": "dos", "C": "tres", "D": "cuatro"}
    assert bad["p"]["reason"].startswith("No se detectaron")


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("more", [0, 257, 10_000])
def test_contained_codes(spark, whole, more):
    """Repeated and null keys, repeated texts; the size of the catalogue changes nothing."""
    texts = spark.createDataFrame(
        [(1, "La Ley 39/2015, de procedimiento"), (2, "procedimiento sin nada"), (3, "CE y TUE"), (4, ""),
         (5, "constitución española y la ley 39/2015"), (6, None), (7, "alfa"), (7, "beta"), (None, "alfa")],
        "k int, t string")
    aliases = [("L", "ley 39/2015"), ("CE", "ce"), ("CE", "Constitución Española"), ("TUE", "tue"),
               ("P", "procedimiento"), ("A", "alfa"), ("B", "beta")]
    aliases += [(f"X{i}", f"zzz{i} qqq") for i in range(more)]
    got = [(r["k"], r["t"], r["codes"]) for r in cov.contained_codes(
        texts, "t", spark.createDataFrame(aliases, "code string, alias string"), whole_words=whole).collect()]
    by_text = {t: c for _, t, c in got}
    assert len(got) == 9 and by_text["La Ley 39/2015, de procedimiento"] == (["L", "P"] if whole else ["CE", "L", "P"])
    assert by_text[""] == by_text[None] == [] and by_text["CE y TUE"] == ["CE", "TUE"]
    assert sorted((k or 0, c) for k, t, c in got if t in ("alfa", "beta")) == [(0, ["A"]), (7, ["A"]), (7, ["B"])]


def test_contained_codes_moves_no_text(spark):
    texts = spark.range(0, 3000, 1, 6).select(F.col("id").alias("k"), F.concat(
        F.lit("caliente "), F.when(F.col("id") % 3 == 0, "perro").otherwise("gato"),
        F.lit(" caliente "), F.col("id").cast("string")).alias("t"))
    aliases = spark.createDataFrame(
        [("H", "caliente"), ("P", "perro caliente"), ("N", "caliente 7"), ("Z", "caliente zorro")],
        "code string, alias string")
    anchors = {r.code: r.anchor for r in cov.alias_anchors(texts, "t", aliases, sample=1.0).collect()}
    assert anchors == {"H": "caliente", "P": "perro", "N": "7", "Z": "zorro"}  # the hot word only alone
    for block in (1, 1000):
        found = cov.contained_codes(texts, "t", aliases, block=block).select("k", "codes")
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        moved = [plan[n + 1] for n, line in enumerate(plan) if " Exchange " in line]
        assert moved and not any(" t#" in line or "[t#" in line for line in moved)
        got = {r.k: r.codes for r in found.collect()}
        assert len(got) == 3000 and got[0] == ["H", "P"] and got[7] == ["H", "N"]
        assert sum("P" in c for c in got.values()) == 1000 and all("H" in c for c in got.values())


def test_longest_prefix(spark):
    names = spark.createDataFrame(
        [(1, "Ley Orgánica 3_2018.pdf"), (2, "Ley 3_2018 articulos 1-2.pdf"), (3, "otro"), (3, "Ley x"), (None, "Ley x"), (4, None)],
        "k int, n string")
    catalogue = [("L", "Ley", 0), ("LO", "Ley Orgánica", 1), ("L3", "ley 3_2018", 2), ("L3b", "Ley 3 2018", 3), ("L3a", "Ley 3 2018", 3)]
    for more in (0, 257):
        entries = catalogue + [(f"Z{i}", f"zeta {i}", 9) for i in range(more)]
        got = cov.longest_prefix(names, "n", spark.createDataFrame(entries, "code string, prefix string, pos int"))
        assert sorted((r["k"] or 0, r["n"] or "", r["code"] or "") for r in got.collect()) == [
            (0, "Ley x", "L"), (1, "Ley Orgánica 3_2018.pdf", "LO"), (2, "Ley 3_2018 articulos 1-2.pdf", "L3"),
            (3, "Ley x", "L"), (3, "otro", ""), (4, "", "")]


def test_quota_above_any_default(spark):
    bank = spark.range(500).select(F.lit("b").alias("block"), F.lit(1).alias("topic"), F.col("id").alias("item"))
    quotas = spark.createDataFrame([("b", 1, 300)], "block string, topic int, quota long")
    got = quota.stratified_sample(bank, quotas, block="block", topic="topic", order=F.col("item"))
    assert got.count() == 300


def test_one_question_in_two_calls(spark):
    old = spark.createDataFrame([], "q int, call string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "q int, call string").withColumn("o", F.col("q"))
    got = maintenance.insert_ignore(old, new, ["q", "call"], "o").collect()
    assert sorted((r.q, r.call, r.status) for r in got) == [(1, "a", "inserted"), (1, "b", "inserted"), (2, "a", "inserted")]


def test_nulls_may_repeat_in_unique_keys(spark):
    rows = spark.createDataFrame([(None,), (None,), ("x",), ("x",)], "k string")
    assert [(r.key, r.n) for r in maintenance.unique_violations(rows, ["k"], "u").collect()] == [("x", 2)]


def test_repeated_letter_keeps_the_last(spark):
    from corpusbank.operators.joins import options_to_map

    rows = spark.createDataFrame([(1, "a", "z", 1), (1, "A ", "b", 2), (1, "b", "c", 3)], "k int, l string, t string, o int")
    r = options_to_map(rows, ["k"], "l", "t", "o").first()
    assert r.options == {"A": "b", "B": "c"} and r.repeated


def test_null_options_keep_their_place(spark):
    from corpusbank.functions.text import fingerprint

    rows = spark.createDataFrame([("s", None, "x"), ("s", "x", None)], "s string, a string, b string")
    assert rows.select(fingerprint(F.col("s"), F.col("a"), F.col("b")).alias("f")).distinct().count() == 2


def test_one_letter_is_no_subject(spark):
    from corpusbank.functions.features import practical_score

    rows = spark.createDataFrame([("y es asi",), ("ana es asi",)], "t string")
    assert [r[0] for r in rows.select(practical_score(F.col("t"), strict=True)).collect()] == [0, 2]


COVERAGE = [("Ley 39_2015 articulos 1-33.pdf", "L39_2015", "Especial-Teoría", 1), ("Ley 39_2015 articulos 34-52.pdf", "L39_2015", "Especial-Teoría", 2),
            ("Ley 1_2015 articulos 24-29.pdf", "L1_2015", "Especial-Teoría", 11), ("Decreto 77_2019.pdf", "D77_2019", "Especial-Teoría", 12),
            ("Ley 9_2003 articulos 1-4.pdf", "L9_2003", "General", 10), ("Ley 9_2003 articulos 4-5.pdf", "L9_2003", "General", 11)]
ALIASES = [("L39_2015", "ley 39/2015"), ("L1_2015", "ley 1/2015"), ("D77_2019", "decreto 77/2019"), ("L9_2003", "ley 9/2003"),
           ("CE", "constitucion española"), ("CE", "ce")]


@pytest.fixture(scope="module")
def rules(spark):
    table = cov.coverage_from_documents(spark.createDataFrame(COVERAGE, "document string, norm string, part string, topic int"))
    return spark.createDataFrame(ALIASES, "code string, alias string"), classify.coverage_index(table)


@pytest.mark.parametrize("include_full", [False, True])
def test_direct_cases(spark, rules, include_full):
    aliases, index = rules
    cases = [
        ("Según el artículo 52 de la Ley 39/2015...", "VALIDADA"), ("Según el artículo 200 de la Ley 39/2015...", "RECHAZADA"),
        ("Según la Ley 7/1985...", "RECHAZADA"), ("Según la Ley 39/2015...", "PENDIENTE"),
        ("¿Cuál de las siguientes afirmaciones es correcta?", "PENDIENTE"), ("Según el artículo 30 de la Ley 1/2015...", "RECHAZADA"),
        ("Según la Constitución Española y la Ley 39/2015, señale la respuesta correcta.", "RECHAZADA"),
        ("Artículo 4 de la Ley 9/2003", "A_REVISAR"), ("El artículo 3 del código civil", "RECHAZADA"),
        ("Artículo 8 del Decreto 77/2019", "VALIDADA" if include_full else "RECHAZADA")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "k int, t string")
    got = classify.classify_direct(df, aliases, index, key="k", text="t", include_full=include_full)
    assert {r["k"]: r["state"] for r in got.collect()} == {i: s for i, (_, s) in enumerate(cases)}


def test_footer_cases(spark, rules):
    aliases, index = rules
    cases = [(None, None, " ", "1", "A_REVISAR"), ("Ley 7/1985", None, "x", "1", "RECHAZADA"), ("Ley 39/2015 y Ley 1/2015", None, "x", "1", "A_REVISAR"),
             ("", "Ley 39/2015", "x", "040", "VALIDADA"), ("Ley 39/2015", None, "x", None, "A_REVISAR"), ("Ley 39/2015", None, "x", "anexo", "A_REVISAR"),
             ("Ley 39/2015", None, "x", "400", "RECHAZADA"), ("Ley 9/2003", None, "x", "4", "A_REVISAR"), (None, None, "Decreto 77/2019", "8", "VALIDADA")]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "k int, n string, f string, s string, a string")
    got = classify.validate_footers(df, aliases, index, key="k", norm="n", footer="f", stem="s", article="a")
    assert {r["k"]: r["state"] for r in got.collect()} == {i: c[4] for i, c in enumerate(cases)}


def test_verdict_cases(spark):
    cases = [('{"decision":"VALIDADA","fragmento_id":7,"confianza":0.98,"motivo":"x"}', "VALIDADA"), ('{"decision":"VALIDADA","fragmento_id":7,"confianza":0.80}', "A_REVISAR"),
             ('{"decision":"VALIDADA","fragmento_id":7,"confianza":0.30}', "RECHAZADA"), ('{"decision":"RECHAZADA","fragmento_id":null,"confianza":0.2}', "RECHAZADA"),
             ('{"decision":"VALIDADA","fragmento_id":999999999,"confianza":0.99}', "A_REVISAR"), ('{"decision":"ACEPTADA","fragmento_id":7,"confianza":0.99}', "A_REVISAR"),
             ('{"decision":"VALIDADA","fragmento_id":7,"confianza":"0.99"}', "A_REVISAR"), ('{"decision":"RECHAZADA","fragmento_id":7,"confianza":0.9}', "A_REVISAR"),
             ('{"decision":"VALIDADA","fragmento_id":"7","confianza":0.99}', "A_REVISAR"), ("no json", "A_REVISAR"), ('{"decision":"VALIDADA","fragmento_id":7,"confianza":1}', "VALIDADA")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "q int, v string")
    candidates = spark.createDataFrame([(i, f) for i in range(len(cases)) for f in (7, 8)], "q int, f long")
    got = verdicts.check_verdicts(df, candidates, question="q", text="v", candidate_id="f").collect()
    assert {r["q"]: r["state"] for r in got} == {i: s for i, (_, s) in enumerate(cases)}
    assert all((r["error"] is None) == (r["confidence"] is not None) for r in got)


def test_labels_identities(spark):
    rows = [(i, f"f{i % 4}", None if i % 9 == 0 else f"k{i % 13}", "e" if i % 9 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "pos long, batch string, fp string, error string")
    stored = spark.createDataFrame([("k1", 5), ("k2", 6)], "fp string, first_id long")
    labelled = dedup.label_import(df, stored, order="pos", key="fp", error="error", batch=["batch"])
    assert labelled.count() == 200
    summary = dedup.import_summary(labelled, ["batch"], F.when(F.col("pos") % 2 == 0, "VALIDADA").otherwise("A_REVISAR"))
    for r in summary.collect():
        assert r["processed"] == r["imported"] + r["errors"] + r["duplicates"]
        assert r["imported"] == r["validated"] + r["review"] + r["rejected"]


def test_context_budget(spark):
    docs = [("t", d, ["ab" * 40] * 3) for d in range(300)] + [("u", 1000, ["corto"]), ("u", 1001, [])]
    df = spark.createDataFrame(docs, "t string, d long, x array<string>")
    got = {r["t"]: r["context"] for r in context_budget(df, ["t"], "d", F.col("x"), budget=1000).collect()}
    assert got == {"t": "\n".join("ab" * 40 for _ in range(900))[:1000], "u": "corto"}


def test_upserts_and_guards(spark, tmp_path):
    old = spark.createDataFrame([(1, "P", "a"), (2, "V", "b")], "k int, state string, v string")
    new = spark.createDataFrame([(1, "P", "c", 1), (1, "P", "d", 2), (3, "P", "e", 1)], "k int, state string, v string, at int")
    merged = maintenance.upsert(old, new, ["k"], "at").select("k", "v").collect()
    assert {r["k"]: r["v"] for r in merged} == {1: "d", 2: "b", 3: "e"}
    updates = spark.createDataFrame([(1, "X", None), (2, "X", None)], "k int, state string, v string")
    guarded = maintenance.guarded_update(old, updates, "k", "state", "P", ["state", "v"]).collect()
    assert {r["k"]: (r["state"], r["v"], r["updated"]) for r in guarded} == {1: ("X", None, True), 2: ("V", "b", False)}
    path = str(tmp_path / "table")
    maintenance.replace_partitions(old, path, "k")
    maintenance.replace_partitions(spark.createDataFrame([(1, "N", "z")], "k int, state string, v string"), path, "k")
    assert {r["k"]: r["v"] for r in spark.read.parquet(path).collect()} == {1: "z", 2: "b"}


def test_hot_group_dedup(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert dedup.first_by_key(df, ["k"], "id").count() == 2001


def test_top_k_is_pruned_before_the_exchange(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = ranking.top_k(df, ["g"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_postings_of_long_runs(spark):
    text = " ".join(["uno"] * 30000 + ["unos", "un0", "uno1", "12", "123"] * 2)
    df = spark.createDataFrame([(1, text), (2, ""), (3, "de la"), (4, None)], "k int, t string")
    rows = {r["k"]: r for r in search.document_terms(df, "k", "t").collect()}
    got = {t["tok"]: t["tf"] for t in rows[1]["terms"]}
    assert got == {"uno": 30000, "unos": 2, "un0": 2, "uno1": 2, "12": 2, "123": 2}
    assert rows[1]["dl"] == 30010
    assert [(rows[k]["dl"], rows[k]["terms"]) for k in (2, 3, 4)] == [(0, [])] * 3


def test_cascade_takes_one_branch_per_question(spark):
    from corpusbank.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = QUERIES["classification_cascade"](spark, folder).collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    assert len(rows) == items == len({r.item_id for r in rows})
    by_branch = Counter(r.branch for r in rows)
    assert set(by_branch) == {classify.RULE, classify.RETRIEVAL, classify.DOCUMENTS}
    assert all((r.method or "").startswith("DIRECTA") for r in rows if r.branch == classify.RULE)
    assert all(r.item_id % 4 == 0 for r in rows if r.branch == classify.DOCUMENTS)
    assert {r.state for r in rows if r.branch == classify.RULE} >= {"VALIDADA", "RECHAZADA"}
