"""Versioned stores, streaming jobs, the file ledger, reports and packs."""

import hashlib
import json
import os
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusbank.operators import search
from corpusbank.plans import bank as plans
from corpusbank.queries import maintenance
from corpusbank.queries.registry import Tables
from corpusbank.session import stage
from corpusbank.sources import readers, versions, writers
from corpusbank.streaming import jobs

ABCD = {x: f"t{x}" for x in "ABCD"}


def files_of(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def accepted(spark, rows):
    return spark.createDataFrame(
        [(c, q, 1, 2, "A", ABCD, ok) for c, q, ok in rows],
        "call_id long, question_id long, part_id long, topic_id long, answer string, "
        "options map<string,string>, complete boolean")


def bank_rows(spark, root):
    stored = plans.stored_bank(spark, root)
    return (sorted((r.call_id, r.question_id) for r in stored["questions"].collect()),
            stored["options"].count())


def test_rebuild_replaces_calls_and_keeps_others(spark, tmp_path):
    root = f"{tmp_path}/bank"
    versions.create_store(spark, root, "call_id long")
    first = accepted(spark, [(1, 10, True), (1, 11, True), (2, 20, True), (3, 30, True)])
    versions.publish(plans.bank_tables(first), root, "call_id", first)
    calls = spark.createDataFrame([(1,), (3,), (4,)], "call_id long")
    new = accepted(spark, [(1, 12, True), (1, 13, False), (2, 99, True), (4, 40, True)])
    for run in range(2):
        counts = {r.call_id: (r.deleted, r.accepted, r.inserted, r.skipped)
                  for r in plans.store_rebuild(root, new, calls).collect()}
        want = {1: (2, 2, 1, 1), 3: (1, 0, 0, 0), 4: (0, 1, 1, 0)} if run == 0 else {
            1: (1, 2, 1, 1), 3: (0, 0, 0, 0), 4: (1, 1, 1, 0)}
        assert counts == want
        assert bank_rows(spark, root) == ([(1, 12), (2, 20), (4, 40)], 12)


def test_failed_change_leaves_the_old_version(spark, tmp_path):
    root = f"{tmp_path}/bank"
    versions.create_store(spark, root, "call_id long")
    first = accepted(spark, [(1, 10, True), (2, 20, True)])
    versions.publish(plans.bank_tables(first), root, "call_id", first)
    before = bank_rows(spark, root)
    good = plans.bank_tables(accepted(spark, [(1, 77, True)]))
    bad = good["options"].withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):  # questions are written, the options fail, nothing is committed
        versions.publish({"questions": good["questions"], "options": bad}, root, "call_id", first)
    assert bank_rows(spark, root) == before


def test_children_are_replaced_in_their_buckets(spark, tmp_path):
    root, schema = f"{tmp_path}/children", "doc long, child long, place long"
    rows = spark.createDataFrame([(d, c) for d in range(40) for c in range(3)], "doc long, child long")
    plans.create_children(root, rows, "doc", ["child"], buckets=8)
    before = files_of(f"{root}/children")
    new = spark.createDataFrame([(5, 9), (5, 7), (100, 1)], "doc long, child long")
    plans.replace_stored_children(root, schema, new, "doc", ["child"], buckets=8)
    got = {}
    for r in plans.stored_children(spark, root, schema).collect():
        got.setdefault(r.doc, []).append((r.place, r.child))
    assert sorted(got.pop(5)) == [(1, 7), (2, 9)] and got.pop(100) == [(1, 1)]
    assert len(got) == 39 and all(sorted(v) == [(1, 0), (2, 1), (3, 2)] for v in got.values())
    after = files_of(f"{root}/children")
    assert before <= after  # nothing is written over
    written = {os.path.basename(os.path.dirname(f)) for f in after - before}
    assert 1 <= len(written) <= 2  # buckets of the two parents
    log = spark.read.parquet(f"{root}/log").groupBy("bucket").agg(F.max("seq").alias("seq")).collect()
    assert {f"bucket={r.bucket}" for r in log if r.seq > 1} == written


def questions(spark, rows):
    return spark.createDataFrame(
        [(pos, "1", stem, "a", "b", "c", "d", "A", f"f{pos % 2}") for pos, stem in rows],
        "pos long, page string, stem string, opt_a string, opt_b string, opt_c string, "
        "opt_d string, answer string, file string")


def test_import_batches_prune_and_replay(spark, tmp_path):
    bank, out = f"{tmp_path}/bank", f"{tmp_path}/out"
    stored = plans.with_fingerprint(questions(spark, [(900, "vieja")])).select(F.col("pos").alias("id"), "fp")
    jobs.create_bank(spark, bank, stored)

    def importer(batch, known):
        return plans.label_questions(batch, known, ["file"]).select("pos", "label", "existing_id")

    def state():
        rows = spark.read.parquet(out).select("batch_id", "pos", "label", "existing_id").collect()
        return sorted(map(tuple, rows), key=str), spark.read.parquet(bank).count()

    first = questions(spark, [(1, "una"), (2, "vieja"), (3, "una"), (5, "dos"), (7, " ")])
    second = questions(spark, [(11, "dos"), (12, "tres")])
    for replay in range(2):
        jobs.import_batch(first, 0, bank, out, plans.with_fingerprint, importer)
        if replay:  # the batch that followed is still there
            assert state() == done
        jobs.import_batch(second, 1, bank, out, plans.with_fingerprint, importer)
        done = state()
    labels = {pos: (label, known) for _, pos, label, known in done[0]}
    assert labels == {1: ("NUEVA", None), 2: ("DUPLICADA_BD", 900), 3: ("DUPLICADA_LOTE", None), 5: ("NUEVA", None),
                      7: ("ERROR_EXTRACCION", None), 11: ("DUPLICADA_BD", 5), 12: ("NUEVA", None)}
    assert done[1] == 4
    fps = plans.with_fingerprint(second).select("fp")
    plan = jobs.stored_questions(spark, bank, fps, 9)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*prefix#\d+ IN \(", plan)


def test_index_ranks_like_the_corpus_and_reads_few_buckets(spark, tmp_path):
    docs = spark.createDataFrame(
        [(k, f"w{k % 7} w{k % 11} w{k % 13} común", "p" if k % 2 else "q") for k in range(200)],
        "doc long, text string, part string")
    asked = spark.createDataFrame([(1, "w3 w5", "p"), (2, "común w12", "q"), (3, "nada", "p")],
                                  "q long, text string, part string")
    root = f"{tmp_path}/index"
    versions.create_store(spark, root, "name string")
    terms = search.document_terms(docs, "doc", "text", ["part"])
    jobs.store_index(root, "all", search.document_terms(docs.limit(0), "doc", "text", ["part"]), "doc", ["part"])
    jobs.store_index(root, "all", terms, "doc", ["part"])  # the next version replaces the first
    ranker = jobs.stored_ranker(spark, root, "all", doc_id="doc", query_id="q", part="part string")
    for part in ([], ["part"]):
        want = search.bm25_topk(docs, asked, doc_id="doc", text="text", query_id="q", query_text="text", part=part)
        assert {tuple(r) for r in ranker(asked, part).collect()} == {tuple(r) for r in want.collect()}
    plan = versions.published(
        spark, root, "postings", "name", "doc long, dl int, tok string, tf int, bucket int, part string, name string"
    )._jdf.queryExecution().executedPlan().toString()
    versions_in = re.search(r"PartitionFilters: \[[^\]]*version#\d+ (IN|=)", plan)
    assert versions_in and plan.count("version=") <= 1  # the empty first version is not read


def test_one_index_ranks_within_a_part(spark, tmp_path):
    """Ranking within some sources equals ranking over their documents alone."""
    rows = [(n, "ab"[n % 2], f"gato {'perro ' * (n % 3)}{'raton' if n % 5 else 'pez azul'}") for n in range(40)]
    docs = stage(search.document_terms(
        spark.createDataFrame(rows, "doc_id long, source string, text string"), "doc_id", "text", ["source"]), "t")
    asked = spark.createDataFrame([(1, "perro azul"), (2, "gato raton pez")], "item_id long, text string")
    root = str(tmp_path)
    versions.create_store(spark, root, "name string")
    jobs.store_index(root, "all", docs, "doc_id", ["source"])
    own = search.ranked_documents(docs.filter("source = 'b'"), asked, doc_id="doc_id", query_id="item_id",
                                  query_text="text").withColumnRenamed("doc_id", "candidate_id")
    rank = jobs.stored_ranker(spark, root, "all", doc_id="doc_id", query_id="item_id", part="source string",
                              within=spark.createDataFrame([("b",)], "source string"))
    want = {(r.item_id, r.candidate_id, r.score, r["rank"]) for r in own.collect()}
    assert want and {(r.item_id, r.candidate_id, r.score, r["rank"]) for r in rank(asked, []).collect()} == want


def test_index_reads_the_buckets_of_its_tokens(spark, monkeypatch):
    read = []
    monkeypatch.setattr(search, "stage", lambda df, label: read.append((label, df)) or stage(df, label))
    docs = spark.createDataFrame([(k, f"w{k % 90}") for k in range(900)], "doc long, text string")
    tables = search.index_tables(search.document_terms(docs, "doc", "text"), "doc")
    asked = spark.createDataFrame([(1, "w3 w5")], "q long, text string")
    got = search.ranked_from_index(tables["postings"], tables["sizes"], asked, doc_id="doc", query_id="q",
                                   query_text="text", k=3).collect()
    assert len(got) == 3
    plan = dict(read)["bm25-postings"]._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r" IN \(\d+,\d+\)", plan)  # of 64 buckets


def test_classification_replay_adds_nothing(spark, tmp_path):
    inbox, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for drop in ([(1, "a"), (2, "b")], [(3, "c")], []):
        spark.createDataFrame(drop, "id long, x string").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("id long, x string").parquet(inbox)
        jobs.classify_stream(stream, out, f"{tmp_path}/checkpoint",
                             lambda b: b.withColumn("x", F.upper("x"))).awaitTermination()
    batch = spark.createDataFrame([(3, "C")], "id long, x string")
    number = max(r.batch_id for r in spark.read.parquet(out).filter("id = 3").collect())
    jobs._write_batch(batch, out, number)  # the batch once more
    assert sorted((r.id, r.x) for r in spark.read.parquet(out).collect()) == [(1, "A"), (2, "B"), (3, "C")]


def test_file_ledger(spark, tmp_path):
    inbox, ledger = tmp_path / "in", f"{tmp_path}/ledger"
    (inbox / "sub").mkdir(parents=True)
    for name, body in (("a.pdf", b"1"), ("b.pdf", b"2"), ("sub/c.pdf", b"1")):
        (inbox / name).write_bytes(body)

    def run():
        rows = readers.ingest_files(spark, str(inbox), ledger).collect()
        return {os.path.basename(r.file): r.status for r in rows}

    assert run() == {"a.pdf": "new", "b.pdf": "new", "c.pdf": "known"}
    assert run() == {}
    os.utime(inbox / "a.pdf", (1, 1))  # touched, same bytes
    (inbox / "old.pdf").write_bytes(b"3")
    os.utime(inbox / "old.pdf", (5, 5))  # delivered late with an early time
    assert run() == {"a.pdf": "known", "old.pdf": "new"}
    (inbox / "b.pdf").write_bytes(b"22")
    assert run() == {"b.pdf": "new"} and run() == {}


def test_file_ledger_of_bundles(spark, tmp_path):
    """Texts of bundles have a hash and a status of their own; known bundles are not read again."""
    inbox, ledger = tmp_path / "in", f"{tmp_path}/ledger"

    drops = iter(range(9))

    def run(texts):
        rows = spark.createDataFrame(texts, "k int, v string").coalesce(1)
        writers.write_bundles(rows, f"{inbox}/{next(drops)}", "k", "v", most=2)
        rows = readers.ingest_files(spark, str(inbox), ledger, bundles=True).collect()
        return {(int(r.file.split("#")[1]), r.hash, r.status) for r in rows}

    def sha(text):
        return hashlib.sha256((text + "\n").encode()).hexdigest()

    assert run([(1, "é\n2"), (2, ""), (3, "x")]) == {
        (1, sha("é\n2"), "new"), (2, sha(""), "new"), (3, sha("x"), "new")}
    assert len(list(inbox.rglob("part-*"))) == 2
    assert run([(4, "x"), (5, "y")]) == {(4, sha("x"), "known"), (5, sha("y"), "new")}
    assert run([]) == set() and run([]) == set()


def test_file_ledger_reads_files_of_a_repeated_hour(spark, tmp_path, monkeypatch):
    """When clocks go back, two moments have one local time in the driver's Python."""
    for name, moment in (("a", 1761438600), ("b", 1761442200)):  # 02:30 in Madrid, an hour apart
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (moment, moment))
    monkeypatch.setenv("TZ", "Europe/Madrid")
    time.tzset()
    try:
        rows = readers.ingest_files(spark, str(tmp_path), f"{tmp_path}-ledger").collect()
    finally:
        monkeypatch.undo()
        time.tzset()
    assert sorted((os.path.basename(r.file), r.status) for r in rows) == [("a", "new"), ("b", "new")]


def test_other_files_among_bundles(spark, tmp_path):
    """A file that is no bundle is a text of its own, also where a name comes twice in a bundle."""
    (tmp_path / "a").write_bytes(b"\xff no bundle\n")
    (tmp_path / "b").write_bytes(b"\x1e1\nx\n\x1e1\ny\n")
    (tmp_path / "c").write_bytes(b"")
    rows = readers.ingest_files(spark, str(tmp_path), f"{tmp_path}-ledger", bundles=True).collect()
    assert sorted((os.path.basename(r.file), r.hash, r.status) for r in rows) == sorted(
        (name, hashlib.sha256(text).hexdigest(), "new")
        for name, text in (("a", b"\xff no bundle\n"), ("b#1", b"x\n"), ("b#1", b"y\n")))


def test_ingest_query_takes_every_file(spark, tmp_path, monkeypatch):
    """Each group of documents is a file of its own for the listing, the ledger and the hash."""
    texts = {n: None if n % 9 == 4 else f"text {n}" for n in range(5, 64)}
    spark.createDataFrame([*texts.items(), (None, "x")], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    root = tmp_path / "work"
    monkeypatch.setattr(maintenance, "new_path", lambda *_: str(root))
    got = maintenance.incremental_ingest(Tables(spark, str(tmp_path))).collect()

    def sha(ids):
        whole = "".join(hashlib.md5((texts.get(n, "x") or "").encode()).hexdigest() for n in ids)
        return hashlib.sha256((whole + "\n").encode()).hexdigest()

    hashes = {None: sha([None])} | {k: sha([n for n in texts if n // 10 == k]) for k in range(7)}
    early = [k for k in hashes if k is not None and k <= 3]
    want = [(1, k, hashes[k], "new") for k in early] + [
        (2, k, h, "known" if k in early else "new") for k, h in hashes.items()]
    assert Counter(map(tuple, got)) == Counter(want)
    found = [p for p in (root / "inbox").rglob("part-*") if p.stat().st_size]
    ledger = spark.read.parquet(f"{root}/ledger").filter("length > 0")
    assert len(found) == len(want) == ledger.count() == ledger.select("file").distinct().count()


def test_question_files_with_problems(spark, tmp_path):
    good = {"archivo_origen": "x", "preguntas": [{"numero": 1, "enunciado": "é"}, {"numero": 2}]}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=2, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"archivo_origen": "y", "preguntas": []}), encoding="utf-8")
    (tmp_path / "c.json").write_text('{\n "archivo_origen": "z"\n}', encoding="utf-8")
    (tmp_path / "d.json").write_text('{\n "archivo_origen": "v", "preg', encoding="utf-8")
    rows = readers.read_question_files(spark, str(tmp_path)).collect()
    got = sorted((os.path.basename(r.file), r.indice, r.problem, r.pregunta and r.pregunta.numero) for r in rows)
    assert got == [("a.json", 1, None, 1), ("a.json", 2, None, 2), ("b.json", None, "empty", None),
                   ("c.json", None, "missing", None), ("d.json", None, "broken", None)]


def test_reports_page_their_incidents(spark, tmp_path):
    rows = spark.createDataFrame([("hot", k, "ERROR" if k % 2 else "NUEVA") for k in range(50)] + [("b", 1, "NUEVA")],
                                 "file string, pos long, label string")
    reports = writers.incident_reports(
        rows, "file", "pos", F.struct(F.count(F.lit(1)).alias("processed")), F.col("label") != "NUEVA",
        ["pos", "label"], most=10)
    writers.write_reports(reports, f"{tmp_path}/r", "file")
    back = spark.read.schema(reports.schema).json(f"{tmp_path}/r").orderBy("file", "page").collect()
    assert [(r.file, r.page, r.pages, len(r.incidents)) for r in back] == [
        ("b", 0, 1, 0), ("hot", 0, 3, 10), ("hot", 1, 3, 10), ("hot", 2, 3, 5)]
    assert [i.pos for r in back for i in r.incidents] == list(range(1, 50, 2))
    assert all(r.summary.processed == (50 if r.file == "hot" else 1) for r in back)


def test_pack_layout(spark):
    docs = spark.createDataFrame([(7, " uno ", "n.pdf", "art. 1", None), (8, "dos", "m.pdf", None, "Título")],
                                 "d long, x string, n string, r string, t string")
    ranked = spark.createDataFrame([(1, 8, 1), (1, 7, 2)], "q long, d long, rank int")
    (pack,) = search.pack_fragments(ranked, docs, doc_id="d", text="x", query_id="q", name="n", reference="r").collect()
    line = "=" * 60
    assert pack.pack == (f"\n{line}\nFragmento 1\nfragmento_id=8\ndocumento=m.pdf\nreferencia=\n\ndos\n"
                         f"\n{line}\nFragmento 2\nfragmento_id=7\ndocumento=n.pdf\nreferencia=art. 1\n\nuno\n")
    (pack,) = search.pack_documents(ranked, docs, doc_id="d", text="x", query_id="q", name="n", title="t", shown=3).collect()
    line = "-" * 70
    assert pack.pack == (f"\n\n{line}\nDOCUMENTO 1\n{line}\nID: 8\nNombre: m.pdf\nTítulo: Título\n\nContenido:\n\ndos"
                         f"\n\n{line}\nDOCUMENTO 2\n{line}\nID: 7\nNombre: n.pdf\n\nContenido:\n\nun")


def test_exams_share_no_item(spark):
    bank = spark.range(300).select(F.col("id").alias("item"), F.lit("b").alias("block"), (F.col("id") % 3).alias("topic"))
    counts = spark.createDataFrame([("b", 0, 5), ("b", 1, 3), ("b", 2, 2)], "block string, topic long, n long")
    targets = spark.createDataFrame([("b", 80)], "block string, target long")
    used = spark.range(0, 300, 10).select(F.col("id").alias("item"))
    rows = plans.build_exams(bank, counts, targets, 4, used=used, order=F.col("item"), topic_order=F.col("topic"),
                             block_position=F.col("block"), shuffle=F.md5(F.col("item").cast("string"))).collect()
    items = [r.item for r in rows]
    assert len(items) == len(set(items)) == 270 and not any(i % 10 == 0 for i in items)
    sizes = [sum(r.exam == n for r in rows) for n in (1, 2, 3, 4)]
    assert sizes == [80, 80, 80, 30]
    assert all(sorted(r.number for r in rows if r.exam == n) == list(range(1, s + 1)) for n, s in enumerate(sizes, 1))
