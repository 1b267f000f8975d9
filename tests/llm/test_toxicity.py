"""Compression-distance toxicity: held-out accuracy, edges, filtering."""

import random

import pytest
from pyspark.sql import functions as F

from corpusbank.llm import compression_toxicity as ct


def documents(n=900, seed=9):
    rng = random.Random(seed)
    syllables = "an ter lo mi sta ve ru pon dal kei sor fri bu net gal".split()
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    bad = "wretched filthscum dunderhead vermin".split()
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        toxic = int(i % 5 == 0)
        for _ in range(rng.randint(2, 6) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("toxic"))
    rows = documents()
    extra = [(5000, None, None), (5001, "", None), (5002, "x" * 200_000, None), (5003, rows[5][1], None)]
    spark.createDataFrame([r[:2] for r in rows + extra], "doc_id long, text string").withColumn(
        "score", F.lit("own")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    return folder, rows


def test_held_out_accuracy(spark, tables):
    folder, rows = tables
    got = {r.doc_id: r for r in ct.op9_compression_toxicity(spark, folder).collect()}
    held = [(got[i], t) for i, _, t in rows if got[i].held_out]
    assert len(held) > 200 and len(got) == len(rows) + 4
    right = sum(r.predicted == t for r, t in held) / len(held)
    assert right > 0.97, right
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[5000].score == got[5001].score < 0.5 and got[5003].score == got[5].score


def test_filter_keeps_columns(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stay = ct.without_toxic(docs, ct.trained(spark, folder))
    assert stay.columns == docs.columns
    ids = {r.doc_id for r in stay.collect()}
    assert {5000, 5001, 5002} <= ids
    assert sum(i in ids for i, _, t in rows if not t) > 0.98 * 720
    assert sum(i in ids for i, _, t in rows if t) < 0.1 * 180


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = ct.training_rows(docs, none)
    assert [r.score for r in ct.with_scores(docs, model).collect()] == [0.0, 0.0]
    assert ct.with_scores(docs.limit(0), model).count() == 0


def test_windows():
    assert sorted(ct.windows("A b\nb  C")) == ["a", "b", "c"] and ct.windows("") == []
    long = ct.windows("é" * 1000)
    assert all(len(w.encode()) <= ct.WINDOW_BYTES for w in long)
