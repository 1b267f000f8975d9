"""Factorisation machine: interactions, gradients, held-out accuracy, edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusbank.llm import quality_fm as fm


def test_linear_time_identity():
    """The score equals the sum over all pairs."""
    rng = np.random.default_rng(1)
    machine = fm.Machine(0.7)
    machine.w = rng.normal(size=machine.w.shape)
    machine.v = rng.normal(scale=0.3, size=machine.v.shape)
    bucket, value = np.array([3, 17, 90]), np.array([.5, .2, .7])
    statistics = rng.normal(size=(1, fm.STATISTICS))
    x = np.zeros(fm.BUCKETS + fm.STATISTICS)
    x[bucket], x[fm.BUCKETS:] = value, machine.dense(statistics)[0]
    at = np.flatnonzero(x)
    z = machine.w0 + machine.w @ x + sum(
        machine.v[i] @ machine.v[j] * x[i] * x[j] for k, i in enumerate(at) for j in at[k + 1:])
    assert machine.scores(bucket, value, np.array([3]), statistics)[0] == pytest.approx(
        1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_learns_an_interaction():
    """Exclusive or of two words: no linear model can."""
    rng = np.random.default_rng(2)
    a, b = rng.random(1500) < .5, rng.random(1500) < .5
    rows = [([5] if x else [6]) + ([40] if z else [41]) for x, z in zip(a, b)]
    bucket, per_text = np.concatenate(rows), np.full(1500, 2)
    value, flat = np.full(3000, .7), np.zeros((1500, fm.STATISTICS))
    y = (a ^ b).astype(float)
    machine = fm.Machine(0.5)
    machine.fit(bucket, value, per_text, flat, y, epochs=60)
    assert ((machine.scores(bucket, value, per_text, flat) > .5) == y).mean() > 0.98


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("quality"))
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    rows, labels = [], []
    for i in range(900):
        own = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        good = i % 4 > 0
        if not good:
            own = [w + "###" for w in own] if i % 8 else [own[0]] * len(own)
        rows.append((i, " ".join(own), len(" ".join(own))))
        labels.append((i, int(good)))
    rows += [(5000, None, None), (5001, "", 0), (5002, "x" * 300_000, 5), (5003, rows[7][1], rows[7][2])]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn(
        "score", F.lit("own")).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    return out, dict(labels)


def test_held_out_accuracy(spark, folder):
    out, labels = folder
    got = {r.doc_id: r for r in fm.op3_quality_fm(spark, out).collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert len(held) > 120 and len(got) == 904
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[5003].score == got[7].score


def test_without_labels(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in fm.with_scores(docs, fm.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert fm.train(docs, one) == 1.0
    assert fm.with_scores(docs.limit(0), 0.5).count() == 0


def test_batches_do_not_matter():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab cd ef gh##".split()) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    machine = fm.Machine(0.6)
    n = np.array([len(t) for t in texts], dtype=float)
    whole = machine.scores(*fm.features(texts, n))
    each = [machine.scores(*fm.features([t], k[None]))[0] for t, k in zip(texts, n)]
    assert whole == pytest.approx(each, abs=1e-12)
