"""HNSW search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from corpusbank.llm import hnsw


def brute(rows, k):
    """{query: [(vec_id, score)]} over all usable rows."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and not any(x is None for x in v) and (
                np.isfinite(v).all() and np.any(v)):
            good[i] = min(good.get(i, v), v)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    out = {}
    for i in ids[ids % 20 == 0].tolist():
        score = (x * np.array(good[i])).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def vectors():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    x = centers[rng.integers(0, 12, 3000)] + rng.normal(scale=.6, size=(3000, 16))
    x[500:1500] = x[500]  # a third of all rows are equal
    x *= rng.uniform(.5, 2, (3000, 1))
    x[500:1500] = x[500]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] + [1.0] * 15),
             (5080, [1.0] * 3), (None, [1.0] * 16), (5100, [float("inf")] * 16), rows[40], rows[41],
             (40, [9.0] * 16)]
    return rows


def test_recall_and_order(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = hnsw.nearest(df, F.col("_id") % 20 == 0, shard_rows=700, query_block=60).collect()
    want = brute(rows, 20)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(found[r.query_id]) == r["rank"]
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) > 0.97
    for own in found.values():
        assert own == sorted(own, key=lambda p: (-p[1], p[0])) and len(own) == 20


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])],
                               "vec_id long, embedding array<float>")
    got = hnsw.nearest(df, F.col("_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 2.0), (0, 2, 2, 0.0)]
    assert hnsw.nearest(df.limit(0), F.col("_id") % 20 == 0).count() == 0
    assert hnsw.nearest(df.limit(1), F.col("_id") % 20 == 0).count() == 0
