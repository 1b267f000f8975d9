"""Closed syncmers: edited texts against a plain loop, anchors, buckets."""

import bisect
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusbank.llm import syncmers as sy


def documents(ids):
    rng = random.Random(6)
    words = [f"wört{i}" for i in range(300)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in ids]


@pytest.mark.parametrize("bucket_rows,ids", [
    (7, random.Random(1).sample(range(1000), 120)), (2048, range(50)), (3, [5]),
    (2, [10**15, 3, 1, -4, 10**6])])
def test_edited_texts(spark, tmp_path, bucket_rows, ids):
    rows = documents(ids)
    got = {r.doc_id: r for r in sy.edited_fingerprints(
        spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=bucket_rows).collect()}
    ordered = sorted(rows, reverse=True)
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        m = len(text) // 3
        assert got[i].n_chars == len(text) and got[i].edited == text[:len(text) - m] + after[:m]
    fps = {i: got[i].fingerprint for i in got}
    for k, (i, _) in enumerate(ordered):
        assert got[i].next_fingerprint == fps[ordered[(k + 1) % len(ordered)][0]]


def test_query_and_odd_rows(spark, tmp_path):
    rows = [(1, "a b c d e f g h"), (2, None), (3, ""), (4, "a b"), (None, "x y z"), (5, "a b c d e f g h"),
            (5, "a b c d e f g h")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("z")).write.parquet(
        f"{tmp_path}/documents.parquet")
    got = sy.op5_closed_syncmers(spark, str(tmp_path)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].fingerprint == by[5].fingerprint != ""
    assert by[2].fingerprint == by[3].fingerprint == "" and by[3].near_next == 1.0
    assert by[4].near_next == 0.0 and 0 <= by[1].near_edited <= 1
    # 2 and 3 are empty, so 4's text loses its last third to nothing
    assert by[4].edited_sha256 == hashlib.sha256(b"a ").hexdigest()
    assert by[None].edited_sha256 == hashlib.sha256("x y a".encode()).hexdigest()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sy.edited_fingerprints(empty).count() == 0


def test_anchors_are_free_of_context(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rng = random.Random(2)
    other = lambda n: " ".join(f"q{rng.randrange(500)}" for _ in range(n))
    rows = [(1, f"{other(30)} {passage} {other(10)}"), (2, f"{other(75)}\n{passage}")]
    got = {r.doc_id: {(a.pos, a.hash) for a in r.anchors} for r in sy.anchors(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    inside = {1: {(p - 30, h) for p, h in got[1] if 30 <= p <= 85},
              2: {(p - 75, h) for p, h in got[2] if 75 <= p <= 130}}
    assert inside[1] == inside[2] and len(inside[1]) > 10


def test_likeness_follows_common_text(spark):
    rng = random.Random(3)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = make(600)
    rows = [(k, " ".join(base), " ".join(base[:600 - cut] + make(cut)))
            for k, cut in enumerate((0, 60, 200, 600))]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    got = sy.fingerprints(sy.fingerprints(df, "a", "x"), "b", "y").select(
        "k", sy.likeness("x", "y").alias("l")).orderBy("k").collect()
    assert got[0].l == 1.0 and 0.65 < got[1].l < 0.95 and 0.3 < got[2].l < 0.7 and got[3].l == 0.0


def plain_likeness(x, y):
    first = [{}, {}]
    for side, found in zip(first, (x, y)):
        for m in found:
            side.setdefault(m.hash, m.pos)
    common = sorted((p, first[1][h]) for h, p in first[0].items() if h in first[1])
    tails = []
    for _, p in common:
        k = bisect.bisect_right(tails, p)
        tails[k:k + 1] = [p]
    either = len(first[0]) + len(first[1]) - len(common)
    return len(tails) / either if either else 1.0


def test_likeness_over_all_anchors_in_order(spark):
    """Whole sets against a plain loop: long, repeated, moved and short texts."""
    rng = random.Random(7)
    make = lambda n, of=10**6: [f"w{rng.randrange(of)}" for _ in range(n)]
    long, line = make(3000), make(12)
    pairs = [(long, long[:2000] + make(1000)), (long, long[1500:] + long[:1500]), (long, long),
             (line * 40, line * 30 + long[:50]), (make(4), make(4)), (line[:4], line[:3]), (line[:6], line[:4]),
             (line[:1], line[:1]), ([], line), ([], [])]
    pairs += [(make(rng.randint(0, 40), 6), make(rng.randint(0, 40), 6)) for _ in range(60)]
    rows = [(k, " ".join(x), " ".join(y)) for k, (x, y) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    got = sy.fingerprints(sy.fingerprints(df, "a", "x"), "b", "y").withColumn(
        "l", sy.likeness("x", "y")).withColumn("t", sy.as_text("x")).orderBy("k").collect()
    for r in got:
        assert r.l == pytest.approx(plain_likeness(r.x, r.y)), (r.k, r.a[:80], r.b[:80])
        assert r.t == "".join(f"{m.hash % 2**64:016x}{m.pos:08x}" for m in r.x)
    assert len(got[0].x) > 1000 and abs(got[0].l - 0.5) < 0.03
    assert 0.45 < got[1].l < 0.55  # half of it is moved
    assert got[2].l == got[7].l == got[9].l == 1.0 and got[8].l == 0.0
    assert got[5].l == 0.75 and got[6].l > 0.3


def test_words_are_the_same():
    assert re.findall(sy.WORD, " a\tb\x0bc ") == ["a", "b", "c"]
