"""Personal data: base spans against plain regular expressions, EM, masking."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpusbank.llm import pii_weak as pii


def plain(text):
    """The contract's patterns, run as they are written."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        total = 0
        for k, c in enumerate(reversed(s)):
            d = int(c) * (1 + k % 2)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (pattern, good) in enumerate(rules)
                  for m in re.finditer(pattern, text) if good(m[0]))


def test_base_matches_plain_patterns():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@@", "x@y.z", ".", "..", "-", " ", "+", "1", "22", "333.", "4.5.6.7", "255",
             "256", "007", "4111111111111111", "(017) 555-7713", "+1 ", "é", "\n", "_", "%", "com", "()"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 18)))
        assert pii.base_spans(text) == plain(text), repr(text)


def test_linear_in_length():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 300_000, "@" * 300_000,
                 "+1(" * 100_000, "a@" * 150_000, "1-" * 150_000):
        assert isinstance(pii.find(text), list)


def test_em_finds_the_good_labelers():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.4
    right = [0.97, 0.8, 0.9, 0.55, 0.6]
    votes = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth) * 2 - 1 for a in right], 1)
    votes[rng.random(votes.shape) < 0.3] = 0
    rows, where, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, rate = pii.reliabilities(rows, count.astype(float))
    said = posterior[where.ravel()] > 0.5
    assert (said == truth).mean() > 0.93
    best = rate[:, 1, 2] / (rate[:, 1, 2] + rate[:, 1, 0])
    assert best[0] > 0.9 and best[2] > 0.85 and best[3] < 0.65


def test_run_together_and_failing_numbers(spark):
    good = "a@b.cc, 4111111111111111 and +1 (269) 555-3296 then 1.2.3.4. " * 30
    tail = "call +1 (855) 555-4208 486635120 of 4111111111111112"
    df = spark.createDataFrame([(1, good), (2, tail)], "doc_id long, text string")
    all_ = {r.doc_id: [(pii.KINDS[s.kind], tail[s.start:s.end]) for s in r.all]
            for r in pii.find_personal_data(df).collect()}
    assert all_[2] == [("phone", "+1 (855) 555-4208")]


def test_added_spans_keep_clear():
    text = "call me (212) 555-0199 or bob (at) mail (dot) com, card 4111 1111 1111 1112, x@y.zz"
    base = pii.base_spans(text)
    more = pii.more_candidates(text, base)
    assert {pii.KINDS[k] for _, k, _ in more} == {"phone", "email", "card"}
    spans = sorted([*base, *more])
    assert all(a[2] <= b[0] for a, b in zip(spans, spans[1:]))


def frame(spark):
    rows = [(1, None, 9), (2, "", 0), (3, "mail é bob@x.org now", 20), (3, "mail é bob@x.org now", 20),
            (4, "phone +1 (017) 555-7713 or 10.0.0.300 and 1.2.3.4", None),
            (None, "4111111111111111", 16)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn(
        "spans", F.lit("own")).withColumn("base", F.lit(1))


def test_frames(spark):
    df = frame(spark)
    got = pii.find_personal_data(df).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()
    want = [",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain(r.text or ""))
            for r in df.collect()]
    assert sorted(r.b for r in got) == sorted(want)
    masked = pii.mask_documents(df).collect()
    assert masked[0].text is None and masked[2].text == "mail é <EMAIL> now" == masked[3].text
    assert masked[4].text.startswith("phone <PHONE> or 10.0.0.300 and <IP>")
    assert [r.n_chars for r in masked[2:]] == [len(r.text) for r in masked[2:]]
    assert masked[5].text == "<CARD>" and masked[5].spans == "own"
    assert pii.find_personal_data(df.limit(0)).count() == 0 == pii.mask_documents(df.limit(0)).count()


def test_query(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op10_pii_weak_supervision(spark, str(tmp_path)).orderBy("base_sha256").collect()
    texts = [r.text or "" for r in frame(spark).collect()]
    want = sorted(hashlib.sha256(",".join(
        f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain(t)).encode()).hexdigest() for t in texts)
    assert [r.base_sha256 for r in got] == want
