"""The pipeline stage by stage against plain versions on a small corpus."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_hamming_dedup import brute
from test_pii import plain
from test_toxicity import documents as toxic_documents
from tokenizers import Tokenizer

import corpus_pipeline
from corpusbank.llm import compression_toxicity as ct
from corpusbank.llm import pii_weak, systematic_mix
from corpusbank.session import stage

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(1)
    rows, labels = [], []
    for i, text, toxic in toxic_documents(500):
        if i % 9 == 0:
            text += f" me@x{i}.org or 10.0.0.{i % 250}"
        rows.append((i, text, "en", rng.choice(["a", "b", "b", "b", None]), len(text)))
        labels.append((i, toxic, 1))
    rows += [(1000 + k, rows[k * 3 + 1][1] + " tail", "en", "c", 1) for k in range(60)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (2002, rows[2][1], "en", "a", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for name, function in corpus_pipeline.STAGES:
        kept.append(stage(function(spark, kept[-1], folder), "test"))
    rows = [[tuple(r) for r in k.collect()] for k in kept]
    assert all(k.columns == NAMES for k in kept[:5])

    scorer = ct.Scorer(ct.trained(spark, folder))
    want = [r for r in rows[0] if scorer.scores([r[1] or ""])[0] < ct.THRESHOLD]
    assert Counter(rows[1]) == Counter(want) and 350 < len(want) < len(rows[0]) - 60

    component = {i: c for i, (_, c) in brute([r[:2] for r in rows[1]], 5, 80).items()}
    assert Counter(rows[2]) == Counter(r for r in rows[1] if component[r[0]] == r[0])
    assert len(rows[2]) < len(rows[1]) - 30

    def masked(text):
        out, end = [], 0
        for s, k, e in plain(text):
            if s >= end:
                out += [text[end:s], f"<{pii_weak.KINDS[k].upper()}>"]
            end = max(end, e)
        return "".join([*out, text[end:]])

    before = {r[0]: r for r in rows[2]}
    for r in rows[3]:
        assert r[1] == (masked(before[r[0]][1]) if r[1] is not None else None)
        assert r[4] == (len(r[1]) if r[1] is not None else None) and r[2:4] == before[r[0]][2:4]
    assert len(rows[3]) == len(rows[2]) and any("<EMAIL>" in (r[1] or "") for r in rows[3])

    mix = {r.doc_id: r.copies for r in systematic_mix.systematic_mix(kept[3]).collect()}
    assert Counter(rows[4]) == Counter({r: mix[r[0]] for r in rows[3] if mix[r[0]]})

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.no_truncation(), model.no_padding()
    text = {r[0]: r[1] for r in rows[4]}
    final = kept[5].collect()
    assert Counter(r.doc_id for r in final) == Counter(r[0] for r in rows[4])
    for r in final:
        assert r.ids == model.encode(text[r.doc_id] or "", add_special_tokens=False).ids and r.decodes

    # The whole run gives the same rows.
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(str, whole)) == Counter(map(str, final))


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_against_a_loop(spark, folder):
    """Targets by repeated resharing, copies by one running sum per source."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*NAMES)
    got = {r.doc_id: r for r in systematic_mix.systematic_mix(
        docs.withColumn("size", F.lit("x")).withColumn("_rn", F.lit(1))).collect()}
    rows = docs.collect()
    total = Counter()
    for r in rows:
        total[r.source] += size(r.text)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        rest = sum(total.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in free) for s in free}
        over = {s for s in free if share[s] >= 3 * total[s]}
        if not over:
            break
        target |= {s: 3.0 * total[s] for s in over}
        free -= over
    target |= {s: share[s] for s in free}
    taken = Counter()
    for r in rows:
        g = got[r.doc_id]
        assert g.size == size(r.text) and g.target == pytest.approx(target[r.source])
        assert g.taken == g.copies * g.size and 0 <= g.copies <= 3
        taken[r.source] += g.taken
    longest = max(size(r.text) for r in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in names)
    assert systematic_mix.systematic_mix(docs.limit(0)).count() == 0
