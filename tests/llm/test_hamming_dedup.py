"""Near-duplicates against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusbank.llm import hamming_dedup as hd
from corpusbank.llm.words import shingle_hashes, word_hashes


def shingles(text, k):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def brute(rows, k, percent):
    """{doc_id: (size, component)} over all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [make(rng.randint(1, 300)) for _ in range(120)]
    for base in (make(150), make(40), make(400)):  # families of edits, some far from each other
        for _ in range(70):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(own)
    texts = [" ".join(w) for w in rows] + ["", "  \n", "one", "ONE", "one two", "One\ttwo", "é É", "É é"]
    texts += [texts[130].upper(), texts[131].replace(" ", "\n\n")] * 15
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("k", [2, 5])
def test_matches_all_pairs(spark, k):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           hd.near_duplicates(df.repartition(5), words=k).collect()}
    want = brute(rows, k, 80)
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, [(i, got[i], want[i]) for i in wrong[:5]]


def border_family(n, seed=12):
    """Texts of about 100 words with edits that leave most pairs at similarity 0.75 to 0.85."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    rows = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(100), rng.choice([1, 2, 3, 4, 5, 5, 6, 6, 7, 8])):
            own[at] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            del own[rng.randrange(len(own))]
        rows.append((3 * i + 1, " ".join(own)))
    rng.shuffle(rows)
    return rows


def by_counts(rows, k, percent):
    """{doc_id: component} and the number of similar pairs, from a matrix of common shingles."""
    holders, sizes = {}, np.zeros(len(rows), dtype=np.int32)
    for n, (_, text) in enumerate(rows):
        own = shingles(text, k)
        sizes[n] = len(own)
        for s in own:
            holders.setdefault(s, []).append(n)
    common = np.zeros((len(rows), len(rows)), dtype=np.int32)
    for held in holders.values():
        if len(held) > 1:
            common[np.ix_(held, held)] += 1
    similar = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(similar, True)
    ids = np.array([i for i, _ in rows])
    root = ids.copy()
    while True:
        least = np.where(similar, root[None, :], ids.max()).min(axis=1)
        if (least == root).all():
            return dict(zip(ids.tolist(), root.tolist())), int(np.triu(similar, 1).sum())
        root = least


def test_a_large_border_family(spark, monkeypatch):
    """No link of a family at the border is lost, and few pairs are confirmed on their sets."""
    rows = border_family(2600)
    want, similar = by_counts(rows, 2, 80)
    assert len(set(want.values())) > 200 and similar > 50_000
    sizes, plain = [], hd.confirmed

    def counted(pairs, *args):
        sizes.append(pairs.count())
        return plain(pairs, *args)

    monkeypatch.setattr(hd, "confirmed", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in hd.near_duplicates(df, words=2).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, len(wrong)
    assert sum(sizes) < 250_000, sizes  # of 3.4 million pairs


@pytest.mark.parametrize("percent", [80, 90])
def test_prefixes_keep_every_similar_pair(spark, percent):
    """Against any pivot, also one unlike the texts, each similar pair is linked or to be confirmed."""
    rng = random.Random(percent)
    pool = list(range(60))
    own = {0: set(range(30)), 1: set(range(100, 140))}
    for i in range(2, 90):
        own[i] = set(rng.sample(pool[:rng.choice([34, 60])], rng.randint(24, 32)))
        if i % 3 == 0 and i > 5:
            own[i] = (own[i - 3] - set(rng.sample(sorted(own[i - 3]), 1))) | {rng.choice(pool)}
    sets = spark.createDataFrame([(i, sorted(s)) for i, s in own.items()], "_id long, _set array<long>")
    for pivot in (0, 1):
        members = spark.createDataFrame([(pivot, i, i) for i in own if i != pivot], "_a long, _b long, _root long")
        to_pivot, further = (set(map(tuple, d.collect())) for d in hd.prefix_pairs(members, sets, percent))
        similar = {(i, j) for i in own for j in own if i < j
                   and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j])}
        assert to_pivot == {(pivot, i) for i in own if i != pivot and tuple(sorted((pivot, i))) in similar}
        near = {i for _, i in to_pivot} | {pivot}
        missed = {(i, j) for i, j in similar if not {i, j} <= near} - further
        assert not missed and len(similar) > 20


def test_edges_of_the_contract(spark):
    rows = [(3, "a b c"), (3, "a b c"), (7, "a b c"), (None, "a b c"), (5, None), (6, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept)
                 for r in hd.near_duplicates(df, words=2).collect())
    assert got == [(0, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (5, 0, 5, True),
                   (6, 0, 6, True), (7, 2, 3, False), (8, 0, 8, True)]
    stay = hd.without_near_duplicates(df).collect()
    assert sorted(r.doc_id or 0 for r in stay) == [0, 3, 5, 6, 8]
    assert hd.near_duplicates(df.limit(0)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    a, b, c = "a b c d", "p q r s", "v w x y"
    rows = [(5, a), (7, a), (7, b), (9, b), (11, c), (11, ""), (11, None), (10, c), (12, "k l"), (12, "m n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles > 0): r.component_id for r in hd.near_duplicates(df, words=2).collect()}
    assert got == {(5, True): 5, (7, True): 5, (9, True): 5, (10, True): 10, (11, True): 10, (11, False): 11,
                   (12, True): 12}
    found = [sorted((r.doc_id, r.text or "") for r in hd.without_near_duplicates(d, words=2).collect())
             for d in (df, df.orderBy("text").repartition(3))]
    assert found[0] == found[1] and [r for r in found[0] if r[0] != 12] == [(5, a), (10, c), (11, "")]
    assert [r[0] for r in found[0]].count(12) == 1


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)]
    rng.shuffle(chain)
    edges = spark.createDataFrame([*chain, *star, (200, 201), (201, 202), (202, 200)], "_a long, _b long")
    got = {r._id: r._root for r in hd.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 160))
    assert got[201] == got[202] == 200


def test_pigeonhole(spark):
    """Signatures within the guaranteed distance always share a key; the distance is exact."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (300, 64)).astype(np.uint8)
    b = a.copy()
    for k, row in enumerate(b):
        at = rng.permutation(64)[: k % 22]
        row[at] ^= rng.integers(1, 256, len(at)).astype(np.uint8)
    rows = [(k, *map(int, x.view(np.int64)), *map(int, y.view(np.int64))) for k, (x, y) in enumerate(zip(a, b))]
    names = [*hd.SIGNATURE, *[f"y{n}" for n in hd.SIGNATURE]]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} long" for n in names))
    x = df.select("k", *hd.SIGNATURE, hd.signature_keys().alias("keys")).alias("x")
    y = df.select("k", *[F.col(f"y{n}").alias(n) for n in hd.SIGNATURE]).select(
        "*", hd.signature_keys().alias("keys")).alias("y")
    got = x.join(y, F.col("x.k") == F.col("y.k")).select(
        "x.k", hd.distance("x", "y").alias("d"),
        F.arrays_overlap("x.keys", "y.keys").alias("met")).collect()
    assert all(r.met and r.d == r.k % 22 for r in got) and len(got) == 300


def test_first_shared_slot_is_met_once(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 256, (120, 64)).astype(np.uint8)
    b = a.copy()
    for k, row in enumerate(b):
        row[rng.permutation(64)[: k % 22]] ^= 7
    rows = [(k, *map(int, x.view(np.int64)), *map(int, y.view(np.int64))) for k, (x, y) in enumerate(zip(a, b))]
    names = [*hd.SIGNATURE, *[f"y{n}" for n in hd.SIGNATURE]]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} long" for n in names))
    keyed = lambda f: f.select("*", F.posexplode(hd.signature_keys()).alias("_slot", "_key"))
    x = keyed(df.select("k", *hd.SIGNATURE)).alias("x")
    y = keyed(df.select("k", *[F.col(f"y{n}").alias(n) for n in hd.SIGNATURE])).alias("y")
    met = x.join(y, (F.col("x._key") == F.col("y._key")) & (F.col("x.k") == F.col("y.k"))
                 & hd.first_shared_slot("x", "y", hd.CHUNKS, hd.ERRORS))
    assert [r["count"] for r in met.groupBy("x.k").count().collect()] == [1] * 120


def test_word_hashes_do_not_depend_on_batches(monkeypatch):
    from corpusbank.llm import words

    texts = ["", "a", "A b\tc d e f", "x" * 500, " lead and trail ", "é ü\nq", *["w%d" % i * 9 for i in range(50)]]
    whole = shingle_hashes(texts, 3)
    counts = word_hashes(texts)[1].tolist()
    assert counts == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    monkeypatch.setattr(words, "PIECE", 7)
    again = shingle_hashes(texts, 3)
    assert (whole[0] == again[0]).all() and (whole[1] == again[1]).all()
