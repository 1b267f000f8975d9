"""Merkle manifest against a tree built in a loop."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusbank.llm import merkle_manifest as mm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}"
             for v in (doc_id, source, lang, n_chars, text))


def tree(leaves):
    """(root, [[(before, after) per level] per leaf])."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, place in enumerate(at):
            run = place // 8 * 8
            paths[k].append((level[run:place], level[place + 1:run + 8]))
            at[k] = place // 8
        level = [h(level[k:k + 8]) for k in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    """{(doc_id, leaf): (subroot, root, proof_sha256, folded_root, verified)} of documents rows."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        groups.setdefault(lang, []).append((doc_id, own, text, source, n_chars))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(tree([r[1] for r in groups[name]]))
    root, upper = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for name, (subroot, paths), above in zip(names, trees, upper):
        for (doc_id, own, text, source, n_chars), path in zip(groups[name], paths):
            path = path + above
            node = own
            if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 0:
                lower = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                node = leaf(doc_id, source, name, n_chars, lower)
            for before, after in path:
                node = h([*before, node, *after])
            proof = h(x for before, after in path for x in [*before, *after])
            out.append((doc_id, own, subroot, root, proof, node, node == root))
    return out


def documents(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(n)]), rng.choice(["Ab é", "", None, "x" * 50, "lower"]),
             rng.choice(langs), rng.choice([None, "web", ""]), rng.choice([None, 7]))
            for _ in range(n)]
    return rows + rows[:3]


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("n, langs", [
    (700, [None, "en", "", "é", "z"]), (9, ["en"]), (1, ["en"]), (600, [str(k) for k in range(80)])])
def test_query(spark, tmp_path, n, langs):
    rows = documents(n, langs)[:n if n == 1 else None]
    spark.createDataFrame(rows, SCHEMA).withColumns({"grp": F.lit(1), "proof": F.lit("x")}) \
        .repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    df = mm.op12_merkle_manifest(spark, str(tmp_path))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                          "verified"]
    got = sorted((tuple(r) for r in df.collect()), key=key)
    assert got == sorted(plain(rows), key=key)


@pytest.mark.parametrize("part, levels", [(1, 1), (13, 2), (64, 2), (100, 1)])
def test_parts_of_any_size(spark, part, levels):
    digests = [h([str(k)]) for k in range(1100)]
    rows = [(0, k, 1100, d) for k, d in enumerate(digests)] + [(1, 0, 1, digests[5])]
    leaves = spark.createDataFrame(rows, "grp long, pos long, n long, digest string")
    nodes = mm.interior_nodes(leaves, levels)
    got = mm.multiproofs(leaves, nodes, part=part).collect()
    root, paths = tree(digests)
    assert len(got) == len(rows)
    for r in got:
        path = paths[r.pos] if r.grp == 0 else []
        assert r.root == r.subroot == (root if r.grp == 0 else digests[5])
        assert [tuple(p) for p in r.proof] == [("".join(b), "".join(a)) for b, a in path]


def test_missing_nodes_are_minimal(spark):
    count, part = 1000, 37
    parts = [(0, k // part, k, min(k + part, count) - 1, count) for k in range(0, count, part)]
    got = mm.missing_nodes(spark.createDataFrame(
        parts, "grp long, part long, first long, last long, n long")).collect()
    for _, number, first, last, _ in parts:
        want, low, high, n, level = set(), first, last, count, 0
        while n > 1:
            runs = {k // 8 for k in range(low, high + 1)}
            want |= {(level, k) for k in range(n) if k // 8 in runs and not low <= k <= high}
            low, high, n, level = low // 8, high // 8, (n + 7) // 8, level + 1
        mine = [(r.level, r.pos) for r in got if r.part == number]
        assert len(mine) == len(set(mine)) and set(mine) == want


def test_empty_and_long(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert mm.op12_merkle_manifest(spark, f"{tmp_path}/a").count() == 0
    rows = [(1, "Äb " * 700_000, "en", "web", 3), (2, "b", "en", "web", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = mm.op12_merkle_manifest(spark, f"{tmp_path}/b").collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))


def test_names_in_use(spark):
    leaves = spark.createDataFrame([(0, 0, 1, "x", 1)],
                                   "grp long, pos long, n long, digest string, kind int")
    with pytest.raises(ValueError):
        mm.multiproofs(leaves, mm.interior_nodes(leaves))
