"""Merkle manifest of a dataset with one multiproof per part of the leaves.

Leaves are numbered per group (``lang``) and hashed in runs of eight up to a subroot; the subroots,
in the groups' order, are hashed alike up to the root.  A *part* is a stretch of consecutive leaves
of one group, so a group of any size is many parts.  For the proofs of all its leaves a part needs,
on every level, the members of its outermost runs that its own leaves do not give: the minimal
union, at most 14 coordinates a level, worked out from the part's first and last position.  The
coordinates are joined once with the stored interior nodes, the part's task hashes the interiors
that its proofs share, and each leaf's proof is put together from them in place.  No proof is
shuffled; a task holds one part.

The tree is built by stretches of ``FAN ** LEVELS`` nodes, so a round climbs ``LEVELS`` levels and
two or three rounds reach the root of any table.  Every round is written to the shared folder.

Defined cases: a null value is ``-`` in the leaf; a null doc_id comes first and a null lang is a
group of its own; equal doc_ids are ordered by their leaf, equal rows give equal leaves and each
its own proof; a leaf alone in its group is the subroot, a group alone the root; an empty table
gives no rows; extra columns of documents are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corpusbank.llm.common import ascii_lower, table, text_crc32
from corpusbank.operators.ranking import range_numbers
from corpusbank.session import stage

FAN = 8  # 2 ** BITS
BITS = 3
LEVELS = 4
PART = FAN ** LEVELS  # leaves
DIGEST = 64
ROWS = 4096  # proofs handed over at once
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = ArrayType(StructType([StructField("before", StringType()),
                              StructField("after", StringType())]))


def leaf_hash(*values: Column) -> Column:
    """sha256 of all values, each ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    named = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
        for v in named]), 256)


def _digest(run: bytes) -> bytes:
    return hashlib.sha256(run).hexdigest().encode()


class Level:
    """Consecutive digests of one level: ``own`` from ``first``, known others around them."""

    def __init__(self, first: int, own: bytes, count: int, others: dict[int, bytes]):
        start = first // FAN * FAN
        last = first + len(own) // DIGEST - 1
        end = min(last // FAN * FAN + FAN, count)
        self.start, self.first, self.last = start, first, last
        self.digests = b"".join([
            *(others[k] for k in range(start, first)), own,
            *(others[k] for k in range(last + 1, end))])

    def runs(self) -> list[bytes]:
        size = FAN * DIGEST
        return [self.digests[k:k + size] for k in range(0, len(self.digests), size)]

    def above(self) -> tuple[int, bytes]:
        """(position of the first parent, digests of the parents)."""
        return self.start // FAN, b"".join(map(_digest, self.runs()))

    def around(self, position: int) -> tuple[bytes, bytes]:
        """Digests before and after a node in its run."""
        at = position - self.start
        run = at // FAN * FAN
        cut = lambda a, b: self.digests[a * DIGEST:b * DIGEST]
        return cut(run, at), cut(at + 1, run + FAN)


def height(count: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while count > 1:
        count, levels = (count + FAN - 1) // FAN, levels + 1
    return levels


def _batches(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]):
    """Tables of the rows with equal keys, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch[k].to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(),
                batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            if held and any(held[0][k][0] != piece[k][0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def _bytes_of(digests: pa.ChunkedArray) -> bytes:
    return "".join(digests.to_pylist()).encode()


_NODE = pa.schema([("grp", pa.int64()), ("level", pa.int64()), ("pos", pa.int64()),
                   ("digest", pa.string())])


def _subtrees(levels: int):
    """Nodes above stretches of consecutive nodes of one level, level by level."""
    def run(batches):
        for nodes in _batches(batches, ("grp", "block")):
            grp, base, count = (nodes[c][0].as_py() for c in ("grp", "level", "count"))
            first, own = nodes["pos"][0].as_py(), _bytes_of(nodes["digest"])
            for level in range(base + 1, base + levels + 1):
                if count <= 1:
                    break
                first, own = Level(first, own, count, {}).above()
                count = (count + FAN - 1) // FAN
                n = len(own) // DIGEST
                yield pa.record_batch([
                    pa.array(np.full(n, grp)), pa.array(np.full(n, level)),
                    pa.array(np.arange(first, first + n)),
                    pa.array([own[k:k + DIGEST].decode() for k in range(0, len(own), DIGEST)]),
                ], schema=_NODE)
    return run


def interior_nodes(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(grp, level, pos, digest) of all nodes above the leaves (grp, pos, n, digest).

    ``grp`` is a long without nulls, ``pos`` counts from 0 and ``n`` is the group's size.
    """
    spark, found = leaves.sparkSession, []
    nodes = leaves.select("grp", "pos", "digest", F.col("n").alias("count"),
                          F.lit(0).cast("long").alias("level"))
    most = leaves.agg(F.max("n")).first()[0] or 0  # one number
    tall, base = height(most), 0
    while base < tall:
        blocks = nodes.filter("count > 1").withColumn(
            "block", F.shiftright("pos", BITS * levels))
        made = stage(
            blocks.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
            .mapInArrow(_subtrees(levels), "grp long, level long, pos long, digest string"),
            "merkle-nodes")
        found.append(made)
        base += levels
        sizes = leaves.filter("pos = 0").select(
            "grp", (F.shiftright(F.col("n") - 1, BITS * base) + 1).alias("count"))
        nodes = made.filter(F.col("level") == base).join(sizes, "grp")
    if not found:
        return spark.createDataFrame([], "grp long, level long, pos long, digest string")
    return reduce(DataFrame.unionByName, found)


def missing_nodes(parts: DataFrame) -> DataFrame:
    """(grp, part, level, pos): what the proofs of parts (grp, part, first, last, n) need.

    On each level the part's own nodes span ``first >> 3 level`` to ``last >> 3 level``; its runs
    lack the nodes before the span and those behind it, up to the end of the level.
    """
    spans = (
        parts.filter("n > 1")
        .withColumn("level", F.explode(F.expr("sequence(0, 21)")))
        .withColumn("_end", F.expr("shiftright(n - 1, 3 * level)"))
        .filter("_end > 0")  # a level of one node is the subroot
        .withColumn("_low", F.expr("shiftright(first, 3 * level)"))
        .withColumn("_high", F.expr("shiftright(last, 3 * level)"))
        .withColumn("_start", F.expr("_low - _low % 8"))
        .withColumn("_stop", F.expr("least(_high - _high % 8 + 7, _end)")))
    span = lambda a, b: f"if({a} <= {b}, sequence({a}, {b}), array())"
    return spans.select(
        "grp", "part", F.col("level").cast("long"),
        F.explode(F.expr(f"concat({span('_start', '_low - 1')}, {span('_high + 1', '_stop')})"))
        .alias("pos"))


def _proofs(names: list[str], schema: pa.Schema):
    """Proofs of every part from rows sorted by part: the fetched nodes, then the leaves."""
    def run(batches):
        for rows in _batches(batches, ("grp", "part")):
            fetched = rows.filter(pa.compute.equal(rows["kind"], 0))
            leaves = rows.filter(pa.compute.equal(rows["kind"], 1))
            others: dict[int, dict[int, bytes]] = {}
            upper, root = [], None
            for r in fetched.select(["level", "pos", "digest", "root", "upper"]).to_pylist():
                if r["level"] < 0:
                    upper, root = r["upper"], r["root"]
                else:
                    others.setdefault(r["level"], {})[r["pos"]] = r["digest"].encode()
            count, at = leaves["n"][0].as_py(), leaves["pos"][0].as_py()
            own, levels = _bytes_of(leaves["digest"]), []
            for level in range(height(count)):
                levels.append(Level(at, own, count, others.get(level, {})))
                at, own = levels[-1].above()
                count = (count + FAN - 1) // FAN
            subroot = own.decode()
            yield from _laid_out(leaves, levels, upper, [subroot, root or subroot], names, schema)
    return run


def _laid_out(leaves: pa.Table, levels: list[Level], upper: list[dict], roots: list[str],
              names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The leaves with their proofs: the part's steps, picked per leaf and level by index."""
    steps, base = [], []
    for level in levels:
        base.append(len(steps) - level.first)
        steps += [level.around(k) for k in range(level.first, level.last + 1)]
    shared = np.arange(len(upper)) + len(steps)
    pairs = pa.StructArray.from_arrays([
        pa.array([x.decode() for x, _ in steps] + [u["before"] for u in upper], pa.string()),
        pa.array([x.decode() for _, x in steps] + [u["after"] for u in upper], pa.string()),
    ], names=["before", "after"])
    first = leaves["pos"][0].as_py()
    for k in range(0, leaves.num_rows, ROWS):
        n = min(ROWS, leaves.num_rows - k)
        pos = np.arange(first + k, first + k + n)
        index = np.stack([*((pos >> BITS * v) + b for v, b in enumerate(base)),
                          *(np.full(n, x) for x in shared), pos], axis=1)[:, :-1]
        proof = pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1) * index.shape[1], pa.int32()),
            pairs.take(pa.array(index.ravel(), pa.int64())))
        part = leaves.slice(k, n).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [*(part[c].chunk(0) for c in names), *(pa.array([r] * n) for r in roots), proof],
            schema=schema)


def multiproofs(leaves: DataFrame, nodes: DataFrame, upper: DataFrame | None = None,
                part: int = PART) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``proof``.

    ``leaves`` has grp (long), pos, n, digest and any payload, ``nodes`` are its interior nodes;
    a proof is, level by level, the concatenated digests before and after the node in its run.
    ``upper`` (grp, root, proof) continues the proofs from the subroot; one row goes to each part.
    """
    used = {"part", "kind", "level", "root", "upper", "subroot", "proof"} & set(leaves.columns)
    if used:
        raise ValueError(f"columns in use: {sorted(used)}")
    if part % FAN:  # parts may end inside a run of leaves
        nodes = nodes.unionByName(leaves.select(
            "grp", F.lit(0).cast("long").alias("level"), "pos", "digest"))
    dealt = leaves.withColumn("part", F.floor(F.col("pos") / part))
    parts = dealt.groupBy("grp", "part", "n").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"))
    fetched = missing_nodes(parts).join(nodes, ["grp", "level", "pos"])
    if upper is not None:
        above = upper.select("grp", "root", F.col("proof").alias("upper"))
        fetched = fetched.unionByName(
            parts.select("grp", "part", F.lit(-1).cast("long").alias("level")).join(above, "grp"),
            allowMissingColumns=True)
    else:
        fetched = fetched.withColumns({"root": F.lit(None).cast("string"),
                                       "upper": F.lit(None).cast(PROOF)})
    both = (
        dealt.withColumns({"kind": F.lit(1), "level": F.lit(0).cast("long")})
        .unionByName(fetched.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        .repartition("grp", "part").sortWithinPartitions("grp", "part", "kind", "level", "pos"))
    schema = StructType([StructField(f.name, f.dataType) for f in leaves.schema])
    for name, kind in (("subroot", StringType()), ("root", StringType()), ("proof", PROOF)):
        schema = schema.add(name, kind)
    return both.mapInArrow(_proofs(leaves.columns, to_arrow_schema(schema)), schema)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(
        F.concat(step["before"], node, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level and left to right, in one text."""
    return F.concat_ws("", F.transform(proof, lambda s: F.concat(s["before"], s["after"])))


def numbered_leaves(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``leaves`` with grp (place of their group, null first), pos in the group and its size n."""
    sizes = leaves.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    groups = stage(
        range_numbers(sizes, [], [group], "grp", "merkle-sizes")
        .select((F.col("grp") - 1).alias("grp"), F.col(group).alias("_group"), "n"),
        "merkle-groups")
    named = leaves.join(groups, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    placed = range_numbers(named, ["grp"], order, "pos", "merkle-order")
    return stage(placed.withColumn("pos", F.col("pos") - 1), "merkle-leaves")


def subroots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """The top node of every group as a leaf of the upper tree."""
    tops = (
        nodes.filter("pos = 0").groupBy("grp").agg(F.max_by("digest", "level").alias("digest"))
        .unionByName(leaves.filter("n = 1").select("grp", "digest")))
    tops = stage(tops, "merkle-subroots")
    return tops.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"),
                       F.lit(tops.count()).cast("long").alias("n"), "digest")


def manifest(leaves: DataFrame, group: str, order: list[str], part: int = PART) -> DataFrame:
    """``leaves`` (digest, ``group``, ``order``, payload) with subroot, root and ``proof`` to it."""
    placed = numbered_leaves(leaves, group, order)
    nodes = interior_nodes(placed)
    tops = subroots(placed, nodes)
    upper = stage(
        multiproofs(tops, interior_nodes(tops), part=part)
        .select(F.col("pos").alias("grp"), "root", "proof"), "merkle-upper")
    return multiproofs(placed, nodes, upper, part)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, digest, tampered): a third of the rows with their text's A-Z lower-cased."""
    row = [F.col(c) for c in LEAF_COLUMNS]
    other = leaf_hash(*row[:-1], ascii_lower(row[-1]))
    return docs.select("doc_id", "lang", leaf_hash(*row).alias("digest"),
                       F.when(text_crc32(F.col("doc_id")) % 3 == 0, other).alias("tampered"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document: leaf, subroot, root, its proof's digest, and what its tampered leaf gives."""
    leaves = stage(document_leaves(table(spark, sf_dir, "documents")), "merkle-documents")
    proved = manifest(leaves, "lang", ["doc_id", "digest"])
    return proved.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
