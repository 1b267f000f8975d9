"""Approximate nearest neighbours: one navigable small-world graph per shard, results merged.

Vectors are dealt into shards of about ``SHARD_ROWS`` rows by a hash of their id.  In a shard equal
vectors share one node.  Nodes get a random level; on every level a node keeps at most ``LINKS``
neighbours (twice as many on the lowest level) in a flat array.  Nodes enter in growing batches:
a batch searches the graph so far, links to neighbours that are not closer to each other than to
the node, and is linked back.  Inner products become distances by one more coordinate, the root of
what is missing to the largest square norm of the shard.

Searching, all queries of a block walk the levels of a shard together, with ``WIDTH`` candidates
each on the lowest level.  The pairs (shard, block of queries) are independent tasks, each of which
holds one graph and one block; every shard gives its best ``k`` per query, and the best of those
are kept.  Index and queries are written to the shared folder in between.

Scores are inner products of the original vectors in double precision, added up in one order, so
equal vectors score equally.  Ties go to the smaller id.

Defined cases: a null id, and vectors that are null, zero or hold null or non-finite components,
take no part; so do vectors whose length differs from the most frequent length (of several, the
least); of rows with one id the vector that sorts first counts; a query never finds its own id;
with fewer than k candidates all are returned; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusbank.llm.common import table
from corpusbank.session import stage

SHARD_ROWS = 8_192
QUERY_BLOCK = 4_096
LINKS = 16
BUILD_WIDTH = 64
WIDTH = 200
K = 20


class Graph:
    """Vectors, levels and flat neighbour arrays (-1: none) of one shard."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors  # with the extra coordinate
        n = len(vectors)
        rng = np.random.default_rng(11)
        level = (-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
        # The highest node comes first and is the entry; then any order.
        self.order = np.concatenate([[level.argmax()], np.setdiff1d(rng.permutation(n), [level.argmax()], True)]) if n else []
        self.level = level
        self.links = [np.full((n, LINKS * (2 if h == 0 else 1)), -1, dtype=np.int32)
                      for h in range((level.max() if n else 0) + 1)]
        self._build()

    def _distances(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Negative inner products of query i with the nodes in row i."""
        return -np.einsum("qd,qkd->qk", queries, self.vectors[nodes])

    def walk(self, queries: np.ndarray, entry: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found on a level per query, nearest first: (nodes, distances).

        Every round each query that can still improve expands its nearest unexpanded candidate.
        """
        q, links = len(queries), self.links[height]
        nodes = np.full((q, width), -1, dtype=np.int64)
        far = np.full((q, width), np.inf)
        opened = np.ones((q, width), dtype=bool)
        seen = np.zeros((q, len(self.vectors)), dtype=bool)
        nodes[:, 0], opened[:, 0] = entry, False
        far[:, 0] = self._distances(queries, entry[:, None])[:, 0]
        seen[np.arange(q), entry] = True
        active = np.arange(q)
        while len(active):
            unopened = ~opened[active]
            some = unopened.any(axis=1)
            active = active[some]
            if not len(active):
                break
            at = unopened[some].argmax(axis=1)  # rows are sorted: the first is the nearest
            opened[active, at] = True
            near = links[nodes[active, at]]
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            rows, columns = np.nonzero(fresh)
            if not len(rows):
                continue
            found = near[rows, columns]
            seen[active[rows], found] = True
            d = np.full(near.shape, np.inf)
            d[rows, columns] = -np.einsum("nd,nd->n", queries[active[rows]], self.vectors[found])
            better = (d < far[active, -1][:, None]).any(axis=1)
            if not better.any():
                continue
            a, near, d = active[better], near[better], d[better]
            all_far = np.concatenate([far[a], d], axis=1)
            keep = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            far[a] = np.take_along_axis(all_far, keep, 1)
            nodes[a] = np.take_along_axis(np.concatenate([nodes[a], near], axis=1), keep, 1)
            opened[a] = np.take_along_axis(
                np.concatenate([opened[a], np.isinf(d)], axis=1), keep, 1)
        return nodes, far

    def _descend(self, queries: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Entry on level ``stop`` per query, from the top by single steps."""
        at = np.full(len(queries), self.order[0])
        for height in range(len(self.links) - 1, 0, -1):
            go = np.flatnonzero(stop < height)
            if len(go):
                at[go] = self.walk(queries[go], at[go], height, 1)[0][:, 0]
        return at

    def _spread(self, center: np.ndarray, nodes: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """At most ``most`` of each row's nodes (nearest first), none closer to a chosen one than
        to the center; places left over go to the nearest of the rest."""
        q, width = nodes.shape
        vectors = self.vectors[np.maximum(nodes, 0)]
        chosen = np.zeros((q, width), dtype=bool)
        covered = np.full((q, width), np.inf)  # distance to the nearest chosen node
        valid = (nodes >= 0) & np.isfinite(far)
        for k in range(width):
            take = valid[:, k] & (covered[:, k] > far[:, k]) & (chosen.sum(axis=1) < most)
            if take.any():
                chosen[take, k] = True
                to = -np.einsum("qd,qkd->qk", vectors[take, k], vectors[take])
                covered[take] = np.minimum(covered[take], to)
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * width + np.arange(width)
        first = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(nodes, first, 1)
        out[~np.take_along_axis(valid, first, 1)] = -1
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def _link(self, height: int, new: np.ndarray, nodes: np.ndarray, far: np.ndarray) -> None:
        links = self.links[height]
        most = links.shape[1]
        chosen = self._spread(new, nodes, far, min(LINKS, most))
        links[new, :chosen.shape[1]] = chosen
        source, column = np.nonzero(chosen >= 0)
        target, back = chosen[source, column], new[source]
        order = np.argsort(target, kind="stable")
        target, back = target[order], back[order]
        changed, start, count = np.unique(target, return_index=True, return_counts=True)
        slot = np.arange(len(target)) - np.repeat(start, count)
        pool = np.full((len(changed), int(count.max()) if len(count) else 0), -1, dtype=np.int64)
        pool[np.repeat(np.arange(len(changed)), count), slot] = back
        for part in np.array_split(np.arange(len(changed)), max(1, len(changed) // 512)):
            if not len(part):
                continue
            both = np.concatenate([links[changed[part]], pool[part]], axis=1)
            d = np.where(both >= 0, self._distances(self.vectors[changed[part]], np.maximum(both, 0)), np.inf)
            order = np.argsort(d, axis=1, kind="stable")
            both, d = np.take_along_axis(both, order, 1), np.take_along_axis(d, order, 1)
            full = (both >= 0).sum(axis=1) > most
            new_links = np.where(np.isfinite(d), both, -1)[:, :most]
            if full.any():
                new_links[full] = self._spread(changed[part][full], both[full], d[full], most)
            links[changed[part]] = new_links

    def _build(self) -> None:
        n, done = len(self.vectors), 1
        while done < n:
            batch = self.order[done:done + min(max(done // 4, 1), 512)]
            batch = np.asarray(batch)
            top = len(self.links) - 1
            at = self._descend(self.vectors[batch], self.level[batch])
            for height in range(top, -1, -1):
                on = np.flatnonzero(self.level[batch] >= height)
                if len(on):
                    nodes, far = self.walk(self.vectors[batch[on]], at[on], height, BUILD_WIDTH)
                    at[on] = nodes[:, 0]
                    self._link(height, batch[on], nodes, far)
            done += len(batch)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        """(queries, width) nodes, nearest first, -1 where there are fewer."""
        at = self._descend(queries, np.zeros(len(queries), dtype=int))
        return self.walk(queries, at, 0, width)[0]


def _augmented(vectors: np.ndarray) -> np.ndarray:
    square = (vectors ** 2).sum(axis=1)
    return np.hstack([vectors, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]])


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                 graph: Graph, member: np.ndarray, k: int, width: int = WIDTH):
    """(query_id, vec_id, score) of each query's best k in one shard.

    ``member`` gives the node of every row; nodes hold the rows' ids in ascending order.
    """
    order = np.lexsort((ids, member))
    begin = np.searchsorted(member[order], np.arange(len(graph.vectors) + 1))
    flat = np.hstack([queries, np.zeros((len(queries), 1))])
    out = []
    for part in np.array_split(np.arange(len(queries)), max(1, len(queries) // 256)):
        nodes = graph.search(flat[part], min(max(width, k + 1), len(graph.vectors)))
        for q, found in zip(part.tolist(), nodes):
            found = found[found >= 0]
            count = np.minimum(begin[found + 1] - begin[found], k + 1)
            rows = order[np.repeat(begin[found], count) + np.arange(count.sum())
                         - np.repeat(np.cumsum(count) - count, count)]
            rows = rows[ids[rows] != query_ids[q]]
            score = (vectors[rows] * queries[q]).sum(axis=1)
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(best), query_ids[q]), ids[rows][best], score[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 3


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(_id, _v): one row per id, double precision, of the prevailing length."""
    v = F.col("_v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("_id"),
                          F.col(embedding).cast("array<double>").alias("_v")).filter(
        F.col("_id").isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = lengths["n"] if lengths else 0
    return rows.filter(F.size("_v") == size).groupBy("_id").agg(F.min("_v").alias("_v"))


def nearest(vectors: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding",
            k: int = K, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK,
            width: int = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query``
    (a condition on the column ``_id``) holds."""
    rows = stage(usable(vectors, vec_id, embedding), "vectors")
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    queries = rows.filter(is_query)
    blocks = max(1, -(-queries.count() // query_block))

    def build(group):
        ids = group.column("_id").to_numpy()
        flat = group.column("_v").combine_chunks().flatten().to_numpy()
        own = flat.reshape(len(ids), -1)
        nodes, member = np.unique(own, axis=0, return_inverse=True)
        graph = Graph(_augmented(nodes))
        links = [l.astype("<i4").tobytes() for l in graph.links]
        return pa.table({"shard": group.column("_shard")[:1], "ids": pa.array([ids]),
                         "vectors": pa.array([own.astype("<f8").tobytes()], pa.binary()),
                         "nodes": pa.array([graph.vectors.astype("<f8").tobytes()], pa.binary()),
                         "member": pa.array([member.ravel().astype(np.int32)]),
                         "first": pa.array([int(graph.order[0])], pa.int32()),
                         "links": pa.array([links], pa.list_(pa.binary()))})

    index = stage(
        rows.withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int"))
        .groupBy("_shard").applyInArrow(
            build, "shard int, ids array<long>, vectors binary, nodes binary, member array<int>, "
                   "first int, links array<binary>"), "hnsw")

    def run(key, left, right):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                          "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        row = left.slice(0, 1).to_pylist()[0]
        ids = np.array(row["ids"], dtype=np.int64)
        graph = Graph.__new__(Graph)
        own = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
        graph.vectors = np.frombuffer(row["nodes"], "<f8").reshape(-1, own.shape[1] + 1)
        graph.links = [np.frombuffer(b, "<i4").reshape(len(graph.vectors), -1) for b in row["links"]]
        graph.order = [row["first"]]
        query_ids = right.column("_id").to_numpy()
        flat = right.column("_v").combine_chunks().flatten().to_numpy().reshape(len(query_ids), -1)
        found = search_shard(ids, own, query_ids, flat, graph,
                             np.array(row["member"], dtype=np.int64), k, width)
        return pa.table({"query_id": pa.array(found[0].astype(np.int64)),
                         "vec_id": pa.array(found[1].astype(np.int64)),
                         "score": pa.array(found[2].astype(np.float64))})

    all_blocks = F.sequence(F.lit(0), F.lit(blocks - 1))
    asked = queries.select(
        "_id", "_v", F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    graphs = index.withColumn("block", F.explode(all_blocks))
    found = graphs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(
        run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_hnsw_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20, among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0)
