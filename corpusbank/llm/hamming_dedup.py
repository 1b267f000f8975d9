"""MinHash near-duplicates by a multi-index Hamming join.

Every text becomes the set of its distinct word shingles and a signature of 64 min-hashes, 8 bits
each.  Texts with equal sets form a class; only one row per class goes on.  Signatures are split
into ``CHUNKS`` chunks; a chunk may differ in ``ERRORS`` positions, so each choice of positions to
leave out gives one key.  By the pigeonhole principle two signatures that differ in at most
``CHUNKS * (ERRORS + 1) - 1`` positions share a key: 21 of 64, which a pair of similarity 0.8
(expected distance 12.8, deviation 3.2) exceeds in fewer than one case in 200.

Copies of one text are never paired with each other.  In every bucket of a key one member leads;
in a first round the others are compared with it only, pairs up to ``FARTHEST`` positions apart are
confirmed on the full sets and joined to components.  Buckets that still hold several components get
other leaders in a second round: at most 64 comparisons per text and round.  In the last round
members of buckets of at most ``FEW`` are compared with each other.  Of larger buckets, a pivot is the
component that most members have; every member is described by what its set has more and less than
the pivot's.  Let ``a`` shingles be less and ``b`` more, the pivot have ``n``, and the similarity be
p %: two members are similar if and only if they share at least
``(100 a + p b + 100 a' + p b' - (100 - p) n) / (100 + p)`` of these differences.  Members for which
``100 a + p b <= (100 - p) n`` are similar to the pivot, so in a pair still to be found one exceeds
that; hence such a pair has to share a difference in a prefix of each.  Differences that no
other member has make no pair, so texts that are each just below the similarity to all others are
mostly compared with the pivot only (a test family of 2,600 such texts: 151,000 of 3.4 million pairs
over all rounds).  The filter is exact and has no cap; what passes it is confirmed on the full sets.

Missed is a similar pair only if its signatures share no key, or if they are more than ``FARTHEST``
positions apart (a large bucket's prefixes do not ask for that): 1 in 100,000 pairs at similarity 0.8.

Shuffled are 64 keys per class, the signatures of candidate pairs, and in each round the sets of the
documents in a candidate pair, rebuilt from their texts; sets of documents in many pairs are copied
once per ``FAN`` pairs, so that no task gets all pairs of a leader.

Defined cases: without words or with a null text a document has an empty set and is linked with
nothing; fewer words than a shingle form one shingle; a repeated row gets a row of its own; a
doc_id repeated with other texts joins the components of its texts, so that it is kept or removed as
a whole, save rows without words, which stay; of the rows of a kept doc_id one stays; without doc_id a document is linked with
nothing, has no component and is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbank.llm.bpe import text_slices
from corpusbank.llm.common import WORD, table
from corpusbank.llm.words import mix, shingle_hashes
from corpusbank.session import stage

POSITIONS = 64
CHUNKS = 11
ERRORS = 1
FARTHEST = 28  # positions; pairs that share a key are confirmed up to this distance
LEADERS = (1, 8)  # orders of leaders in the rounds before the last one
FEW = 16  # members of a bucket that are compared with each other
COMMON = 16  # a difference is common when one in so many members of a pivot has it
FAN = 256  # pairs for which one copy of a set is shuffled
BATCH_BYTES = 2_000_000
SIGNATURE = [f"_s{w}" for w in range(POSITIONS // 8)]
LOW_BITS = 0x0101010101010101


def signatures(shingles: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(texts, 64) bytes: 8 bits of the least hash of each text's shingles; texts begin at ``start``."""
    out = np.empty((len(start), POSITIONS), dtype=np.uint8)
    seeds = mix(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64))
    for j in range(POSITIONS):
        hashed = (shingles ^ seeds[2 * j]) * (seeds[2 * j + 1] | np.uint64(1))
        out[:, j] = mix(np.minimum.reduceat(hashed, start)) & np.uint64(255)
    return out


def _sets(texts: list[str], k: int) -> list[np.ndarray]:
    shingles, numbers = shingle_hashes(texts, k)
    return [np.unique(s) for s in np.split(shingles, np.cumsum(numbers)[:-1])] if texts else []


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """_id, n_shingles, digest of the set (_d0, _d1) and signature (_s0 .. _s7) per row."""
    names = ["n_shingles", "_d0", "_d1", *SIGNATURE]

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "_text", BATCH_BYTES):
                sets = _sets(texts, words)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                columns = np.zeros((len(sets), len(names)), dtype=np.int64)
                columns[:, 0] = size
                full = np.flatnonzero(size)
                if len(full):
                    flat = np.concatenate(sets)
                    start = (np.cumsum(size) - size)[full]
                    columns[full, 1] = np.add.reduceat(mix(flat), start).view(np.int64)
                    columns[full, 2] = np.add.reduceat(mix(flat ^ np.uint64(POSITIONS)), start).view(np.int64)
                    columns[full, 3:] = signatures(flat, start).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, columns.T.copy())], names=["_id", *names])

    return docs.mapInArrow(run, "_id long, " + ", ".join(f"{n} long" for n in names))


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """_id and the sorted hashes of its distinct shingles."""
    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "_text", BATCH_BYTES):
                sets = [s.view(np.int64) for s in _sets(texts, words)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["_id", "_set"])

    return docs.mapInArrow(run, "_id long, _set array<long>")


def signature_keys(chunks: int = CHUNKS, errors: int = ERRORS) -> Column:
    """All keys of a signature: every chunk without every choice of ``errors`` positions."""
    keys = []
    for c, chunk in enumerate(np.array_split(np.arange(POSITIONS), chunks)):
        for k, left_out in enumerate(combinations(chunk.tolist(), min(errors, len(chunk) - 1))):
            masks: dict[int, int] = {}
            for p in set(chunk.tolist()) - set(left_out):
                masks[p // 8] = masks.get(p // 8, 0) | 255 << 8 * (p % 8)
            parts = [F.col(SIGNATURE[w]).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))
                     for w, m in sorted(masks.items())]
            keys.append(F.xxhash64(F.lit(c), F.lit(k), *parts))
    return F.array(*keys)


def differing(a: str, b: str) -> list[Column]:
    """Per 8 positions a number with the lowest bit of every byte that differs."""
    out = []
    for name in SIGNATURE:
        x = F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}"))
        for shift in (4, 2, 1):  # any set bit of a byte reaches its lowest bit
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        out.append(x.bitwiseAND(F.lit(LOW_BITS)))
    return out


def distance(a: str, b: str) -> Column:
    """Number of positions in which the signatures of the aliases ``a`` and ``b`` differ."""
    return reduce(Column.__add__, map(F.bit_count, differing(a, b)))


def near(a: str, b: str, percent: int) -> Column:
    """Within the distance that similar texts keep, and of sizes that allow the similarity."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (
        distance(a, b) <= FARTHEST)


def first_shared_slot(a: str, b: str, chunks: int, errors: int) -> Column:
    """Of the keys that two signatures share, is the key in column ``a._slot`` the first?

    It lies in the first chunk that differs in at most ``errors`` positions.  With one error, a
    chunk with a difference shares one key, a chunk without any shares all: the first counts.
    """
    differs = differing(a, b)
    slot, first, start = F.col(f"{a}._slot"), F.lit(False), 0
    for chunk in reversed(list(np.array_split(np.arange(POSITIONS), chunks))):
        masks: dict[int, int] = {}
        for p in chunk.tolist():
            masks[p // 8] = masks.get(p // 8, 0) | 1 << 8 * (p % 8)
        d = reduce(Column.__add__, [F.bit_count(differs[w].bitwiseAND(F.lit(m)))
                                    for w, m in masks.items()])
        low, high = slots_of(chunk, chunks, errors)
        here = slot.between(low, high - 1)
        first = F.when(d == 0, slot == low).when(d <= errors, here).otherwise(first)
    return first


def slots_of(chunk: np.ndarray, chunks: int, errors: int) -> tuple[int, int]:
    """Range of the places of a chunk's keys among all keys of a signature."""
    low = 0
    for other in np.array_split(np.arange(POSITIONS), chunks):
        number = comb(len(other), min(errors, len(other) - 1))
        if other[0] == chunk[0]:
            return low, low + number
        low += number
    raise ValueError("no such chunk")


def sets_of(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The staged sets of the documents in ``ids`` (_id).

    The texts are fetched by a sort-merge join at every size, so that the plan does not change when
    the list of documents outgrows a broadcast.
    """
    wanted = ids.distinct().hint("merge")
    return stage(shingle_sets(docs.join(wanted, "_id", "left_semi").select("_id", "_text"), words),
                 "near-sets")


def both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("_a", "_b")).alias("_id"))


def beside(rows: DataFrame, values: DataFrame, key: str, other: str) -> DataFrame:
    """Rows joined with ``values``, which holds one row per ``key``.

    A key of many rows has its value copied once per ``FAN`` rows, and its rows dealt out to the
    copies by the column ``other``, so that they meet in as many tasks.
    """
    copies = stage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > FAN)
                   .select(key, F.ceil(F.col("_c") / FAN).cast("int").alias("_copies")), "copies")
    number = F.coalesce("_copies", F.lit(1))
    dealt = values.join(copies, key, "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), number - 1))).drop("_copies")
    return rows.join(copies, key, "left").withColumn(
        "_copy", F.pmod(F.xxhash64(other), number).cast("int")).drop("_copies").join(
        dealt, [key, "_copy"]).drop("_copy")


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The staged pairs (_a, _b) with the sets _set_a and _set_b."""
    for side, other in (("_a", "_b"), ("_b", "_a")):
        own = sets.withColumnRenamed("_id", side).withColumnRenamed("_set", f"_set{side}")
        pairs = beside(pairs, own, side, other)
    return pairs


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the staged pairs (_a, _b) whose full sets are similar by ``percent`` or more."""
    common = F.size(F.array_intersect("_set_a", "_set_b"))
    either = F.size("_set_a") + F.size("_set_b") - common
    return stage(with_sets(pairs, sets).filter(100 * common >= percent * either)
                 .select("_a", "_b").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(_id, _root) for every node of the edges (_a, _b): the least node that it reaches.

    Large and small stars alternate: nodes link to the least node nearby, so that paths shorten
    quickly; each round is aggregated before it is joined and is written to the shared folder.
    """
    edges = stage(edges.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v"))
                  .filter("_u <> _v").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("_u").alias("_id"), F.col("_v").alias("_root"))
        before = now
        both = edges.union(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.min("_v").alias("_m")).select(
            "_u", F.least("_u", "_m").alias("_m"))
        large = both.join(least, "_u").filter("_v > _u").select(
            F.col("_v").alias("_u"), F.col("_m").alias("_v")).distinct()
        lowest = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = large.join(lowest, "_u").filter("_v <> _m").select(
            F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        edges = stage(small.union(lowest.select("_u", F.col("_m").alias("_v"))).distinct(), "edges")


def led_pairs(buckets: DataFrame, orders: int) -> DataFrame:
    """(_a, _b): every member of a bucket with the bucket's leader, unless they have one root.

    The leader is the least member in one of ``orders`` orders, which the key picks; so members
    that meet in many buckets meet ``orders`` leaders, not one per bucket.
    """
    order = F.pmod("_key", F.lit(orders))
    rank = F.col("_id") if orders == 1 else F.xxhash64("_id", order)
    leaders = buckets.groupBy("_key").agg(F.min(F.struct(rank.alias("_r"), "_id", "_root")).alias("_l"))
    return buckets.join(leaders, "_key").filter("_root <> _l._root").select(
        F.least("_id", "_l._id").alias("_a"), F.greatest("_id", "_l._id").alias("_b")).distinct()


def still_open(buckets: DataFrame, linked: DataFrame) -> DataFrame:
    """Members, with their roots, of the buckets that hold more than one root."""
    rooted = buckets.join(linked, "_id", "left").withColumn("_root", F.coalesce("_root", "_id"))
    mixed = rooted.groupBy("_key").agg(F.min("_root").alias("_x"), F.max("_root").alias("_y"))
    return rooted.join(mixed.filter("_x <> _y").select("_key"), "_key", "left_semi")


def bucket_pivots(buckets: DataFrame) -> DataFrame:
    """_key, the number of members, and the pivot: the root that most of them have."""
    roots = buckets.groupBy("_key", "_root").agg(F.count(F.lit(1)).alias("_n"))
    return roots.groupBy("_key").agg(
        F.sum("_n").alias("_members"), F.min(F.struct(-F.col("_n"), "_root")).alias("_m")).select(
        "_key", "_members", F.col("_m._root").alias("_pivot"))


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """From staged members (_a: pivot, _b: document, _root): links to pivots, and pairs to confirm.

    Differences are ordered: a document's own ones, what it lacks of the pivot, and last, by their
    number, what many have in common (``COMMON``; where the pivot is the odd one out).  With ``_w`` as 100 + percent
    times the number of differences that ``_b`` has to share with whatever is not similar to the
    pivot, and ``_over`` that with whatever is, a common difference of a similar pair lies at a place
    with more than ``_over`` left in the first, more than ``_w`` in the second.
    """
    whole = 100 + percent
    deltas = stage(with_sets(members, sets).select(
        "_a", "_b", "_root", F.array_except("_set_b", "_set_a").alias("_more"),
        F.array_except("_set_a", "_set_b").alias("_less"), F.size("_set_a").cast("long").alias("_n"))
        .withColumn("_w", (100 * F.size("_less") + percent * F.size("_more")).cast("long"))
        .withColumn("_over", F.col("_w") - (100 - percent) * F.col("_n")), "deltas")
    every = F.concat("_more", "_less")
    totals = deltas.groupBy("_a").agg(F.count(F.lit(1)).alias("_total"))
    counted = beside(deltas, totals, "_a", "_b").select(
        "_a", "_total", F.explode(every).alias("_f")).groupBy("_a", "_total", "_f").count()
    common = totals.select("_a").join(  # at most COMMON times the mean number of differences
        counted.filter(F.col("count") * COMMON >= F.col("_total")).groupBy("_a").agg(
            F.sort_array(F.collect_list(F.struct("count", "_f"))).alias("_common")), "_a", "left").select(
        "_a", F.coalesce("_common._f", F.array().cast("array<long>")).alias("_common"))
    deltas = stage(beside(deltas, stage(common, "common"), "_a", "_b").select(
        "_a", "_b", "_root", "_w", "_over", F.concat(
            F.array_except("_more", "_common"), F.array_except("_less", "_common"),
            F.array_intersect("_common", every)).alias("_f")), "ordered")

    def prefix(rows: DataFrame, least: str) -> DataFrame:
        kept = F.size("_f") - F.floor(F.col(least) / whole).cast("int")
        return rows.filter(kept > 0).select(
            F.col("_a").alias("_pivot"), F.col("_b").alias("_id"), "_root", "_w", "_over",
            F.size("_f").alias("_size"), F.posexplode(F.slice("_f", F.lit(1), kept)).alias("_at", "_f"))

    x = prefix(deltas.filter("_over > 0"), "_over").alias("x")
    y = prefix(deltas, "_w").alias("y")
    left = F.least(F.col("x._size") - F.col("x._at"), F.col("y._size") - F.col("y._at"))
    met = ((F.col("x._pivot") == F.col("y._pivot")) & (F.col("x._f") == F.col("y._f"))
           & (F.col("x._root") != F.col("y._root"))
           & (whole * left >= F.col("x._over") + F.col("y._w")))
    pairs = x.join(y, met).select(
        F.least("x._id", "y._id").alias("_a"), F.greatest("x._id", "y._id").alias("_b")).distinct()
    return deltas.filter("_over <= 0").select("_a", "_b"), pairs


def repeated_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(_a, _b): the class of each row whose doc_id has several sets, with that doc_id."""
    same = ["_d0", "_d1", "n_shingles"]
    several = rows.filter("n_shingles > 0 AND _id IS NOT NULL").groupBy("_id").agg(
        F.min(F.struct(*same)).alias("_x"), F.max(F.struct(*same)).alias("_y")).filter("_x <> _y")
    members = rows.join(several.select("_id"), "_id", "left_semi").select(F.col("_id").alias("_b"), *same)
    return stage(members.join(classes.select(F.col("_id").alias("_a"), *same), same)
                 .select("_a", "_b").filter("_a <> _b").distinct(), "repeated-ids")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5,
                    percent: int = 80, chunks: int = CHUNKS, errors: int = ERRORS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = stage(sketches(docs, words), "sketches")
    same = ["_d0", "_d1", "n_shingles"]
    classes = stage(
        rows.filter("n_shingles > 0 AND _id IS NOT NULL").groupBy(*same)
        .agg(F.min("_id").alias("_id"), *[F.first(s).alias(s) for s in SIGNATURE]), "classes")
    signed = classes.select("_id", "n_shingles", *SIGNATURE)
    rule = near("x", "y", percent)

    keyed = classes.select("_id", F.posexplode(signature_keys(chunks, errors)).alias("_slot", "_key"))
    shared = keyed.groupBy("_key").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"))
    buckets = stage(keyed.join(shared.filter("_least <> _most"), "_key")
                    .select("_key", "_slot", "_id"), "buckets")
    open_ = buckets.withColumn("_root", F.col("_id"))
    links, tried = repeated_ids(rows, classes), None
    for orders in LEADERS:
        pairs = led_pairs(open_, orders)
        pairs = (pairs.join(signed.alias("x"), F.col("_a") == F.col("x._id"))
                 .join(signed.alias("y"), F.col("_b") == F.col("y._id")).filter(rule)
                 .select("_a", "_b").distinct())
        if tried is not None:
            pairs = pairs.join(tried, ["_a", "_b"], "left_anti")
        pairs = stage(pairs, "near-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = confirmed(pairs, sets_of(both_ends(pairs), docs, words), percent)
        linked = components(links.union(found))
        links = linked.select(F.col("_root").alias("_a"), F.col("_id").alias("_b"))
        open_ = stage(still_open(buckets, linked), "open-buckets")

    pivots = stage(bucket_pivots(open_), "pivots")
    few = stage(open_.join(pivots.filter(F.col("_members") <= FEW), "_key").join(signed, "_id"), "few")
    x, y = few.alias("x"), few.alias("y")
    met = ((F.col("x._key") == F.col("y._key")) & (F.col("x._id") < F.col("y._id"))
           & (F.col("x._root") != F.col("y._root")) & rule
           & first_shared_slot("x", "y", chunks, errors))
    direct = stage(x.join(y, met).select(F.col("x._id").alias("_a"), F.col("y._id").alias("_b"))
                   .distinct().join(tried, ["_a", "_b"], "left_anti"), "near-pairs")
    members = stage(open_.join(pivots.filter(F.col("_members") > FEW), "_key")
                    .filter("_id <> _pivot").select(F.col("_pivot").alias("_a"), F.col("_id").alias("_b"),
                                                    "_root").distinct(), "members")
    sets = sets_of(both_ends(direct).union(both_ends(members)), docs, words)
    to_pivots, further = prefix_pairs(members, sets, percent)
    pairs = stage(direct.union(further.join(tried, ["_a", "_b"], "left_anti")).distinct(), "near-pairs")
    linked = components(links.union(to_pivots).union(confirmed(pairs, sets, percent)))

    named = classes.select(*same, F.col("_id").alias("_class")).join(
        linked.withColumnRenamed("_id", "_class"), "_class", "left")
    return rows.join(named, same, "left").select(
        F.col("_id").alias("doc_id"), "n_shingles",
        F.when(F.col("_id").isNotNull(), F.coalesce("_root", "_class", "_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                            words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document, the least doc_id, of every component.

    Of several rows of a doc_id with words, and of several without, the first by digest stays.
    """
    found = stage(near_duplicates(docs, doc_id, text, words, percent), "kept")
    gone = found.filter("NOT kept").select(F.col("doc_id").alias(doc_id)).distinct()
    repeated = stage(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
                     .select(F.col("doc_id").alias(doc_id)), "repeated")
    if repeated.isEmpty():
        return docs.join(gone, doc_id, "left_anti")
    key = [doc_id, "_worded"]
    marked = docs.withColumn("_worded", F.coalesce(text, F.lit("")).rlike(WORD))
    stay = marked.join(gone.withColumn("_worded", F.lit(True)), key, "left_anti")
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = stay.join(repeated, doc_id, "left_semi").groupBy(*key).agg(
        F.min_by(row, F.struct(F.xxhash64(text), F.sha2(F.to_json(row), 256))).alias("_row"))
    return stay.join(repeated, doc_id, "left_anti").select(*docs.columns).unionByName(
        one.select("_row.*"))


def op7_hamming_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: two-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
