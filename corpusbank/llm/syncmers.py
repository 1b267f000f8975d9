"""Document fingerprints from closed syncmers of words.

A k-mer of ``K`` words is chosen if the least of its words' hashes stands at its first or last
place.  Whether it is chosen depends on its own words only, so an edit disturbs only the k-mers it
touches, and equal passages have the same anchors in any document.  A fingerprint holds all anchors
of a text with their positions.  The likeness of two fingerprints is the share of common anchors
among the distinct anchors of both; common are the most anchors that stand in the same order in
both texts, each at its first position.

Everything is array and window expressions.  For edited texts each document meets its successor:
documents are dealt into buckets of consecutive doc_ids (quantiles of the ids, cut further by
width), and only the first document of each bucket is sent to a second one; so the texts are
shuffled once.

Defined cases: a null text is an empty one; a text without words has an empty fingerprint; in a
text with fewer than ``2 * K`` words every single word is an anchor too, so that texts of fewer than
``K`` words are comparable with each other and with somewhat longer ones (of any longer text some
k-mer is chosen); a text without white space is one word; two empty fingerprints have likeness 1, an empty and another one 0; rows with one doc_id follow
each other by text; a null doc_id comes last in descending order; a single document is its own
successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbank.llm.common import WORD, table
from corpusbank.session import stage

K = 5
BUCKET_ROWS = 2_048
QUANTILES = 1_024
LEAST_ID = -(1 << 63)
STEPS = [1 << b for b in range(30, -1, -1)]  # of a binary search in any array


def _kmers(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_h``, the hashes of the words, and ``_z``, all runs of K of them."""
    hashes = F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})")), lambda w: F.xxhash64(w))
    runs = F.arrays_zip(*[
        F.slice("_h", F.lit(j + 1), F.greatest(F.size("_h") - (K - 1), F.lit(0))) for j in range(K)])
    return df.withColumn("_h", hashes).withColumn("_z", runs)


def _places(run: Column) -> list[Column]:
    return [run[str(j)] for j in range(K)]


def _chosen(run: Column) -> Column:
    words = _places(run)
    least = F.least(*words)
    return (words[0] == least) | (words[-1] == least)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def anchors(df: DataFrame, text: str = "text", name: str = "anchors") -> DataFrame:
    """Adds the anchors of a text: array of (pos, hash) by position, pos counting words from 0."""
    at = lambda pos, h: F.struct(pos.cast("int").alias("pos"), h.alias("hash"))
    marked = F.transform("_z", lambda run, i: F.when(_chosen(run), at(i, F.xxhash64(*_places(run)))))
    kept = F.filter(marked, lambda m: m.isNotNull())
    single = F.transform("_h", lambda h, i: at(i, F.xxhash64(h)))
    return _kmers(df.withColumn("_t", F.coalesce(text, F.lit(""))), "_t").withColumn("_a", kept).withColumn(
        name, F.when(F.size("_h") < 2 * K, F.sort_array(F.concat(single, "_a"))).otherwise(F.col("_a"))
    ).drop("_t", "_h", "_z", "_a")


def fingerprints(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds all anchors of a text with their positions."""
    return anchors(df, text, name)


def _longest_in_order(numbers: Column) -> Column:
    """Length of the longest subsequence that never falls."""
    def placed(tails: Column, n: Column) -> Column:
        least = F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda at, step: F.when(
            F.get(tails, at + step - 1) <= n, at + step).otherwise(at))
        return _let(least, lambda k: F.concat(
            F.slice(tails, F.lit(1), k), F.array(n),
            F.slice(tails, k + 2, F.greatest(F.size(tails) - k - 1, F.lit(0)))))

    return F.when(numbers == F.sort_array(numbers), F.size(numbers)).otherwise(
        F.size(F.aggregate(numbers, F.array().cast("array<int>"), placed)))


def likeness(a: str, b: str) -> Column:
    """Share of common anchors, in the same order, among all distinct anchors of two fingerprints."""
    of = lambda side, name: F.transform(name, lambda m: F.struct(
        m["hash"].alias("hash"), F.lit(side).alias("side"), m["pos"].alias("pos")))
    behind = lambda m: F.concat(F.array(F.lit(None).cast(
        "struct<hash:bigint,side:int,pos:int>")), F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0))))
    # By hash, then text, then position: the first of each text, beside it the other text's.
    merged = F.sort_array(F.concat(of(0, a), of(1, b)))
    firsts = _let(merged, lambda m: F.filter(F.zip_with(m, behind(m), lambda x, y: F.when(
        y.isNull() | (x["hash"] != y["hash"]) | (x["side"] != y["side"]), x)), lambda x: x.isNotNull()))
    met = lambda m: F.filter(F.zip_with(m, behind(m), lambda x, y: F.when(
        x["hash"] == y["hash"], F.struct(y["pos"].alias("a"), x["pos"].alias("b")))), lambda x: x.isNotNull())
    share = lambda m: _let(met(m), lambda c: _longest_in_order(
        F.transform(F.sort_array(c), lambda p: p["b"])) / (F.size(m) - F.size(c)))
    return _let(firsts, lambda m: F.when(F.size(m) == 0, 1.0).otherwise(share(m)))


def as_text(fingerprint: str) -> Column:
    """Every anchor as 16 hexadecimal digits of its hash and 8 of its position."""
    digits = lambda n, size: F.lpad(F.lower(F.hex(n)), size, "0")
    return F.array_join(F.transform(fingerprint, lambda m: F.concat(
        digits(m["hash"], 16), digits(m["pos"], 8))), "")


def id_buckets(ids: DataFrame, bucket_rows: int = BUCKET_ROWS) -> Column:
    """Bucket of consecutive ``_key``s, about ``bucket_rows`` rows each.

    At most ``QUANTILES`` quantiles of the keys are literals; each interval between them is cut by
    equal widths when there are more rows than that.
    """
    total = ids.count()
    parts = max(1, min(QUANTILES, -(-total // bucket_rows)))
    width = max(1, -(-total // (parts * bucket_rows)))
    found = ids.agg(F.percentile_approx("_key", [i / parts for i in range(parts + 1)], 100_000)
                    .alias("q")).first()["q"] or [0]
    bounds = sorted(set(found))
    if len(bounds) == 1:
        return F.lit(0).cast("long")
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    # Number of bounds up to the key, by binary search.
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.get(array, at + step - 1) <= F.col("_key")),
        at + step).otherwise(at))
    place = F.greatest(place - 1, F.lit(0))
    if width == 1:
        return place.cast("long")
    low, high = F.get(array, place).cast("double"), F.get(array, F.least(place + 1, F.lit(len(bounds) - 1)))
    inside = (F.col("_key").cast("double") - low) / F.greatest(high.cast("double") - low, F.lit(1.0))
    return (place * width + F.least(F.greatest(F.floor(inside * width), F.lit(0)), F.lit(width - 1))).cast("long")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
              bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, _text, _fp, _next_text, _next_fp): each document with its successor.

    The successor is the next document by descending doc_id, for the last one the first.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"),
                        F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST_ID)).alias("_key"),
                        F.coalesce(F.col(text), F.lit("")).alias("_text"))
    bucket = id_buckets(keyed.select("_key"), bucket_rows)
    firsts = stage(keyed.select("_key", bucket.alias("_bucket")).groupBy("_bucket")
                   .agg(F.max("_key").alias("_first")), "bucket-firsts")
    # One row per bucket: the bucket above takes this bucket's first document as a guest.
    above = Window.orderBy("_bucket")
    everything = Window.partitionBy(F.lit(0))
    guests = firsts.select(
        F.col("_first"), F.lead("_bucket").over(above).alias("_above"),
        F.min("_bucket").over(everything).alias("_lowest"))
    guests = guests.select("_first", F.coalesce("_above", "_lowest").alias("_to"),
                           F.col("_above").isNull().alias("_wraps"))
    homes = keyed.withColumn("_bucket", bucket)
    visits = homes.join(guests,
                        F.col("_key") == F.col("_first"), "left")
    spots = F.when(F.col("_to").isNull(), F.array(F.struct(
        F.col("_bucket").alias("b"), F.lit(0).alias("role")))).otherwise(F.array(
            F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("role")),
            F.struct(F.col("_to").alias("b"), F.when(F.col("_wraps"), 2).otherwise(1).alias("role"))))
    dealt = visits.select("doc_id", "_key", "_text", F.explode(spots).alias("_s")).select(
        "doc_id", "_key", "_text", F.col("_s.b").alias("_bucket"), F.col("_s.role").alias("_role")
    ).repartition("_bucket")
    order = Window.partitionBy("_bucket").orderBy(
        F.col("_role") == 2, F.desc("_key"), F.col("_role"), F.xxhash64("_text"), "_text")
    return fingerprints(dealt, "_text", "_fp").select(
        "doc_id", "_text", "_fp", "_role", F.lead("_text").over(order).alias("_next_text"),
        F.lead("_fp").over(order).alias("_next_fp")).filter("_role = 0").drop("_role")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited (text) and the arrays fingerprint, edited_fingerprint,
    next_fingerprint of every document."""
    pairs = with_next(docs, doc_id, text, bucket_rows).withColumn("n_chars", F.length("_text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), (F.col("n_chars") - cut).cast("int")),
                      F.substring(F.col("_next_text"), F.lit(1), cut))
    return fingerprints(pairs.withColumn("edited", edited), "edited", "edited_fingerprint").select(
        "doc_id", "n_chars", "edited", F.col("_fp").alias("fingerprint"), "edited_fingerprint",
        F.col("_next_fp").alias("next_fingerprint"))


def op5_closed_syncmers(spark, sf_dir: str) -> DataFrame:
    """All documents: fingerprints of the text and its edited text, and likenesses."""
    found = edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text("fingerprint").alias("fingerprint"),
        as_text("edited_fingerprint").alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"))
