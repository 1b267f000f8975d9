"""BM25 retrieval for many queries at once, with exact pruning by score upper bounds.

The tokens of a document stay in its row as an array of (tok, tf); the postings of a block's
vocabulary are unpacked from it without a shuffle.  The queries are taken in blocks of about
``BLOCK`` terms, so what a block broadcasts (its vocabulary, weights and candidates) is bounded by
construction.  Per token of a block the frequency and the greatest contribution are known.  A few
documents with a query's rarest tokens are scored first; the k-th best is a threshold that the
first k reach.  The tokens whose greatest contributions together stay below it cannot lift a
document there: only documents with one of the other, *essential* tokens are considered, and only
those scored in full whose essential tokens and the bound of the rest reach the threshold.

The one exchange before the top k brings the block's postings of a document together; scores are complete in the task, and the top k sends at most k rows per query and task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbank.constants import BM25_B, BM25_K1, CANDIDATES, STOP_WORDS
from corpusbank.functions.text import strip, tokens
from corpusbank.operators.ranking import top_k
from corpusbank.session import stage

_RUN = r"([a-z0-9]+)(?: \1(?![a-z0-9]))*+"  # a token and its repeats; possessive, no recursion
BLOCK = 200_000  # query terms broadcast at once
BUCKETS = 64  # partitions of a stored index
SEEDS = 4  # tokens of a query that give the documents of its threshold
REST = 0.25  # share of the threshold that the tokens left aside may add up to
MARGIN = 1e-5  # more than rounding to six digits and sums in another order can change


def document_terms(corpus: DataFrame, doc_id: str, text: str, part: list[str] | None = None,
                   stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(part.., doc_id, dl, terms): the row's distinct tokens with their frequencies, no shuffle.

    Equal tokens are neighbours once sorted, so one pass of a back-reference over the joined
    text yields each run; its length gives the frequency.
    """
    part = part or []
    listed = corpus.select(
        *part, doc_id, F.sort_array(tokens(F.col(text), stop_words)).alias("toks"))
    runs = F.regexp_extract_all(F.array_join("toks", " "), F.lit(_RUN), F.lit(0))

    def counted(run: Column) -> Column:
        tok = F.substring_index(run, " ", 1)
        return F.struct(tok.alias("tok"), ((F.length(run) + 1) / (F.length(tok) + 1))
                        .cast("int").alias("tf"))

    return listed.select(
        *part, doc_id, F.size("toks").alias("dl"), F.transform(runs, counted).alias("terms"))


def corpus_stats(docs: DataFrame, part: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per part: n, avgdl) and (per part and token: df) of :func:`document_terms`."""
    part = part or []
    stats = docs.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = (
        docs.select(*part, F.explode("terms.tok").alias("tok")).groupBy(*part, "tok")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    return stats, df


def query_terms(queries: DataFrame, query_id: str, text: str, part: list[str] | None = None,
                stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(part.., query_id, tok): distinct tokens of each query."""
    return queries.select(
        *(part or []), query_id,
        F.explode(F.array_distinct(tokens(F.col(text), stop_words))).alias("tok"),
    )


def _gain(idf: Column, k1: float, b: float) -> Column:
    """What a token adds to a document's score."""
    tf, dl, mean = F.col("tf"), F.col("dl"), F.col("mean_dl")
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


def block_postings(docs: DataFrame, terms: DataFrame, doc_id: str,
                   part: list[str] | None = None) -> DataFrame:
    """(part.., doc_id, dl, tok, tf, first) of the block's vocabulary, staged; no shuffle.

    One row of each document is marked as its first and kept in any case, for the statistics;
    its ``tok`` is null when the block does not ask for it.
    """
    part = part or []
    block = F.broadcast(terms.select(*part, "tok").distinct().withColumn("_asked", F.lit(True)))
    rows = docs.select(*part, doc_id, "dl", F.posexplode_outer("terms").alias("_at", "_term"))
    rows = rows.select(*part, doc_id, "dl", F.col("_term.tok").alias("tok"),
                       F.col("_term.tf").alias("tf"),
                       (F.coalesce("_at", F.lit(0)) == 0).alias("first"))
    asked = F.col("_asked").isNotNull()
    return stage(
        rows.join(block, [*part, "tok"], "left").filter(asked | F.col("first"))
        .select(*part, doc_id, "dl", F.when(asked, F.col("tok")).alias("tok"), "tf", "first"),
        "bm25-postings")


def query_weights(posts: DataFrame, terms: DataFrame, part: list[str] | None = None,
                  k1: float = BM25_K1, b: float = BM25_B, stats: DataFrame | None = None
                  ) -> DataFrame:
    """(part.., query_id, tok, df, idf, mean_dl, bound) of one block of query terms.

    ``bound`` is the most that the token adds to any document's score.  ``stats`` is
    (part.., n, mean_dl), by default from the postings.
    """
    part = part or []
    if stats is None:
        mean = F.greatest(F.avg("dl"), F.lit(1.0)).alias("mean_dl")
        stats = stage(posts.filter("first").groupBy(*part).agg(
            F.count(F.lit(1)).alias("n"), mean), "bm25-stats")
    found = posts.filter("tok IS NOT NULL")
    found = found.join(stats, part) if part else found.withColumns(
        {c: stats.select(c).scalar() for c in ("n", "mean_dl")})
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = found.groupBy(*part, "tok", "n", "mean_dl").agg(
        F.count(F.lit(1)).alias("df"), F.max(_gain(F.lit(1.0), k1, b)).alias("most"))
    known = known.withColumn("idf", idf).select(
        *part, "tok", "df", "idf", "mean_dl", (F.col("idf") * F.col("most")).alias("bound"))
    return stage(terms.join(known, [*part, "tok"]), "bm25-weights")


def _pair_scores(rows: DataFrame, weights: DataFrame, keys: list[str], name: str,
                 k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Sum of the gains of rows (part.., doc_id, dl, query_id, tok, tf) under ``keys``."""
    gain = F.sum(_gain(F.col("idf"), k1, b)).alias(name)
    on = [c for c in weights.columns if c in rows.columns]
    return rows.join(F.broadcast(weights), on).groupBy(*keys).agg(gain)


def score_thresholds(posts: DataFrame, weights: DataFrame, doc_id: str, query_id: str, k: int,
                     part: list[str] | None = None, k1: float = BM25_K1,
                     b: float = BM25_B) -> DataFrame:
    """(part.., query_id, threshold): a score that k documents of the query reach.

    The ``SEEDS`` rarest tokens of a query, and as many of those in k documents or more, give its
    first documents, at most k for each token by impact; these are scored in full, and the k-th
    best score is the threshold.  A query with fewer of them has none.
    """
    part = part or []
    rarest = Window.partitionBy(*part, query_id, F.col("df") >= k).orderBy("df", "tok")
    seeds = (
        weights.withColumn("_rank", F.row_number().over(rarest)).filter(F.col("_rank") <= SEEDS)
        .select(*part, query_id, "tok", "mean_dl"))
    found = posts.join(F.broadcast(seeds.drop(query_id).distinct()), [*part, "tok"])
    first = top_k(found.withColumn("_impact", _gain(F.lit(1.0), k1, b)), [*part, "tok"],
                  [F.col("_impact").desc(), F.col(doc_id)], k)
    pairs = (
        first.select(*part, "tok", doc_id).join(seeds.drop("mean_dl"), [*part, "tok"])
        .select(*part, doc_id, query_id).distinct())  # k times the seeds at most
    scored = _pair_scores(posts.join(F.broadcast(pairs), [*part, doc_id]),
                          weights.select(*part, query_id, "tok", "idf", "mean_dl"),
                          [*part, doc_id, "dl", query_id], "threshold", k1, b)
    best = top_k(scored, [*part, query_id], [F.col("threshold").desc()], k)
    return best.filter(F.col("rn") == k).select(*part, query_id, "threshold")


def essential_tokens(weights: DataFrame, thresholds: DataFrame, query_id: str,
                     part: list[str] | None = None) -> DataFrame:
    """``weights`` with ``threshold``, ``essential`` and ``rest``.

    The tokens of a query are added up from the one with the smallest bound; those that stay
    below a share of the threshold together are not essential and ``rest`` is their sum.  With
    the whole threshold fewer pairs would arise, but nearly all of them might still reach it.
    """
    part = part or []
    whole = Window.partitionBy(*part, query_id)
    rising = whole.orderBy("bound", "tok").rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        weights.join(thresholds, [*part, query_id], "left")
        .withColumn("_until", F.sum("bound").over(rising))
        .withColumn("essential", F.col("threshold").isNull()
                    | (F.col("_until") + MARGIN >= REST * F.col("threshold"))))
    rest = F.coalesce(F.sum(F.when(~F.col("essential"), F.col("bound"))).over(whole), F.lit(0.0))
    return stage(marked.withColumn("rest", rest).drop("_until"), "bm25-essential")


def bm25_scores(posts: DataFrame, weights: DataFrame, doc_id: str, query_id: str,
                part: list[str] | None = None, k1: float = BM25_K1,
                b: float = BM25_B) -> DataFrame:
    """(query_id, doc_id, score) of the pairs that may be among the first k; rounded to 6.

    One exchange brings the block's postings of a document together.  Where it has put them, the
    essential tokens give the pairs and a first sum; pairs that cannot reach the threshold with
    the ``rest`` of their query go, the others get their whole score.
    """
    part = part or []
    keys = [*part, doc_id, "dl"]
    dealt = posts.filter("tok IS NOT NULL").drop("first").repartition(doc_id)
    leads = weights.filter("essential").select(
        *part, query_id, "tok", "idf", "mean_dl", "threshold", "rest")
    sums = _pair_scores(dealt, leads, [*keys, query_id, "threshold", "rest"], "_sum", k1, b)
    reach = F.col("threshold").isNull() | (
        F.col("_sum") + F.col("rest") + MARGIN >= F.col("threshold"))
    rows = sums.filter(reach).select(*keys, query_id).join(dealt, keys)
    scored = _pair_scores(rows, weights.select(*part, query_id, "tok", "idf", "mean_dl"),
                          [*keys, query_id], "_score", k1, b)
    return scored.select(query_id, doc_id, F.round("_score", 6).alias("score")).filter(
        F.col("score") > 0)


def bm25_topk(corpus: DataFrame, queries: DataFrame, *, doc_id: str, text: str, query_id: str,
              query_text: str, k: int = CANDIDATES, part: list[str] | None = None,
              stop_words: tuple[str, ...] = STOP_WORDS, prune: bool = True,
              block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of every query.

    ``part`` restricts each query to the documents of its own part (same column names on
    both sides) and computes all statistics inside the part; a part without documents
    gives no rows.  Ties keep the order of the document ids.  ``prune=False`` scores every
    pair that shares a token, with the same result.
    """
    part = part or []
    docs = document_terms(corpus, doc_id, text, part, stop_words)
    return ranked_documents(docs, queries, doc_id=doc_id, query_id=query_id,
                            query_text=query_text, k=k, part=part, stop_words=stop_words,
                            prune=prune, block=block)


def ranked_documents(docs: DataFrame, queries: DataFrame, *, doc_id: str, query_id: str,
                     query_text: str, k: int = CANDIDATES, part: list[str] | None = None,
                     stop_words: tuple[str, ...] = STOP_WORDS, prune: bool = True,
                     block: int = BLOCK) -> DataFrame:
    """As :func:`bm25_topk` over :func:`document_terms`, which several blocks read from a stage."""
    part = part or []
    terms = stage(query_terms(queries, query_id, query_text, part, stop_words), "query-terms")
    blocks = max(1, -(-terms.count() // block))
    docs = docs if blocks == 1 else stage(docs, "document-terms")
    return _ranked(terms, blocks, lambda own: block_postings(docs, own, doc_id, part), None,
                   doc_id, query_id, k, part, prune)


def _ranked(terms: DataFrame, blocks: int, postings: Callable[[DataFrame], DataFrame],
            stats: DataFrame | None, doc_id: str, query_id: str, k: int, part: list[str],
            prune: bool) -> DataFrame:
    """Ranks all blocks of staged query terms over the postings of their vocabulary."""
    found = []
    for number in range(blocks):  # a query's terms are in one block
        own = terms if blocks == 1 else terms.filter(
            F.pmod(F.xxhash64(F.col(query_id).cast("string")), F.lit(blocks)) == number)
        posts = postings(own)
        weights = query_weights(posts, own, part, stats=stats)
        if prune:
            least = score_thresholds(posts, weights, doc_id, query_id, k, part)
        else:
            least = weights.select(*part, query_id).distinct().withColumn(
                "threshold", F.lit(None).cast("double"))
        marked = essential_tokens(weights, least, query_id, part)
        found.append(bm25_scores(posts, marked, doc_id, query_id, part))
    scores = reduce(DataFrame.unionByName, found)
    return top_k(scores, [query_id], [F.col("score").desc(), F.col(doc_id)], k, "rank")


def _bucket(tok: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(tok), F.lit(buckets)).cast("int")


def index_tables(docs: DataFrame, doc_id: str, part: list[str] | None = None,
                 buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """Tables of an inverted index of :func:`document_terms`, to be stored.

    ``postings`` (part.., doc_id, dl, tok, tf, bucket) in ranges of (bucket, tok), so that the
    postings of a frequent token spread over files; ``sizes`` (part.., n, words).
    """
    part = part or []
    posts = docs.select(*part, doc_id, "dl", F.inline("terms")).withColumn(
        "bucket", _bucket(F.col("tok"), buckets))
    keys = ["bucket", "tok", doc_id]
    return {
        "postings": posts.repartitionByRange(*keys).sortWithinPartitions(*keys),
        "sizes": docs.groupBy(*part).agg(F.count(F.lit(1)).alias("n"),
                                         F.sum("dl").alias("words"))}


def ranked_from_index(postings: DataFrame, sizes: DataFrame, queries: DataFrame, *, doc_id: str,
                      query_id: str, query_text: str, k: int = CANDIDATES,
                      part: list[str] | None = None,
                      stop_words: tuple[str, ...] = STOP_WORDS, prune: bool = True,
                      block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """As :func:`bm25_topk` over stored :func:`index_tables`: only the buckets of the queries'
    tokens are read.  ``part`` may be any of the index' part columns."""
    part = part or []
    terms = stage(query_terms(queries, query_id, query_text, part, stop_words), "query-terms")
    mean = F.greatest(F.sum("words") / F.sum("n"), F.lit(1.0)).alias("mean_dl")
    stats = stage(sizes.groupBy(*part).agg(F.sum("n").alias("n"), mean), "bm25-stats")

    def asked(own: DataFrame) -> DataFrame:
        block = own.select(*part, "tok").distinct().withColumn(
            "bucket", _bucket(F.col("tok"), buckets))
        used = sorted(r.bucket for r in block.select("bucket").distinct().collect())
        return stage(postings.filter(F.col("bucket").isin(used))  # partitions, ``buckets`` at most
                     .join(F.broadcast(block), ["bucket", *part, "tok"], "left_semi")
                     .select(*part, doc_id, "dl", "tok", "tf", F.lit(False).alias("first")),
                     "bm25-postings")

    return _ranked(terms, max(1, -(-terms.count() // block)), asked, stats, doc_id, query_id, k,
                   part, prune)


def _packed(ranked: DataFrame, corpus: DataFrame, block: Column, doc_id: str, query_id: str,
            columns: list[str]) -> DataFrame:
    """Blocks of a query's candidates in rank order; at most k of them, so the group is bounded."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return (
        ranked.join(corpus.select(doc_id, *columns), doc_id).groupBy(query_id)
        .agg(F.array_join(F.transform(blocks, lambda s: s["block"]), "").alias("pack")))


def pack_fragments(ranked: DataFrame, corpus: DataFrame, *, doc_id: str, text: str, query_id: str,
                   name: str, reference: str) -> DataFrame:
    """(query_id, pack): the candidate fragments of a query as one text, each below a rule."""
    block = F.concat(
        F.lit("\n" + "=" * 60 + "\nFragmento "), F.col("rank").cast("string"),
        F.lit("\nfragmento_id="), F.col(doc_id).cast("string"),
        F.lit("\ndocumento="), F.coalesce(name, F.lit("")),
        F.lit("\nreferencia="), F.coalesce(reference, F.lit("")), F.lit("\n\n"),
        strip(F.coalesce(text, F.lit(""))), F.lit("\n"))
    return _packed(ranked, corpus, block, doc_id, query_id, [text, name, reference])


def pack_documents(ranked: DataFrame, corpus: DataFrame, *, doc_id: str, text: str, query_id: str,
                   name: str, title: str, shown: int = 3000) -> DataFrame:
    """(query_id, pack): candidate documents as one text, the first ``shown`` characters of each.

    A document without title has no title line.
    """
    rule = "\n" + "-" * 70
    heading = F.when(F.coalesce(title, F.lit("")) != "",
                     F.concat(F.lit("\nTítulo: "), F.col(title))).otherwise("")
    block = F.concat(
        F.lit("\n" + rule + "\nDOCUMENTO "), F.col("rank").cast("string"), F.lit(rule + "\nID: "),
        F.col(doc_id).cast("string"), F.lit("\nNombre: "), F.coalesce(name, F.lit("")), heading,
        F.lit("\n\nContenido:\n\n"),
        strip(F.substring(F.coalesce(text, F.lit("")), 1, shown)))
    return _packed(ranked, corpus, block, doc_id, query_id, [text, name, title])
