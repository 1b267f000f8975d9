"""Which topic covers a citation: prefix, containment and equality joins on a catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbank.functions.citation import coverage_expression, expand_ranges
from corpusbank.functions.text import normalize_spaces, slugify
from corpusbank.session import stage

SAMPLE = 0.05  # share of the texts whose words are counted to choose anchors
ALIAS_BLOCK = 200_000  # aliases broadcast at once


def longest_prefix(names: DataFrame, name: str, catalogue: DataFrame) -> DataFrame:
    """Adds ``code``: the catalogue entry whose slug is the longest prefix of the name's slug.

    ``catalogue`` is (code, prefix, pos); equal lengths keep catalogue order, then slug and
    code.  Distinct slugs are cut to every prefix length of the catalogue and joined by
    equality, so repeated and null names are answered like any other.
    """
    entries = catalogue.select("code", slugify(F.col("prefix")).alias("_cut"), "pos").withColumn(
        "_len", F.length("_cut"))
    lengths = entries.agg(F.collect_set("_len")).scalar()  # a few numbers
    slugged = names.withColumn("_slug", slugify(F.col(name)))
    cut = slugged.select("_slug").distinct().withColumn("_lengths", lengths).select(
        "_slug", F.explode(F.transform(
            F.filter("_lengths", lambda n: n <= F.length("_slug")),
            lambda n: F.left(F.col("_slug"), n))).alias("_cut"))
    best = cut.join(entries, "_cut").groupBy("_slug").agg(F.min(F.struct(
        (-F.col("_len")).alias("neg"), "pos", "_cut", "code"))["code"].alias("code"))
    return slugged.join(best, "_slug", "left").select(*names.columns, "code")


def word_form(c: Column) -> Column:
    """Accent-free words and numbers separated by single blanks ("ley 39/2015")."""
    return F.trim(F.regexp_replace(normalize_spaces(c), "[^\\p{L}\\p{N}/_]+", " "))


def _grams(c: Column, whole_words: bool) -> Column:
    """What aliases are found by: words, or all runs of one to three characters."""
    if whole_words:
        return F.array_distinct(F.split(c, " "))
    return F.array_distinct(F.flatten(F.array(*[
        F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2, 3)])))


def alias_anchors(texts: DataFrame, text: str, aliases: DataFrame, *, whole_words: bool = True,
                  sample: float = SAMPLE) -> DataFrame:
    """(code, alias, anchor), staged: the word (or trigram) of each alias that is rarest in the texts.

    Frequencies are counted in a sample of the texts, for the grams of the aliases only; equal
    ones are decided by the number of aliases that share the gram, then by its length.  The
    choice changes the cost of the join, not its result.
    """
    form = word_form if whole_words else normalize_spaces
    entries = aliases.select("code", form(F.col("alias")).alias("alias")).filter(
        "alias <> ''").distinct()
    own = _grams(F.col("alias"), whole_words)
    if not whole_words:
        own = F.filter(own, lambda g: F.length(g) == F.least(F.length("alias"), F.lit(3)))
    grammed = entries.select("code", "alias", F.explode(own).alias("anchor"))
    shared = grammed.groupBy("anchor").agg(F.count(F.lit(1)).alias("_shared"))
    met = (
        texts.sample(sample, 1).select(F.explode(
            _grams(form(F.col(text)), whole_words)).alias("anchor"))
        .groupBy("anchor").agg(F.count(F.lit(1)).alias("_met")))
    ranked = grammed.join(shared.join(met, "anchor", "left"), "anchor")
    return stage(ranked.groupBy("code", "alias").agg(F.min_by("anchor", F.struct(
        F.coalesce("_met", F.lit(0)), "_shared", -F.length("anchor"), "anchor")).alias("anchor")),
        "alias-anchors")


def contained_codes(texts: DataFrame, text: str, aliases: DataFrame, *,
                    whole_words: bool = True, sample: float = SAMPLE,
                    block: int = ALIAS_BLOCK) -> DataFrame:
    """Adds ``codes``: distinct codes any of whose aliases occurs in the text, sorted.

    ``aliases`` is (code, alias).  Whole words by default; ``whole_words=False`` matches
    plain substrings.  The aliases are broadcast in blocks of about ``block``, keyed by their
    anchor; the words of a text are joined with them and the aliases verified while the text is
    still in its row, so no text and no word is shuffled and a frequent anchor meets nowhere.
    Only (digest of the text, codes) of texts with a hit are exchanged and joined back; rows
    without a text get a key of their own.
    """
    form = word_form if whole_words else normalize_spaces
    anchored = alias_anchors(texts, text, aliases, whole_words=whole_words, sample=sample)
    padded = F.concat(F.lit(" "), F.col("alias"), F.lit(" ")) if whole_words else F.col("alias")
    blocks = max(1, -(-anchored.count() // block))
    found = []
    for number in range(blocks):
        own = anchored.select("code", padded.alias("_alias"), "anchor").filter(
            F.pmod(F.xxhash64("alias"), F.lit(blocks)) == number)
        norm = form(F.col(text))
        inside = F.concat(F.lit(" "), norm, F.lit(" ")) if whole_words else norm
        inside = F.coalesce(inside, F.lit(""))  # no filter on it below the join
        rows = texts.filter(F.col(text).isNotNull()).select(
            F.md5(F.col(text)).alias("_digest"), inside.alias("_in"))
        words = rows.select("_digest", "_in", F.explode(
            _grams(F.trim("_in") if whole_words else F.col("_in"), whole_words)).alias("anchor"))
        found.append(words.join(F.broadcast(own), "anchor").filter(F.contains("_in", "_alias"))
                     .select("_digest", "code"))
    hits = reduce(DataFrame.unionByName, found).groupBy("_digest").agg(
        F.array_sort(F.collect_set("code")).alias("codes"))
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    return (
        texts.withColumn("_digest", F.coalesce(F.md5(F.col(text)), alone))
        .join(hits, "_digest", "left")
        .withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
        .select(*texts.columns, "codes"))


def coverage_from_documents(assoc: DataFrame, document: str = "document") -> DataFrame:
    """Adds ``full`` and ``articles`` (null for whole norms) from the document name."""
    expression = coverage_expression(F.col(document))
    return assoc.withColumn("full", expression.isNull()).withColumn(
        "articles", expand_ranges(expression))


def coverage_pairs(coverage: DataFrame) -> DataFrame:
    """(norm, article, part, topic) without repeats; article null = the whole norm.

    Staged: the lookups below are then small scans of known size, and the planner
    broadcasts them exactly when they fit.
    """
    article = F.when(F.col("full"), F.array(F.lit(None).cast("string"))).otherwise(
        F.col("articles"))
    return stage(coverage.filter("norm IS NOT NULL").select(
        "norm", F.explode(article).alias("article"), "part", "topic").distinct(), "coverage")


def indexed_topics(pairs: DataFrame) -> DataFrame:
    """(norm, article, part, topic) of every indexed article, without repeats.

    Documents that cover the whole norm add their topics to each of its indexed articles.
    """
    indexed, full = pairs.filter("article IS NOT NULL"), pairs.filter("article IS NULL")
    return indexed.unionByName(
        indexed.select("norm", "article").distinct().join(full.drop("article"), "norm")
        .select("norm", "article", "part", "topic")
    ).distinct()


def coverage_join(citations: DataFrame, coverage: DataFrame, include_full: bool = True
                  ) -> DataFrame:
    """Citations (norm, article, ..) with every covering (part, topic), without repeats.

    Repeats are removed on the lookup tables, so the citations are not shuffled when those
    fit a broadcast.
    """
    on, pairs = ["norm", "article"], coverage_pairs(coverage)
    if not include_full:
        return citations.join(pairs.filter("article IS NOT NULL"), on)
    indexed = stage(indexed_topics(pairs), "indexed-topics")
    norms = pairs.filter("article IS NULL").drop("article")
    by_article = citations.join(indexed, on)
    by_norm = citations.join(pairs.select(on), on, "left_anti").join(norms, "norm")
    return by_article.unionByName(by_norm.select(by_article.columns))


def article_topics(pairs: DataFrame) -> DataFrame:
    """(norm, article, n_topics, part, topic): one row per indexed article.

    Part and topic are given only when there is exactly one.
    """
    return indexed_topics(pairs).groupBy("norm", "article").agg(
        *_topic_summary(F.struct("part", "topic"), "n_topics", "part", "topic"))


def norm_topics(pairs: DataFrame) -> DataFrame:
    """(norm, n_full, full_part, full_topic): all norms, with their whole-norm topics."""
    whole = F.when(F.col("article").isNull(), F.struct("part", "topic"))
    return pairs.groupBy("norm").agg(
        *_topic_summary(whole, "n_full", "full_part", "full_topic"))


def _topic_summary(key: Column, count: str, part: str, topic: str) -> list[Column]:
    single = F.min(key) == F.max(key)
    return [
        F.count(key).alias(count),
        F.when(single, F.min(key)["part"]).alias(part),
        F.when(single, F.min(key)["topic"]).alias(topic),
    ]


def single_value(c: str) -> Column:
    """Aggregate: the value when all non-null values are equal, else null."""
    return F.when(F.min(c) == F.max(c), F.min(c))


def prefer_matching(assoc: DataFrame, keys: list[str], match: Column) -> DataFrame:
    """Associations that match; all of them for a key where none matches."""
    any_match = F.max(match).over(Window.partitionBy(*keys))
    return assoc.withColumn("_any", any_match).filter(match | ~F.col("_any")).drop("_any")


def syllabus_stats(topics: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: parts, topics, documents, norms and indexed articles."""
    indexed = coverage_pairs(coverage).filter("article IS NOT NULL").select(
        "norm", "article").distinct()
    counts = coverage.agg(
        F.count_distinct("document").alias("documents"), F.count_distinct("norm").alias("norms"))
    return (
        topics.agg(F.count_distinct("part").alias("parts"),
                   F.count_distinct("part", "topic").alias("topics"))
        .withColumn("documents", counts.select("documents").scalar())
        .withColumn("norms", counts.select("norms").scalar())
        .withColumn("articles", indexed.agg(F.count(F.lit(1))).scalar())
    )
