"""Rule cascades that give every question a state, a part and a topic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbank.constants import (
    GENERAL, INFORMATICS, METHOD_BM25, METHOD_BM25_DOC, METHOD_BM25_DOC_MODEL,
    METHOD_BM25_MODEL, METHOD_DIRECT, PENDING, PRACTICAL_POINTS, PRACTICE, REASON, REJECTED,
    REVIEW, THEORY, VALIDATED,
)
from corpusbank.functions.citation import (
    ARTICLE_PATTERN, NAMED_NORMS, NORM_PATTERN, cited_article, cited_norm, named_norm,
    normalize_article,
)
from corpusbank.functions.features import practical_score
from corpusbank.functions.text import blank_to_null, normalize_spaces, slugify
from corpusbank.operators.coverage import (
    article_topics, contained_codes, coverage_pairs, norm_topics,
)
from corpusbank.operators.verdicts import check_verdicts, resolve_topics
from corpusbank.session import stage

Ranker = Callable[[DataFrame, list[str]], DataFrame]


def coverage_index(coverage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lookup tables of known size: per (norm, article) and per norm."""
    pairs = coverage_pairs(coverage)
    return stage(article_topics(pairs), "coverage-articles"), norm_topics(pairs)


def _with_topics(rows: DataFrame, index: tuple[DataFrame, DataFrame], include_full: bool
                 ) -> DataFrame:
    """Adds belongs, n_topics, part, topic for the row's (norm, article)."""
    articles, norms = index
    joined = rows.join(norms, "norm", "left").join(articles, ["norm", "article"], "left")
    indexed = F.col("n_topics").isNotNull()
    if include_full:
        n = F.when(indexed, F.col("n_topics")).otherwise(F.coalesce("n_full", F.lit(0)))
        part = F.when(indexed, F.col("part")).otherwise(F.col("full_part"))
        topic = F.when(indexed, F.col("topic")).otherwise(F.col("full_topic"))
    else:
        n, part, topic = F.coalesce("n_topics", F.lit(0)), F.col("part"), F.col("topic")
    return joined.withColumn("_n", n).withColumn("_part", part).withColumn(
        "_topic", topic).withColumn("belongs", F.col("n_full").isNotNull()).drop(
        "n_full", "full_part", "full_topic", "n_topics", "part", "topic")


def validate_footers(items: DataFrame, aliases: DataFrame, index, *, key: str, norm: str,
                     footer: str, stem: str, article: str, whole_words: bool = True
                     ) -> DataFrame:
    """(key, state, reason, norm, article, part, topic) from the footer of a question."""
    given = F.coalesce(*[blank_to_null(F.col(c)) for c in (norm, footer, stem)])
    rows = contained_codes(
        items.select(key, given.alias("_text"), given.isNull().alias("_blank"),
                     F.col(article).alias("_article")),
        "_text", aliases, whole_words=whole_words)
    n = F.size("codes")
    rows = rows.drop("_text").withColumn("norm", F.when(n == 1, F.col("codes")[0])).withColumn(
        "article", normalize_article(F.col("_article")))
    rows = _with_topics(rows, index, include_full=True)
    raw, good = blank_to_null(F.col("_article")), F.col("article")
    rule = (
        F.when(F.col("_blank"), "footer_blank")
        .when(n == 0, "footer_outside").when(n > 1, "footer_many_norms")
        .when(~F.col("belongs"), "footer_outside").when(raw.isNull(), "footer_no_article")
        .when(good.isNull(), "footer_bad_article").when(F.col("_n") == 0, "footer_article_outside")
        .when(F.col("_n") > 1, "many_topics").otherwise("footer_covered")
    )
    state = (
        F.when(F.col("rule").isin("footer_outside", "footer_article_outside"), REJECTED)
        .when(F.col("rule") == "footer_covered", VALIDATED).otherwise(REVIEW)
    )
    done = F.col("rule") == "footer_covered"
    return rows.withColumn("rule", rule).select(
        key, state.alias("state"), _reason("rule").alias("reason"), "norm",
        F.coalesce(good, raw).alias("article"),
        F.when(done, F.col("_part")).alias("part"), F.when(done, F.col("_topic")).alias("topic"))


def _reason(rule: str):
    out = F.lit(None).cast("string")
    for name, text in REASON.items():
        out = F.when(F.col(rule) == name, F.lit(text)).otherwise(out)
    return out


def classify_direct(items: DataFrame, aliases: DataFrame, index, *, key: str, text: str,
                    whole_words: bool = True, include_full: bool = False,
                    article_pattern: str = ARTICLE_PATTERN, norm_pattern: str = NORM_PATTERN,
                    named: dict[str, str] = NAMED_NORMS) -> DataFrame:
    """(key, resolved, state, reason, norm, article, part, topic, confidence, method).

    Citations in the statement decide; what they cannot decide stays PENDIENTE.
    """
    cited = items.select(
        key, F.col(text).alias("_text"),
        F.coalesce(named_norm(F.col(text), named), cited_norm(F.col(text), norm_pattern))
        .alias("_cited"),
        normalize_article(cited_article(F.col(text), article_pattern)).alias("article"))
    rows = contained_codes(cited, "_text", aliases, whole_words=whole_words).drop("_text")
    found, fallback = F.size("codes"), (F.size("codes") == 0) & F.col("_cited").isNotNull()
    rows = rows.withColumn("_codes", found + F.when(fallback, 1).otherwise(0)).withColumn(
        "norm", F.when(found == 1, F.col("codes")[0]).when(fallback, F.col("_cited")))
    rows = _with_topics(rows, index, include_full)
    rule = (
        F.when(F.col("_codes") == 0, "no_norm").when(F.col("_codes") > 1, "many_norms")
        .when(~F.col("belongs"), "norm_outside").when(F.col("article").isNull(), "no_article")
        .when(F.col("_n") == 0, "article_outside").when(F.col("_n") == 1, "covered")
        .otherwise("many_topics")
    )
    resolved = ~F.col("rule").isin("no_norm", "no_article")
    done = F.col("rule") == "covered"
    state = (
        F.when(~resolved, PENDING).when(done, VALIDATED)
        .when(F.col("rule") == "many_topics", REVIEW).otherwise(REJECTED)
    )
    return rows.withColumn("rule", rule).select(
        key, resolved.alias("resolved"), state.alias("state"), _reason("rule").alias("reason"),
        F.when(F.col("rule") != "many_norms", F.col("norm")).alias("norm"),
        F.when(F.col("rule") != "many_norms", F.col("article")).alias("article"),
        F.when(done, F.col("_part")).alias("part"), F.when(done, F.col("_topic")).alias("topic"),
        F.when(resolved, F.lit(1.0)).alias("confidence"),
        F.when(resolved, F.lit(METHOD_DIRECT)).alias("method"))


def settle_candidates(pending: DataFrame, candidates: DataFrame, verdicts: DataFrame,
                      topics: DataFrame, *, key: str, verdict: str, documents: bool = False
                      ) -> DataFrame:
    """(key, state, reason, chosen_id, part, topic, confidence, method) of pending questions.

    ``candidates`` is (key, candidate_id), ``verdicts`` (key, verdict text), ``topics``
    (chosen_id, n_topics, part, topic).  Without candidates a question is rejected; without
    a verdict it stays pending.
    """
    offered = candidates.select(key).distinct().withColumn("_has", F.lit(True))
    checked = check_verdicts(
        verdicts, candidates, question=key, text=verdict, candidate_id="candidate_id",
        id_field="documento_id" if documents else "fragmento_id")
    resolved = resolve_topics(
        checked, topics, many=REASON["document_many" if documents else "fragment_many"]
    ).select(key, "state", "reason", "chosen_id", "part", "topic", "confidence",
             F.lit(METHOD_BM25_DOC_MODEL if documents else METHOD_BM25_MODEL).alias("method"))
    rows = pending.select(key).join(offered, key, "left").join(resolved, key, "left")
    none, waiting = F.col("_has").isNull(), F.col("method").isNull()
    return rows.select(
        key,
        F.when(none, REJECTED).when(waiting, PENDING).otherwise(F.col("state")).alias("state"),
        F.when(none, REASON["no_documents" if documents else "no_fragments"])
        .otherwise(F.col("reason")).alias("reason"),
        *[F.when(~none, F.col(c)).alias(c) for c in ("chosen_id", "part", "topic")],
        F.when(none, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(none, METHOD_BM25_DOC if documents else METHOD_BM25)
        .otherwise(F.col("method")).alias("method"))


RETRIEVAL, RULE, DOCUMENTS = "RECUPERACION", "REGLA", "INFORMATICA"  # branches of the cascade


def cascade_candidates(searches: DataFrame, fragments: Ranker, documents: Ranker, *, key: str
                       ) -> DataFrame:
    """(key, candidate_id, rank, branch) of routed searches (key, text, norm, branch).

    Informatics questions search whole documents; the others fragments, those of the cited norm
    where one is known.  Each ranker takes (key, text[, norm]) and a list of part columns and
    returns (key, candidate_id, rank).
    """
    branch, norm = F.col("branch"), F.col("norm")
    of = lambda rows, *more: rows.select(key, "text", *more)
    found = [
        (documents(of(searches.filter(branch == DOCUMENTS)), []), DOCUMENTS),
        (fragments(of(searches.filter((branch == RETRIEVAL) & norm.isNull())), []), RETRIEVAL),
        (fragments(of(searches.filter((branch == RETRIEVAL) & norm.isNotNull()), "norm"),
                   ["norm"]), RETRIEVAL)]
    parts = [rows.select(key, "candidate_id", "rank", F.lit(name).alias("branch"))
             for rows, name in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def classification_cascade(questions: DataFrame, aliases: DataFrame, index, *, key: str, text: str,
                           origin: str, fragments: Ranker, documents: Ranker,
                           judge: Callable[[DataFrame], DataFrame],
                           topics: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, branch, state, reason, norm, article, chosen_id, part, topic, confidence, method).

    Every question takes one branch: informatics by its ``origin`` part, else the rule on the
    citations of its statement where that decides, else retrieval.  ``judge`` gives the verdicts
    (key, verdict) on candidates, ``topics`` (chosen_id, n_topics, part, topic) of candidates;
    both are called once, with the candidates of all branches.  ``norm`` and ``article`` are the
    cited ones.
    """
    asked = stage(questions.select(key, F.col(text).alias("text"), slugify(F.col(origin)).contains(
        "informatica").alias("_it")), "cascade-asked")
    it = F.coalesce("_it", F.lit(False))
    rules = stage(classify_direct(asked.filter(~it), aliases, index, key=key, text="text"),
                  "cascade-rules")
    unresolved = asked.join(rules.filter(~F.col("resolved")).select(key, "norm", "article"), key)
    searches = unresolved.select(key, "text", "norm", "article", F.lit(RETRIEVAL).alias("branch")
                                 ).unionByName(asked.filter(it).select(
                                     key, "text", F.lit(None).cast("string").alias("norm"),
                                     F.lit(None).cast("string").alias("article"),
                                     F.lit(DOCUMENTS).alias("branch")))
    searches = stage(searches, "cascade-searches")
    candidates = stage(cascade_candidates(searches, fragments, documents, key=key),
                       "cascade-candidates")
    verdicts, named = stage(judge(candidates), "cascade-verdicts"), topics(candidates)
    settled = []
    for branch in (RETRIEVAL, DOCUMENTS):
        own = searches.filter(F.col("branch") == branch)
        rows = settle_candidates(
            own, candidates.filter(F.col("branch") == branch),
            verdicts.join(own.select(key), key, "left_semi"), named, key=key, verdict="verdict",
            documents=branch == DOCUMENTS)
        settled.append(rows.join(own.select(key, "norm", "article", "branch"), key))
    done = rules.filter("resolved").select(
        key, "state", "reason", F.lit(None).cast("long").alias("chosen_id"), "part",
        F.col("topic").cast("string").alias("topic"), "confidence", "method", "norm", "article",
        F.lit(RULE).alias("branch"))
    out = done
    for rows in settled:
        out = out.unionByName(rows.withColumns({
            "chosen_id": F.col("chosen_id").cast("long"), "topic": F.col("topic").cast("string")}))
    return out.select(key, "branch", "state", "reason", "norm", "article", "chosen_id", "part",
                      "topic", "confidence", "method")


def classify_type(items: DataFrame, overrides: DataFrame, *, key: str, part: str, stem: str,
                  strict: bool = False) -> DataFrame:
    """(key, qtype, points, error): override, then part, then the practical-case score."""
    points = practical_score(F.col(stem), strict)
    name = normalize_spaces(F.col(part))
    special = name.isin("especial-teoria", "especial teoria", "especial")
    qtype = (
        F.when(F.col("_override").isNotNull(), F.col("_override"))
        .when(name == "general", GENERAL)
        .when(name.isin("especial-informatica", "especial informatica"), INFORMATICS)
        .when(special & (F.col("points") >= PRACTICAL_POINTS), PRACTICE)
        .when(special, THEORY)
    )
    rows = items.join(overrides.select(key, F.col("qtype").alias("_override")), key, "left")
    return rows.withColumn("points", points).withColumn("qtype", qtype).select(
        key, "qtype", "points", F.col("qtype").isNull().alias("error"))


