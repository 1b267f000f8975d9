"""Toxicity by compression distance between two zstandard dictionaries.

Training takes at most ``SAMPLE`` labelled documents of each class (by hash of doc_id, those of at most
``SAMPLE_CHARS`` characters; their texts, at most some 60 MB, go to the driver).  Character 5-grams
that far more toxic than ordinary documents contain mark the toxic text: the words around them train the toxic
dictionary, words of ordinary documents the ordinary one.  Both dictionaries hold the ordinary
text too, as raw content, so that only what is particular to toxic text makes lengths differ.

Every text is cut into windows of one word.  A window is compressed with either dictionary behind
a fixed lead and before a fixed tail, which both dictionaries hold, because zstandard neither
matches in the last bytes of a block nor compresses blocks too small to gain.  The difference of
the two lengths, in bytes, says how toxic the window is.  A document is summed up by its three
largest differences over distinct windows and the numbers of windows from 4, 6 and 8 bytes; a
logistic calibration, fitted on the same sample out of fold (dictionaries trained on one half
score the other), turns them into a probability that is compared with ``THRESHOLD``.

Distinct windows are compressed once per Python worker, in a bounded cache, so time is linear in
the text and memory is bounded.

Defined cases: a null or empty text has no window and gets the calibration's value for none; words
beyond 64 bytes are cut into windows of 64 bytes; without a toxic or an ordinary labelled document
the score is the share of toxic labels (0 without labels); repeated rows get equal scores; an
empty table gives no rows; other columns are ignored, or kept by filtering.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusbank.llm.bpe import text_slices
from corpusbank.llm.common import table, text_crc32
from corpusbank.llm.pii_weak import fit_logistic

THRESHOLD = 0.7
SAMPLE = 3_000  # labelled documents of each class
SAMPLE_CHARS = 12_000
GRAM = 5
MIN_DOCS = 5  # a marking 5-gram is in so many toxic documents at least
MIN_ODDS = 3.0  # log of its share among toxic over its share among ordinary documents
ORDINARY_BYTES = 49_152
TOXIC_BYTES = 4_096
WINDOW_BYTES = 64
LEVEL, MIN_MATCH = 9, 5
BATCH_BYTES = 2_000_000
CACHE_WINDOWS = 500_000
LEAD = b"|The quick brown fox jumps over the lazy dog; 0123456789 times.|"
TAIL = b"0123456789 times."


def windows(text: str) -> list[str]:
    """Distinct windows of a text: its words, lower case, in pieces of at most 64 bytes."""
    words = set(text.lower().split())
    for long in [w for w in words if len(w) > WINDOW_BYTES // 4]:
        words.discard(long)
        raw = long.encode("utf-8", "replace")
        words.update(raw[k:k + WINDOW_BYTES].decode("utf-8", "ignore")
                     for k in range(0, len(raw), WINDOW_BYTES))
    return list(words)


def _grams(word: str) -> set[str]:
    padded = f" {word} "
    return {padded[k:k + GRAM] for k in range(len(padded) - GRAM + 1)}


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on samples; few samples are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


class Distance:
    """Length differences of windows under an ordinary and a toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        def compressor(content: bytes):
            parameters = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(content), source_size=WINDOW_BYTES + 96, min_match=MIN_MATCH,
                window_log=17, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0,
                write_checksum=0, write_dict_id=0)
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters).compress

        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)
        self.known: dict[str, int] = {}

    def difference(self, window: str) -> int:
        if window not in self.known:
            raw = LEAD + f" {window} ".encode("utf-8", "replace") + TAIL
            self.known[window] = len(self.ordinary(raw)) - len(self.toxic(raw))
        return self.known[window]

    def summary(self, text: str) -> list[float]:
        """Three largest differences, then log numbers of windows from 4, 6 and 8 bytes."""
        if len(self.known) > CACHE_WINDOWS:
            self.known.clear()
        found = sorted(map(self.difference, windows(text)), reverse=True)
        top = [*found[:3], 0, 0, 0][:3]
        counts = [sum(1 for d in found if d >= least) for least in (4, 6, 8)]
        return [*(max(min(d, 12), -4) for d in top), *map(math.log1p, counts),
                math.log1p(len(found))]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents of equal make-up."""
    in_toxic, in_ordinary = Counter(), Counter()
    for texts, seen in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for text in texts:
            seen.update(set().union(*map(_grams, windows(text)), set()))
    marking = {
        g for g, n in in_toxic.items() if n >= min(MIN_DOCS, len(toxic)) and
        math.log((n + .5) / (len(toxic) + 1)) - math.log(
            (in_ordinary[g] + .5) / (len(ordinary) + 1)) > MIN_ODDS}
    marked, plain = Counter(), Counter()
    for text in toxic:
        marked.update(w for w in windows(text) if not marking.isdisjoint(_grams(w)))
    for text in ordinary:
        plain.update(windows(text))

    def samples(seen: Counter) -> list[bytes]:
        """Words as often as documents hold them, in a fixed random order."""
        each = [(zlib.crc32(f"{w} {k}".encode()), w) for w, n in seen.items() if n > 2
                for k in range(min(n, 500))]
        return [f" {w} ".encode() for _, w in sorted(each)[:40_000]]

    base = _dictionary(samples(plain), ORDINARY_BYTES)
    extra = _dictionary(samples(marked), TOXIC_BYTES)
    rare = b"".join(f" {w} ".encode() for w, n in plain.most_common(20_000)[::-1])[:len(extra)]
    return rare + base + LEAD, base + extra + LEAD


def train(toxic: list[str], ordinary: list[str], share: float) -> dict:
    """Dictionaries and calibration; ``share`` is the share of toxic labels."""
    if not toxic or not ordinary:
        return {"share": share}
    x, y = [], []
    for fold in (0, 1):
        distance = Distance(*train_dictionaries(toxic[fold::2] or toxic, ordinary[fold::2] or ordinary))
        for label, texts in ((1, toxic), (0, ordinary)):
            for text in texts[1 - fold::2]:
                x.append(distance.summary(text))
                y.append(label)
    x, y = np.array(x), np.array(y, dtype=float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    coefficients = fit_logistic(np.hstack([(x - mean) / scale, np.ones((len(x), 1))]), y, weight, 1.0)
    return {"share": share, "dictionaries": train_dictionaries(toxic, ordinary),
            "mean": mean, "scale": scale, "coefficients": coefficients}


def training_rows(docs: DataFrame, labels: DataFrame) -> dict:
    """Model from docs (doc_id, text) and labels (doc_id, toxic 0/1), both for training only."""
    known = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = known.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE)
    rows = docs.join(F.broadcast(sample), "doc_id").filter(  # at most 2 * SAMPLE rows
        F.length("text") <= SAMPLE_CHARS).select("toxic", "_n", "text").collect()
    rows = sorted(rows, key=lambda r: (r["_n"], r["text"]))
    texts = {c: [r["text"] for r in rows if r["toxic"] == c] for c in (0, 1)}
    total = sum(counts.values())
    return train(texts[1], texts[0], counts.get(1, 0) / total if total else 0.0)


class Scorer:
    def __init__(self, model: dict):
        self.model = model
        self.distance = Distance(*model["dictionaries"]) if "dictionaries" in model else None

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.distance is None:
            return np.full(len(texts), float(self.model["share"]))
        x = np.array([self.distance.summary(t) for t in texts])
        x = (x - self.model["mean"]) / self.model["scale"]
        w = self.model["coefficients"]
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def with_scores(docs: DataFrame, model: dict, text: str = "text", score: str = "score",
                keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` and the probability that the text is toxic."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != score]

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for part, texts in text_slices(batch, text, BATCH_BYTES):
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(scorer.scores(texts), pa.float64())], names=[*kept, score])

    fields = docs.select(*kept).schema.add(score, "double")
    return docs.mapInArrow(run, fields)


def without_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
                         docs["text"].alias("_text"))
    return with_scores(packed, model, "_text", "_score", ["_row"]).filter(
        F.col("_score") < threshold).select("_row.*")


def held_out(doc_id, folds: int = 3, fold: int = 1):
    return text_crc32(doc_id) % F.lit(folds) == fold


def trained(spark, sf_dir: str) -> dict:
    """The model from the documents and labels of ``sf_dir`` that are not held out."""
    seen = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return training_rows(table(spark, sf_dir, "documents"), seen)


def op9_compression_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents: probability of the toxic label, learnt without the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, trained(spark, sf_dir), keep=["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
