"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its words hashed into ``BUCKETS`` buckets (square roots of the counts,
scaled to length 1), statistics of its structure (character classes, word lengths, repetition,
lines) and its metadata (the stored character count, and how far it is from the text's own).  The
score is the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2),

all pairwise interactions at rank ``FACTORS`` in time linear in the features.  It is trained by
Adagrad on at most ``SAMPLE`` labelled documents (those with the least hash of their doc_id, whole
texts); their sparse features, at most ``BUCKETS`` numbers each, go to the driver, texts do not.
Language, source, doc_id and labels are no features.

Defined cases: a null or empty text has no words and zero statistics and gets the score of that; a
null character count counts as the text's own; without labels, or with one kind only, the score is
the share of label 1 (0.5 without labels); a repeated label row counts as 1 if one of its rows
does; repeated rows get equal scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbank.llm.bpe import text_slices
from corpusbank.llm.common import table, text_crc32
from corpusbank.llm.words import word_hashes

THRESHOLD = 0.3
BUCKETS = 4_096
FACTORS = 6
SAMPLE = 8_000  # labelled documents
EPOCHS = 12
RATE = 0.1
RIDGE = 1e-4
BATCH_BYTES = 2_000_000

# Classes of bytes that are counted.
CLASSES = np.zeros(256, dtype=np.uint8)
for _class, _bytes in enumerate((
        range(65, 91), range(97, 123), range(48, 58), b" \t\r\v\f", b"\n", b".,;:?'\"-()",
        b"#$%&*!@^~<>+=_/\\", b"|{}[]`", range(128, 192), range(192, 256))):
    CLASSES[list(_bytes)] = _class + 1
N_CLASSES = 11
STATISTICS = N_CLASSES + 9


def structure(texts: list[str], words: np.ndarray, counts: np.ndarray, distinct: np.ndarray,
              most: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """(texts, STATISTICS) numbers; see the code for their order."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    out = np.zeros((len(texts), STATISTICS))
    shares = np.array([np.bincount(CLASSES[np.frombuffer(r, np.uint8)], minlength=N_CLASSES)
                       for r in raw])
    out[:, :N_CLASSES] = shares / np.maximum(size, 1)[:, None]
    owner = np.repeat(np.arange(len(texts)), counts)
    twice = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    repeated = np.bincount(owner[1:][twice], minlength=len(texts))
    n = np.maximum(counts, 1)
    own = np.array([len(t) for t in texts], dtype=float)
    stored = np.where(np.isnan(n_chars), own, n_chars)
    lines = shares[:, 5] + 1
    upper, lower = shares[:, 1], shares[:, 2]
    out[:, N_CLASSES:] = np.stack([
        np.log1p(counts), (size - shares[:, 4] - shares[:, 5]) / n / 10, distinct / n, most / n,
        repeated / n, np.log1p(counts / lines) / 5, upper / np.maximum(upper + lower, 1),
        np.log1p(np.maximum(stored, 0)) / 10, np.clip((stored - own) / np.maximum(own, 1), -1, 1)], axis=1)
    return out


def features(texts: list[str], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, value, buckets per text, statistics): hashed words sparse, statistics dense."""
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    both, number = np.unique(owner * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64),
                             return_counts=True)
    text, bucket = both // BUCKETS, both % BUCKETS
    distinct = np.bincount(text, minlength=len(texts))
    most = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(most, text, number)
    value = np.sqrt(number / np.maximum(counts, 1)[text])
    return bucket, value, distinct, structure(texts, words, counts, distinct, most, n_chars)


class Machine:
    """Weights of a factorisation machine; words have places 0 .. BUCKETS-1, statistics follow."""

    def __init__(self, share: float):
        rng = np.random.default_rng(17)
        size = BUCKETS + STATISTICS
        self.w0 = float(np.log(share / (1 - share)))
        self.w = np.zeros(size)
        self.v = rng.normal(0, 0.05, (size, FACTORS))
        self.mean, self.scale = np.zeros(STATISTICS), np.ones(STATISTICS)

    def _sums(self, bucket, value, owner, n, dense):
        """Linear part, sum of v x and sum of v^2 x^2 of each text."""
        w, v = self.w[:BUCKETS], self.v[:BUCKETS]
        linear = np.bincount(owner, weights=w[bucket] * value, minlength=n) + dense @ self.w[BUCKETS:]
        one = np.stack([np.bincount(owner, weights=v[bucket, f] * value, minlength=n)
                        for f in range(FACTORS)], axis=1) + dense @ self.v[BUCKETS:]
        two = np.stack([np.bincount(owner, weights=(v[bucket, f] * value) ** 2, minlength=n)
                        for f in range(FACTORS)], axis=1) + (dense ** 2) @ (self.v[BUCKETS:] ** 2)
        return linear, one, two

    def dense(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.scale, -4, 4) / 2

    def scores(self, bucket, value, per_text, statistics) -> np.ndarray:
        owner = np.repeat(np.arange(len(per_text)), per_text)
        linear, one, two = self._sums(bucket, value, owner, len(per_text), self.dense(statistics))
        z = self.w0 + linear + 0.5 * (one ** 2 - two).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, bucket, value, per_text, statistics, y, epochs: int = EPOCHS) -> None:
        self.mean, self.scale = statistics.mean(axis=0), statistics.std(axis=0) + 1e-6
        dense, rng = self.dense(statistics), np.random.default_rng(18)
        start = np.cumsum(per_text) - per_text
        square_w, square_v, square_0 = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2), 1e-2
        for _ in range(epochs):
            for chosen in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
                count = per_text[chosen]
                at = np.repeat(start[chosen] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                owner = np.repeat(np.arange(len(chosen)), count)
                b, x, d = bucket[at], value[at], dense[chosen]
                linear, one, two = self._sums(b, x, owner, len(chosen), d)
                z = self.w0 + linear + 0.5 * (one ** 2 - two).sum(axis=1)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)
                grad_w, grad_v = RIDGE * self.w, RIDGE * self.v
                grad_w[:BUCKETS] += np.bincount(b, weights=error[owner] * x, minlength=BUCKETS)
                grad_w[BUCKETS:] += error @ d
                for f in range(FACTORS):
                    # d/dv_if = x_i (sum_j v_jf x_j) - v_if x_i^2
                    part = error[owner] * x * (one[owner, f] - self.v[b, f] * x)
                    grad_v[:BUCKETS, f] += np.bincount(b, weights=part, minlength=BUCKETS)
                grad_v[BUCKETS:] += d.T @ (error[:, None] * one) - self.v[BUCKETS:] * (
                    (d ** 2).T @ error)[:, None]
                square_w += grad_w ** 2
                square_v += grad_v ** 2
                square_0 += error.sum() ** 2
                self.w -= RATE * grad_w / np.sqrt(square_w)
                self.v -= RATE * grad_v / np.sqrt(square_v)
                self.w0 -= RATE * error.sum() / np.sqrt(square_0)


def _stored(part: pa.RecordBatch, column: str) -> np.ndarray:
    values = part.column(part.schema.get_field_index(column)).to_pylist()
    return np.array([np.nan if v is None else v for v in values], dtype=float)


def train(docs: DataFrame, labels: DataFrame) -> Machine | float:
    """Machine from docs (doc_id, text, n_chars) and labels (doc_id, quality 0/1); or a share."""
    known = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text", BATCH_BYTES):
                bucket, value, n, statistics = features(texts, _stored(part, "n_chars"))
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(part.column(3).to_pylist(), pa.int32()),
                     pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(value)),
                     pa.array(list(statistics), pa.list_(pa.float64()))],
                    names=["doc_id", "y", "bucket", "value", "statistics"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("n_chars").cast("double")) \
        .join(F.broadcast(sample), "doc_id").mapInArrow(
            run, "doc_id long, y int, bucket array<int>, value array<double>, "
                 "statistics array<double>").toArrow()
    rows = rows.sort_by("doc_id")
    y = rows.column("y").to_numpy().astype(float)
    if len(y) == 0:
        return 0.5
    if y.min() == y.max():
        return float(y[0])
    flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy()
    machine = Machine(y.mean())
    machine.fit(flat("bucket"), flat("value"),
                rows.column("bucket").combine_chunks().value_lengths().to_numpy(),
                flat("statistics").reshape(len(y), STATISTICS), y)
    return machine


def with_scores(docs: DataFrame, model: Machine | float, keep: list[str] | None = None,
                score: str = "score") -> DataFrame:
    """The columns ``keep`` (all) of docs (text, n_chars ..) and the probability of label 1."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != score]

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text", BATCH_BYTES):
                if isinstance(model, float):
                    found = np.full(len(texts), model)
                else:
                    found = model.scores(*features(texts, _stored(part, "n_chars")))
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], names=[*kept, score])

    return docs.mapInArrow(run, docs.select(*kept).schema.add(score, "double"))


def held_out(doc_id):
    return text_crc32(doc_id) % F.lit(5) == 0


def op3_quality_fm(spark, sf_dir: str) -> DataFrame:
    """All documents: probability of quality 1, learnt without the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    return with_scores(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
