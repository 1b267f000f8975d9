"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A text is cut into words by the tokenizer's pattern.  The bytes of all words that a batch has not
met before lie as symbols in one flat array; in every round each word merges all occurrences of
its lowest-rank pair, ranks being found by binary search over the sorted pair keys, and only pairs
beside a merge are looked up again.  Encoded words are kept in a bounded per-process cache.
Decoding gathers the tokens' bytes from one flat table.

The vocabulary file is read by every Python worker from ``path`` (a file that all machines have,
such as one of an installed package).  Only added tokens without strip or word options are known.

Defined cases: a null or empty text has no ids (an empty list) and decodes to the empty text; null
ids decode to the empty text; ids outside the vocabulary decode to nothing; bytes that are no
UTF-8 become U+FFFD; a text of any length is encoded whole; repeated rows stay; an empty table
stays empty; other columns pass through, one with the output's name is replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusbank.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
BATCH_CHARS = 1_000_000  # texts encoded together
CACHE_WORDS = 150_000  # per Python worker; older words are forgotten beyond it
NONE = np.int32(2**31 - 1)
INNER_SPACE = re.compile(r" (?<=\s )")  # a space after white space, such as NBSP or a line end


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """One vocabulary with its merge tables and word cache."""

    _loaded: dict[str, "Bpe"] = {}

    @classmethod
    def load(cls, path: str) -> "Bpe":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[c] for c in symbols], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.base = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)  # by rank
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

        byte_of = {c: b for b, c in enumerate(symbols)}
        spelled: dict[int, bytes] = {}
        for token, i in vocab.items():
            known = all(c in byte_of for c in token)
            spelled[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        spelled |= {i: t.encode() for t, i in self.added.items()}
        table_ = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.size = np.array([len(t) for t in table_], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(table_), dtype=np.uint8)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, NONE where there is no such merge."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each non-empty word as little-endian int32 bytes."""
        done: list[bytes] = [b""] * len(words)
        symbol = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        names = np.arange(len(words))
        size = np.array([len(w) for w in words], dtype=np.int64)
        inside = np.ones(len(symbol), dtype=bool)  # does a pair start here?
        inside[np.cumsum(size) - 1] = False
        rank = np.full(len(symbol), NONE, dtype=np.int32)
        at = np.flatnonzero(inside)
        rank[at] = self._rank(symbol[at], symbol[at + 1])
        while len(names):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            over = least == NONE
            if over.any():
                for w, s, n in zip(names[over].tolist(), start[over].tolist(),
                                   size[over].tolist()):
                    done[w] = symbol[s:s + n].tobytes()
                stay = np.repeat(~over, size)
                symbol, rank = symbol[stay], rank[stay]
                names, size, least = names[~over], size[~over], least[~over]
                if not len(names):
                    break
            found = np.flatnonzero(rank == np.repeat(least, size))
            # Of overlapping occurrences every second one counts, from the left.
            new_run = np.empty(len(found), dtype=bool)
            new_run[0] = True
            new_run[1:] = (found[1:] != found[:-1] + 1) | (rank[found[1:]] != rank[found[:-1]])
            nth = np.arange(len(found))
            nth -= np.maximum.accumulate(np.where(new_run, nth, 0))
            found = found[nth % 2 == 0]
            symbol[found] = self.made[rank[found]]
            last = rank[found + 1]  # of the pair that starts at the removed symbol
            keep = np.ones(len(symbol), dtype=bool)
            keep[found + 1] = False
            word = np.repeat(np.arange(len(names)), size)
            size = size - np.bincount(word[found], minlength=len(names))
            word, place = word[keep], np.cumsum(keep) - 1
            rank[found] = last
            symbol, rank = symbol[keep], rank[keep]
            at = place[found]
            for changed in (at, at[at > 0] - 1):
                paired = changed < len(symbol) - 1
                nxt = np.where(paired, changed + 1, changed)
                paired &= word[changed] == word[nxt]
                rank[changed] = np.where(paired, self._rank(symbol[changed], symbol[nxt]), NONE)
        return done

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if new:
            self.words.update(zip(new, self.merge([w.encode("utf-8") for w in new])))

    def _cut(self, text: str) -> list[str]:
        """Pieces that encode one by one: cut before spaces, for texts without ``INNER_SPACE``.

        The pattern's words hold a space only at their start, or are a run of white space of any
        kind; so where no space follows white space every space starts a word.
        """
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        jobs: list[list] = []  # per text: (whether pieces of it are cached, pieces) or an id
        fresh: set[str] = set()
        plain: set[str] = set()
        for text in texts:
            parts = self.cut.split(text) if self.cut else [text]
            job = []
            for k, part in enumerate(parts):
                if k % 2:
                    job.append(self.added[part])
                elif INNER_SPACE.search(part):
                    own = self.pattern.findall(part)
                    plain.update(own)
                    job.append((False, own))
                elif part:
                    own = self._cut(part)
                    fresh.update(own)
                    job.append((True, own))
            jobs.append(job)
        split = {p: self.pattern.findall(p) for p in fresh if p not in self.pieces}
        for own in split.values():
            plain.update(own)
        self._learn(plain)
        word, piece = self.words, self.pieces
        piece.update((p, b"".join([word[w] for w in own])) for p, own in split.items())
        out = []
        for job in jobs:
            ids = b"".join([
                np.int32(part).tobytes() if isinstance(part, int)
                else b"".join(map((piece if part[0] else word).__getitem__, part[1]))
                for part in job])
            out.append(np.frombuffer(ids, dtype="<i4"))
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids."""
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < len(self.size))
        ids = np.where(known, ids, 0)
        size = np.where(known, self.size[ids], 0)
        end = np.cumsum(size)
        source = np.repeat(self.start[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        spelled = self.bytes[source].tobytes()
        bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [spelled[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]


def slices(weights: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges of at most ``most`` weight, one row at least."""
    start = total = 0
    for k, weight in enumerate(weights):
        if k > start and total + weight > most:
            yield start, k
            start, total = k, 0
        total += weight
    if start < len(weights):
        yield start, len(weights)


def _extended(df: DataFrame, keep: list[str] | None, added: dict[str, T.DataType]) -> T.StructType:
    fields = [f for f in df.schema.fields
              if f.name not in added and (keep is None or f.name in keep)]
    return T.StructType([*fields, *[T.StructField(n, kind) for n, kind in added.items()]])


def _append(batch: pa.RecordBatch, schema: T.StructType, *columns: pa.Array) -> pa.RecordBatch:
    names = schema.fieldNames()
    kept = [batch.column(batch.schema.get_field_index(n)) for n in names[:-len(columns)]]
    return pa.RecordBatch.from_arrays([*kept, *columns], names=names)


def text_slices(batch: pa.RecordBatch, text: str, most: int):
    """(slice of the batch, its texts with null as empty) of about ``most`` bytes."""
    column = batch.column(batch.schema.get_field_index(text))
    size = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices(size, most):
        yield batch.slice(a, b - a), [t or "" for t in column.slice(a, b - a).to_pylist()]


def _id_lists(found: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ids of several texts as an Arrow array, flat, and their counts."""
    counts = np.array([len(ids) for ids in found], dtype=np.int32)
    flat = np.concatenate(found).astype(np.int32, copy=False)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), flat, counts


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids",
           keep: list[str] | None = None) -> DataFrame:
    """Adds the column ``ids`` (array<int>); ``keep`` names the columns to pass on (all)."""
    schema = _extended(df, keep, {ids: T.ArrayType(T.IntegerType())})

    def run(batches):
        model = Bpe.load(path)
        for batch in batches:
            for part, texts in text_slices(batch, text, BATCH_CHARS):
                yield _append(part, schema, _id_lists(model.encode(texts))[0])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """Adds the column ``text`` decoded from ``ids``; special tokens are not skipped."""
    schema = _extended(df, keep, {text: T.StringType()})

    def run(batches):
        model = Bpe.load(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in slices(counts.tolist(), BATCH_CHARS):
                flat = column.slice(a, b - a).flatten()
                values = flat.fill_null(-1).to_numpy(zero_copy_only=False)
                texts = model.decode(values, counts[a:b])
                yield _append(batch.slice(a, b - a), schema, pa.array(texts, pa.string()))

    return df.mapInArrow(run, schema)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids",
                  decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` and the text decoded from them, in one pass through Python."""
    schema = _extended(df, keep, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()})

    def run(batches):
        model = Bpe.load(path)
        for batch in batches:
            for part, texts in text_slices(batch, text, BATCH_CHARS):
                lists, flat, counts = _id_lists(model.encode(texts))
                yield _append(part, schema, lists, pa.array(model.decode(flat, counts), pa.string()))

    return df.mapInArrow(run, schema)


def decimal_sha256(ids):
    """Lowercase hex of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def op2_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, as counts and digests."""
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, path, keep=["doc_id"]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        decimal_sha256(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
