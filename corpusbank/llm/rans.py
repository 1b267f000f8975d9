"""Token-id files coded with static range asymmetric numeral systems (rANS).

File format: a Parquet folder whose rows are segments in ascending document order.  A segment
holds whole documents: their numbers, their id counts, and a payload

    magic "rAN1", then six unsigned 32-bit numbers: ids, distinct ids, blocks, lanes, block length,
    length of the compressed table; then
    table      zlib: the distinct ids and their frequencies (unsigned 32-bit each, sum 2**SCALE)
    checkpoints, one per block: crc32 of its ids, position of its first word (unsigned 32 bit),
               then one 64-bit start state per lane
    words      unsigned 32 bit, the streams of all blocks, one after another

All blocks of a segment share its frequency table.  A block's ids are dealt out in turn to ``lanes``
interleaved coders that share one stream; a block decodes on its own from its checkpoint, and its
ids are compared with the checksum.  Coding and decoding advance all lanes of all blocks of a
segment together in numpy.  Spark's commit protocol keeps the files of lost tasks out.

Writing deals the documents out by ranges of their number and sorts inside a range, so the texts
are shuffled once and no task holds more than a range; a segment closes at ``SEGMENT_IDS``.

Defined cases: a null or empty text has only the end id; rows are in the order of doc_id (null
first), then text; repeated rows are separate documents; an empty table gives an empty folder that
reads back as no rows; a document of any length lies whole in one segment; other columns are
ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusbank.llm.bpe import text_slices
from corpusbank.llm.common import table
from corpusbank.session import new_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SEGMENT_IDS = 2_000_000
BLOCK_IDS = 16_384
LANES = 32
SCALE = 20  # frequencies add up to 2**SCALE
LOW = np.uint64(1 << 31)
BATCH_CHARS = 2_000_000
CACHE_WORDS = 600_000  # per Python worker, in two generations
#: Marks behind a letter that has no other lower case or composed form ending in a mark.
MARKS = "([a-z\u00DF-\u00F6\u00F8-\u00FF])([.,;:!?*$%&#]+)"
SIMPLE = re.compile("[a-z\u00DF-\u00F6\u00F8-\u00FF]+").fullmatch
SPECIAL_CASE = re.compile("[^\x00-\u012F]")  # below, lower() is the normaliser's lower case


def quantised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Positive frequencies that add up to ``2**scale``, near to ``counts`` in proportion."""
    total = 1 << scale
    if len(counts) > total:
        raise ValueError("more distinct ids than frequency slots")
    share = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    gap = total - int(share.sum())
    order = np.argsort(-share, kind="stable")
    if gap > 0:
        share[order[0]] += gap
    while gap < 0:  # take from the largest
        room = np.minimum(share[order] - 1, np.maximum(1, share[order] // 8))
        take = np.minimum(room, np.maximum(0, -gap - (np.cumsum(room) - room)))
        share[order] -= take
        gap += int(take.sum())
    return share


def compress(ids: np.ndarray) -> bytes:
    """Payload of a segment."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n = len(ids)
    if n and ids.max() < 1 << 22:  # a table of counts instead of a sort
        counts = np.bincount(ids)
        known = np.flatnonzero(counts).astype(np.uint32)
        place = (np.cumsum(counts > 0) - 1)[ids]
        counts = counts[known]
    else:
        known, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    length = min(BLOCK_IDS, -(-n // LANES) * LANES)
    blocks, steps = -(-n // length) if n else 0, length // LANES
    if n:
        share = quantised(counts)
        coded = zlib.compress(np.stack([known, share.astype(np.uint32)]).astype("<u4").tobytes(), 6)
    else:
        share, coded = np.zeros(0, dtype=np.int64), b""
    head = b"rAN1" + struct.pack("<6I", n, len(known), blocks, LANES, length, len(coded))
    if not n:
        return head
    freq = share.astype(np.uint64)
    low = np.cumsum(freq) - freq
    padded = np.full(blocks * length, share.argmax(), dtype=np.int64)  # what lies past the end
    padded[:n] = place
    symbol = padded.reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), LOW, dtype=np.uint64)
    spilled = np.zeros((blocks, steps, LANES), dtype=bool)
    word = np.zeros((blocks, steps, LANES), dtype=np.uint32)
    shift, bits = np.uint64(63 - SCALE), np.uint64(SCALE)
    half, mask = np.uint64(32), np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        f, c = freq[symbol[:, t]], low[symbol[:, t]]
        # f << shift overflows only for f == 2**SCALE, whose single id never spills.
        out = (state >> shift) >= f
        spilled[:, t] = out
        word[:, t] = (state & mask).astype(np.uint32)
        state = np.where(out, state >> half, state)
        whole = state // f
        state = (whole << bits) + (state - whole * f) + c
    per_block = spilled.reshape(blocks, -1).sum(axis=1)
    first = np.cumsum(per_block) - per_block
    marks = []
    for b in range(blocks):
        crc = zlib.crc32(ids[b * length:(b + 1) * length].astype("<u4").tobytes())
        marks.append(struct.pack("<2I", crc, int(first[b])) + state[b].astype("<u8").tobytes())
    return b"".join([head, coded, *marks, word[spilled].astype("<u4").tobytes()])


def decompress(payload: bytes) -> np.ndarray:
    """Ids of a segment; raises ValueError for a damaged stream or checksum."""
    if payload[:4] != b"rAN1":
        raise ValueError("not a segment")
    n, distinct, blocks, lanes, length, packed = struct.unpack_from("<6I", payload, 4)
    if not n:
        return np.zeros(0, dtype=np.uint32)
    at = 28
    known, share = np.frombuffer(zlib.decompress(payload[at:at + packed]), "<u4").reshape(2, distinct)
    at += packed
    marks = np.frombuffer(payload, np.uint8, blocks * (8 + 8 * lanes), at).reshape(blocks, -1)
    crcs, pointer = np.ascontiguousarray(marks[:, :8]).view("<u4").T
    state = np.ascontiguousarray(marks[:, 8:]).view("<u8").astype(np.uint64)
    words = np.frombuffer(payload, "<u4", offset=at + marks.size)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    freq = share.astype(np.uint64)
    low = np.cumsum(freq) - freq
    slot_of = np.repeat(np.arange(distinct, dtype=np.int32), share)
    steps = length // lanes
    found = np.empty((blocks, steps, lanes), dtype=np.int32)
    bits, slots, half = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64(32)
    pointer = pointer.astype(np.int64)[:, None]
    for t in range(steps):
        slot = state & slots
        s = slot_of[slot.astype(np.int64)]
        found[:, t] = s
        state = freq[s] * (state >> bits) + slot - low[s]
        need = state < LOW
        taken = np.cumsum(need, axis=1)
        at_word = np.where(need, pointer + taken - 1, len(words) - 1)
        state = np.where(need, (state << half) | words[at_word], state)
        pointer = pointer + taken[:, -1:]
    if (state != LOW).any():  # every coder has to end where the encoder began
        raise ValueError("damaged stream")
    ids = known[found.reshape(-1)[:n]]
    for b in range(blocks):
        part = ids[b * length:(b + 1) * length]
        if zlib.crc32(part.astype("<u4").tobytes()) != int(crcs[b]):
            raise ValueError(f"block {b} differs from its checksum")
    return ids


class WordIds:
    """Ids of texts by the tokenizers library, word by word with a bounded cache.

    The normaliser and the pattern of this tokenizer never look across white space, so a text's
    ids are those of its parts between spaces and line ends; marks behind a letter, ``MARKS``, begin
    a word of their own; and texts without letters beyond Latin may be lower-cased first, as the
    normaliser does.
    """

    _loaded: dict[str, "WordIds"] = {}

    @classmethod
    def load(cls, path: str) -> "WordIds":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words not met since the last change of generation
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)  # does the id end a word?
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    @staticmethod
    def _single(word: str) -> bool:
        """Only letters, before and after normalising: certainly one word of the tokenizer."""
        if SIMPLE(word):
            return True
        lower = word.lower()
        return word.isalpha() and lower.isalpha() and is_normalized("NFC", lower) and (
            is_normalized("NFC", word))

    def _add(self, new: list[str]) -> None:
        """Encodes new words; words of letters go many to a text and are told apart by word ends."""
        single = [w for w in new if self._single(w)]
        for start in range(0, len(single), 1000):
            words = single[start:start + 1000]
            encoded = self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)
            ids = np.array(encoded[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(words):
                raise ValueError("words and word ends differ")
            raw = ids.tobytes()
            for word, a, b in zip(words, [0, *cuts[:-1].tolist()], cuts.tolist()):
                self.words[word] = raw[4 * a:4 * b]
        other = [w for w in new if not self._single(w)]
        found = self.model.encode_batch_fast(other, add_special_tokens=False)
        for word, encoded in zip(other, found):
            self.words[word] = np.array(encoded.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Arrow splits the texts and finds the distinct words; the ids of all words are gathered
        from those of the distinct ones.
        """
        if len(self.words) > CACHE_WORDS // 2:
            self.older, self.words = self.words, {}
        known, older = self.words, self.older
        plain = pa.array([
            (t if "<|" in t or not t.isascii() and SPECIAL_CASE.search(t) else t.lower())
            .replace("\n", " ") for t in texts], pa.string())
        parts = pc.split_pattern(pc.replace_substring_regex(plain, MARKS, r"\1 \2"), " ")
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in known]
        known.update((w, older[w]) for w in new if w in older)
        self._add([w for w in new if w not in older])
        found = list(map(known.__getitem__, distinct))
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        begin = np.cumsum(size) - size
        index = coded.indices.to_numpy()
        each = size[index]
        until = np.append(0, np.cumsum(each))
        at = np.repeat(begin[index] - until[:-1], each) + np.arange(until[-1])
        raw = np.frombuffer(b"".join(found), dtype="<u4")[at].tobytes()
        cuts = (until[parts.offsets.to_numpy()] * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def write_ids(docs: DataFrame, out: str, tokenizer: str, doc_id: str = "doc_id",
              text: str = "text", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes the documents and writes their ids, in ascending ``doc_id``, to the folder ``out``."""
    end = struct.pack("<I", end_id)

    def run(batches):
        model = WordIds.load(tokenizer)
        held: list[bytes] = []
        names: list[int | None] = []
        total = number = 0
        place = 0

        def segment():
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([len(ids)], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                 pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int64())),
                 pa.array([compress(ids)], pa.binary())],
                names=["range_no", "segment_no", "n_ids", "doc_ids", "counts", "payload"])

        for batch in batches:
            for part, texts in text_slices(batch, "_text", BATCH_CHARS):
                place = part.column(2)[0].as_py()
                for name, coded in zip(part.column(0).to_pylist(), model.encode(texts)):
                    names.append(name)
                    held.append(coded + end)
                    total += len(coded) // 4 + 1
                    if total >= segment_ids:
                        yield segment()
                        held, names, total, number = [], [], 0, number + 1
        if names:
            yield segment()

    laid = (
        docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
        .repartitionByRange("_id").sortWithinPartitions("_id", "_text")
        .withColumn("_range", F.spark_partition_id())
    )
    laid.mapInArrow(run, "range_no int, segment_no int, n_ids long, doc_ids array<long>, "
                         "counts array<long>, payload binary") \
        .write.option("compression", "none").parquet(out)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (``with_ids``) ids of every document in ``folder``.

    ``start`` counts the ids of all documents before it: the totals of the segments, one row
    each, are summed inside their range and over the ranges.
    """
    segments = spark.read.parquet(folder)
    sizes = segments.select("range_no", "segment_no", "n_ids")
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("range_no").agg(F.sum("n_ids").alias("_n")).select(
        "range_no", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = (Window.partitionBy("range_no").orderBy("segment_no")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.join(ranges, "range_no").select(
        F.col("range_no").alias("_range"), F.col("segment_no").alias("_segment"),
        (F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("_start"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decompress(row["payload"])
                ends = np.cumsum(row["counts"], dtype=np.int64)
                first = ends - row["counts"]
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(first.tolist(), ends.tolist())]
                n = len(ends)
                columns = [pa.array([row["range_no"]] * n, pa.int32()),
                           pa.array([row["segment_no"]] * n, pa.int32()),
                           pa.array(row["doc_ids"], pa.int64()), pa.array(first, pa.int64()),
                           pa.array(row["counts"], pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    bounds = pa.array(np.append(0, ends), pa.int32())
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=[
                    "range_no", "segment_no", "doc_id", "first", "n_tokens", "ids_crc32",
                    *["ids"] * with_ids])

    rows = segments.select("range_no", "segment_no", "doc_ids", "counts", "payload").mapInArrow(
        run, "range_no int, segment_no int, doc_id long, first long, n_tokens long, "
             "ids_crc32 long" + ", ids array<long>" * with_ids)
    return rows.join(starts, (F.col("range_no") == F.col("_range"))
                     & (F.col("segment_no") == F.col("_segment"))).select(
        "doc_id", (F.col("_start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32",
        *["ids"] * with_ids)


def op6_rans_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents written as rANS files and read back: place, length and checksum of the ids."""
    out = new_path(spark, "rans")
    write_ids(table(spark, sf_dir, "documents"), out, public_tokenizers.path(VOCABULARY))
    return read_ids(spark, out, with_ids=False)
