"""rANS round trips, the tokenizer's word cache, and the files against a plain loop."""

import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusbank.llm import rans

PATH = public_tokenizers.path(rans.VOCABULARY)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 5), max_size=300))
def test_round_trip(ids):
    assert rans.decompress(rans.compress(np.array(ids, dtype=np.uint32))).tolist() == ids


def test_many_blocks_and_skew():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.2, 300_000), 49_000).astype(np.uint32)
    payload = rans.compress(ids)
    assert (rans.decompress(payload) == ids).all()
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() / 8 * len(ids)
    assert len(payload) < 1.05 * entropy + 80_000
    every = np.arange(200_000, dtype=np.uint32)
    assert (rans.decompress(rans.compress(every)) == every).all()
    assert (rans.decompress(rans.compress(np.full(50_000, 7, np.uint32))) == 7).all()


def test_damage_is_found():
    payload = bytearray(rans.compress(np.arange(1000, dtype=np.uint32) % 50))
    payload[-60] ^= 1
    with pytest.raises(ValueError):
        rans.decompress(bytes(payload))


def library():
    model = Tokenizer.from_file(PATH)
    model.no_truncation()
    model.no_padding()
    return model


def texts():
    rng = random.Random(7)
    parts = ["The", " cat", "  ", "\n", ".", ",", "!?", "'S", "don't", "İstanbul", "É", "é", "ΟΔΟΣ",
             "<|endoftext|>", "<|startoftext|>", "12", "½", " ", " ", "a.b", "x,", "...", "ß",
             "日本", "😀", "\x1c", "K", "'", "’s", "à.", "É."]
    return ["", " ", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
                       for _ in range(800)]]


def test_word_cache_matches_the_library():
    model, own = library(), rans.WordIds(PATH)
    for text, got in zip(texts(), own.encode(texts())):
        want = model.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)


def test_letters_that_end_in_a_mark_when_normalised():
    model, own = library(), rans.WordIds(PATH)
    odd = [chr(c) for c in range(0x110000) if chr(c).isalpha() and not (
        unicodedata.normalize("NFC", chr(c).lower())[-1].isalpha()
        and unicodedata.normalize("NFC", chr(c)).lower()[-1].isalpha())]
    assert "\u0130" in odd and "\u0958" in odd
    given = [f"{before}{c}{tail}x" for c in odd for before in ("", "TAR")
             for tail in (".", ", 12", "!?", "\u0307.", " ")]
    given += ["TARİHİ, 12", "Kİ!", "<|ENDOFTEXT|> a", "a <|endoftext|>.", "<|EndOfText|>É."]
    for text, got in zip(given, own.encode(given)):
        want = model.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)


def test_document_longer_than_a_segment(spark, tmp_path):
    """A document of more ids than a segment holds lies whole in one of its own."""
    rows = [(1, "a b"), (2, "İstanbul, TARİHİ. " * 60_000), (3, "c")]
    out = f"{tmp_path}/long"
    rans.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), out, PATH,
                   segment_ids=10_000)
    model = library()
    got = {r.doc_id: r for r in rans.read_ids(spark, out).collect()}
    for doc_id, text in rows:
        assert got[doc_id].ids == model.encode(text, add_special_tokens=False).ids + [2]


def test_files(spark, tmp_path):
    rows = [(i * 7 % 503, t) for i, t in enumerate(texts()[:400])] + [(600, None), (None, "x"),
                                                                     (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    out = f"{tmp_path}/files"
    rans.write_ids(df.repartition(5), out, PATH, segment_ids=700)
    got = rans.read_ids(spark, out).collect()
    model, start = library(), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    by_start = sorted(got, key=lambda r: r.start)
    assert len(by_start) == len(rows)
    for (doc_id, text), r in zip(order, by_start):
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc_id, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty(spark, tmp_path):
    out = f"{tmp_path}/none"
    rans.write_ids(spark.createDataFrame([], "doc_id long, text string"), out, PATH)
    assert rans.read_ids(spark, out).count() == 0
