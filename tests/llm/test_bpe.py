"""BPE against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusbank.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def model():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def texts():
    rng = random.Random(5)
    parts = ["the ", " and", "  ", "   ", "\n", "\t", " \n", "\r\n", "idiot", "don't", "I'LL", "x'S",
             "<|endoftext|>", "<|endof", "é", "ñ", "ß", "日本", " ", "\u0085", " ", "　", "\x1c",
             "\x1f", "​", "é", "😀", "12345", "½", "a" * 37, "!?!", "_", "İ", "�", "\x00", "-", ".",
             "aaab", "http://x.y", " ", "hello", "WORLD"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    return ["", " ", "  ", "<|endoftext|>", "a" * 50_000,
            "".join(rng.choice("abcdefg") for _ in range(20_000)), *made]


def test_matches_the_library(model):
    own = bpe.Bpe(PATH)
    given = texts()
    for text, ids in zip(given, own.encode(given)):
        want = model.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text[:80])


def test_runs_of_mixed_white_space(model):
    own = bpe.Bpe(PATH)
    given = ["a \xa0 \xa0 b", "a \xa0 \xa0b", "a \xa0 \xa0\nb", "\xa0 \xa0 \xa0", "a\n \nb", "a\n b", "\t \t b",
             "x y\n\n z", "a \u3000 \u2003 \x85 b", "a \x1c \x1d b", " \xa0 b<|endoftext|> \xa0 \xa0 b"]
    rng = random.Random(9)
    white = [" ", " ", "\xa0", "\n", "\t", "\u3000", "\x85", "\x1c", "\r"]
    given += ["".join(rng.choice([*white, "b", " c"]) for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    for text, ids in zip(given, own.encode(given)):
        assert ids.tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_cache_limit_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    own = bpe.Bpe(PATH)
    for text in texts()[6:120]:
        assert own.encode([text])[0].tolist() == model.encode(text, add_special_tokens=False).ids


def test_decode_matches_the_library(model):
    rng = random.Random(6)
    own = bpe.Bpe(PATH)
    runs = [[rng.randrange(50_257) for _ in range(rng.randint(0, 9))] for _ in range(500)]
    import numpy as np
    flat = np.array([i for r in runs for i in r])
    for run, text in zip(runs, own.decode(flat, np.array([len(r) for r in runs]))):
        assert text == model.decode(run, skip_special_tokens=False)


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "The cat\n sat", None), (3, "The cat\n sat", None),
            (None, "é" * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = bpe.decode(bpe.encode(df, PATH), PATH, text="again").collect()
    assert [r.again for r in back] == [t or "" for _, t, _ in rows]
    assert [len(r.ids) > 0 for r in back] == [bool(t) for _, t, _ in rows]
    assert back[0].text is None and bpe.encode(df.limit(0), PATH).count() == 0
    both = bpe.encode_decode(df, PATH, decoded="ids2").collect()
    assert [(r.ids, r.ids2) for r in both] == [(r.ids, r.again) for r in back]
    odd = spark.createDataFrame([(1, None), (2, [None, 5, 99_999_999])], "k int, ids array<int>")
    assert [r.text for r in bpe.decode(odd, PATH).collect()] == ["", "&"]


def test_query_digests(spark, tmp_path, model):
    import hashlib

    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(99, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op2_bpe_encode_decode(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == digest(",".join(map(str, ids)))
        assert got[i].decoded_sha256 == digest(model.decode(ids, skip_special_tokens=False))
