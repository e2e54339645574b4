"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import pytest
import public_tokenizers
import tiktoken

from llm_rows import documents, odd_documents, rows_of
from tickwarden.llm import bytebpe

PATH, PATTERN = bytebpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def code():
    return bytebpe.Coder(PATH, PATTERN, memo=50)


def ids_of(code, text):
    import numpy as np

    return np.frombuffer(code.encode(text), "<u4").tolist()


def test_perfect_hash_is_minimal_and_knows_its_keys_only():
    for n in (0, 1, 2, 5, 1000):
        keys = [b"key%d" % i for i in range(n)]
        table = bytebpe.PerfectHash(keys)
        assert table.find(keys) == list(range(n))
        assert sorted(k for k in table.keys) == sorted(keys)  # every slot holds a key
        assert table.find([b"other%d" % i for i in range(2000)]) == [-1] * 2000
    with pytest.raises(ValueError):
        bytebpe.PerfectHash([b"a", b"a"])


def test_every_vocabulary_entry_is_found(code):
    tokens = list(code.ranks)
    assert [code.codes[i] for i in code.table.find(tokens)] == [code.ranks[t] for t in tokens]


def test_ids_match_the_library_on_white_space_and_odd_characters(code, library):
    spaces = [" ", "  ", "\n", "\t", " \n", "\n ", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "​", "᠎", "﻿"]
    words = ["a", "word", "Ünï", "中文字", "don't", "'s", "I'LL", "12", "٣", "½", "!?", "😀", "é", "<|endoftext|>", "\x00", "ᾳ", "_", "x" * 40]
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(spaces if rng.random() < 0.5 else words) for _ in range(rng.randint(0, 12)))
        assert ids_of(code, text) == library.encode_ordinary(text), repr(text)


def test_ids_match_the_library_on_every_plane_of_characters(code, library):
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(chr(c) for c in (rng.randrange(0x3000) if rng.random() < 0.8 else rng.randrange(0x1FFFF)
                                        for _ in range(8)) if not 0xD800 <= c < 0xE000)
        assert code.decode(code.encode(text)).decode() == text
        assert ids_of(code, text) == library.encode_ordinary(text), repr(text)


def test_long_piece_and_short_stretches(code, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "STRETCH", 10)
    for text in ["ab" * 3000, "word  and " * 500 + " ", "  \n  x" * 400, " " * 300, "no blank\n" * 100]:
        assert ids_of(code, text) == library.encode_ordinary(text)


def test_memo_stays_bounded(code):
    for i in range(300):
        code.encode(f"some new words number{i} and{i}")
        code.encode(f"again number{i} and{i}")
    assert 25 <= len(code.memo) <= 50


def test_round_trip_of_odd_documents(spark, library):
    docs = documents(spark, clash=True)
    got = rows_of(bytebpe.round_trip(docs.repartition(3)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for doc, text, *_ in odd_documents():
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bytebpe.round_trip(docs.limit(0)).count() == 0


def test_encode_and_decode_are_inverse(spark):
    docs = documents(spark)
    encoded = bytebpe.encode(docs)
    assert rows_of(encoded, "doc_id", "n_tokens") == rows_of(bytebpe.round_trip(docs), "doc_id", "n_tokens")
    back = rows_of(bytebpe.decode(encoded).selectExpr("doc_id", "decode(bytes, 'UTF-8') AS t"), "doc_id", "t")
    assert back == rows_of(docs.selectExpr("doc_id", "coalesce(text, '') AS t"), "doc_id", "t")


def test_vocabulary_is_a_parameter(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("b", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    docs = documents(spark, [(1, "Some plain words, twice: some plain words.", "en", "a", 1)])
    assert bytebpe.encode(docs, path).first()["n_tokens"] == len(other.encode_ordinary(docs.first()["text"]))
