"""Token ids, packing, Re-Pair shards: exact against whole-text encoding."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_rows import documents, odd_documents, rows_of
from tickwarden.llm import packing, repair, tokenbin
from tickwarden.llm.tokens import END_ID, PieceEncoder, default_tokenizer

REFERENCE = Tokenizer.from_file(default_tokenizer())
ENCODER = PieceEncoder(default_tokenizer(), memo=40)
SF = "/root/testdata/sf0.001"


def whole(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids


def with_end(text):
    return np.array([*whole(text), END_ID], "<u4")


@pytest.mark.parametrize("memo", [0, 5, 100_000])
def test_pieces_encode_like_whole_texts(memo):
    enc = PieceEncoder(default_tokenizer(), memo=memo)
    texts = [r[1] for r in odd_documents()]
    texts += ["don't  stop.\n  he'll\tgo ", " lead", "trail ", "  ", "a\n b \n\n c", "x  y", "été. Über, naïve;", "\x1c a\x1f b"]
    for _ in range(2):
        for i in range(0, len(texts), 4):
            got = enc.encode(texts[i : i + 4])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole(t) for t in texts[i : i + 4]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab'stlé. \n\t,!<|1  中🙂", max_size=40), max_size=4))
def test_pieces_encode_like_whole_texts_generated(texts):
    enc = PieceEncoder(default_tokenizer(), memo=50)
    assert [np.frombuffer(g, "<u4").tolist() for g in enc.encode(texts)] == [whole(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé'ʼ1.,!& \n\r\t\x0b\x1c\x85\u00a0\u3000ɐא中́", max_size=30)), max_size=5))
def test_lines_and_punctuation_encode_like_whole_texts(texts):
    got = ENCODER.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole(t) for t in texts]


def test_library_sees_words_once_whatever_line_or_punctuation_is_beside_them():
    enc = PieceEncoder(default_tokenizer())
    given_to_library = []
    new = enc._encode_new
    enc._encode_new = lambda pieces, *lead: given_to_library.extend(pieces) or new(pieces, *lead)
    texts = ["start " + " ".join(f"{a}{p}\n{b}" for a in ("alpha", "beta") for b in ("gamma", "delta") for p in ("", ".", "!?"))]
    texts.append("start gamma, alpha beta: alpha; alpha\n\nbeta")
    assert [np.frombuffer(g, "<u4").tolist() for g in enc.encode(texts)] == [whole(t) for t in texts]
    # four words, "gamma" and "delta" behind a line feed, and the piece with an empty line
    assert sorted(given_to_library) == sorted(["alpha", "beta", "gamma", "gamma", "delta", "alpha\n\nbeta"])


# ------------------------------------------------------------------ packing


def test_open_sequences_best_fit_and_fullest_closes():
    bins = packing.OpenSequences(10, 2)
    assert not list(bins.place(6, "a"))  # free 4
    assert not list(bins.place(7, "b"))  # free 3
    assert not list(bins.place(2, "c"))  # best fit: b, free 1
    assert list(bins.place(5, "d")) == [["b", "c"]]  # a third would be too many: the fullest closes
    assert list(bins.place(4, "e")) == [["a", "e"]]  # exactly full
    assert list(bins.rest()) == [["d"]]


def check_packed(rows, texts_by_row, limit):
    """Pieces cover every document; sequences are gapless and within the limit."""
    expected = sorted(((d is None, d or 0, zlib.crc32(with_end(t).tobytes())) for d, t in texts_by_row))
    documents_seen, sequences = {}, {}
    for r in rows:
        documents_seen.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    ids_of = {}
    for d, t in texts_by_row:
        ids_of.setdefault(d, []).append(with_end(t))
    for d, parts in documents_seen.items():
        want = sorted(
            (p, s, n, zlib.crc32(ids[s : s + n].tobytes()))
            for ids in ids_of[d]
            for p, (s, n) in enumerate(cuts(len(ids), limit))
        )
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in parts) == want
    assert set(documents_seen) == set(ids_of) and expected
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    return len(sequences)


def cuts(n, limit):
    first = n % limit or limit
    out = [(0, min(first, n))]
    while sum(out[-1]) < n:
        out.append((sum(out[-1]), limit))
    return out


@pytest.mark.parametrize("rows_per_task,open_bins", [(250_000, 2048), (4, 2)])
def test_packing_odd_documents(spark, rows_per_task, open_bins):
    docs = documents(spark, clash=True)
    packed = packing.pack_documents(docs, open_bins=open_bins, rows_per_task=rows_per_task)
    check_packed(packed.collect(), [(r[0], r[1]) for r in odd_documents()], packing.MAX_TOKENS)
    again = packing.pack_documents(documents(spark), open_bins=open_bins, rows_per_task=rows_per_task)
    names = ["doc_id", "piece", "start", "length", "offset"]
    assert rows_of(packed, *names) == rows_of(again, *names)


def test_packing_fills_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    n = check_packed(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], packing.MAX_TOKENS)
    assert n <= 1.03 * sum(r.length for r in rows) / packing.MAX_TOKENS


def test_packing_empty_table_and_sequences(spark):
    assert packing.pack_documents(documents(spark, [])).count() == 0
    docs = documents(spark)
    out = packing.sequences(packing.pack_documents(docs, with_ids=True)).collect()
    total = sum(len(with_end(r[1])) for r in odd_documents())
    assert sum(r.length for r in out) == total == sum(len(r.token_ids) // 4 for r in out)


# ------------------------------------------------------------------ Re-Pair


@pytest.mark.parametrize("vocabulary", [50_257, 300_000])
def test_repair_round_trip_and_slices(vocabulary):
    rng = random.Random(5)
    docs = [[rng.randrange(6) for _ in range(rng.randrange(1, 400))] for _ in range(60)] + [[7] * 500, [1], [9, 9]]
    ids = np.concatenate([np.array(d, "<u4") for d in docs]).tobytes()
    data = repair.shard_bytes(list(range(62)) + [None], [len(d) for d in docs], ids, vocabulary, per_round=64)
    shard = repair.Shard(lambda at, n: data[at : at + n])
    assert shard.doc_ids == [*range(62), None] and len(shard.rules) > 64
    assert shard.symbols < 0.6 * shard.tokens
    for i, d in enumerate(docs):
        assert shard.documents(i, i + 1).tolist() == d
        a, b = sorted((rng.randrange(len(d) + 1), rng.randrange(len(d) + 1)))
        if a < b:
            assert shard.slice(i, a, b).tolist() == d[a:b]
    assert shard.documents(0, len(docs)).tolist() == [x for d in docs for x in d]


def test_repair_rules_are_pairs_of_earlier_symbols():
    ids = np.array([1, 2, 3, 4] * 100, "<u4")
    symbols, firsts, rules = repair.compress(ids, np.array([0]), 10, rounds=3, per_round=1)
    assert len(rules) == 3 and all(max(r) < 10 + i for i, r in enumerate(rules.tolist()))
    assert firsts.tolist() == [0, len(symbols)]
    with pytest.raises(repair.RepairError):
        repair.Shard(lambda at, n: b"x" * n)


def most_frequent_pair(symbols, firsts):
    """Count of the most frequent pair inside documents, overlaps left out."""
    counts, ends = {}, set(firsts.tolist())
    previous = None
    for i in range(len(symbols) - 1):
        pair = None if i + 1 in ends else (int(symbols[i]), int(symbols[i + 1]))
        if pair is not None and pair != previous:
            counts[pair] = counts.get(pair, 0) + 1
        previous = None if pair == previous else pair
    return max(counts.values(), default=0)


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 50_257, 500)
    docs = [np.concatenate((rng.integers(0, 50_257, 20), passage, rng.integers(0, 50_257, 20))) for _ in range(300)]
    # more frequent pairs than 16-bit symbols are left
    docs += [np.stack((np.arange(17_000), np.full(17_000, 50_256)), axis=1).ravel()] * 8
    ids = np.concatenate(docs).astype("<u4")
    lengths = [len(d) for d in docs]
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    symbols, firsts, rules = repair.compress(ids, starts, 50_257)
    assert most_frequent_pair(symbols, firsts) < repair.MIN_COUNT
    assert 50_257 + len(rules) > 1 << 16
    data = repair.shard_bytes(list(range(len(docs))), lengths, ids.tobytes(), 50_257)
    shard = repair.Shard(lambda at, n: data[at : at + n])
    assert shard.rule_sizes.max() > 400 and shard.wide.itemsize == 4
    assert np.array_equal(shard.documents(0, len(docs)), ids)
    assert shard.slice(7, 100, 300).tolist() == docs[7][100:300].tolist()


def test_repair_rounds_look_only_where_a_frequent_pair_may_begin(monkeypatch):
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 50_257, 400)
    docs = [np.concatenate((rng.integers(0, 50_257, 300), passage)) for _ in range(100)]
    starts = np.arange(0, 70_000, 700)
    looked, found = [], repair._frequent_pairs
    monkeypatch.setattr(repair, "_frequent_pairs", lambda s, at, *o: looked.append((len(s), len(at))) or found(s, at, *o))
    symbols, firsts, _ = repair.compress(np.concatenate(docs).astype("<u4"), starts, 50_257)
    assert len(looked) > 5 and most_frequent_pair(symbols, firsts) < repair.MIN_COUNT
    assert looked[0] == (70_000, 69_900) and looked[-1][0] > 30_000 and all(n < 1_000 for _, n in looked[-3:])


def test_repair_finds_a_frequent_pair_behind_a_full_bin_of_rare_ones():
    pairs = np.stack(np.meshgrid(np.arange(3000), np.arange(3000)), axis=-1).reshape(-1, 2).astype(np.uint32)
    keys = (pairs[:, 0] << np.uint32(16)) | pairs[:, 1]
    bins = (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - repair._BINS)
    rare = pairs[bins == np.bincount(bins).argmax()][:12]
    assert len(rare) == 12
    ids = np.concatenate((rare.ravel(), np.tile([4000, 4001], 9))).astype("<u4")
    symbols, _, rules = repair.compress(ids, np.arange(0, len(ids), 2), 50_257, per_round=1)
    assert rules.tolist() == [[4000, 4001]] and len(symbols) == len(ids) - 9


def expected_token_rows(rows):
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None, r[1] or ""))):
        ids = with_end(t)
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_token_files_odd_documents(spark):
    docs = documents(spark, clash=True)
    got = rows_of(tokenbin.round_trip(docs), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == expected_token_rows([(r[0], r[1]) for r in odd_documents()])
    assert tokenbin.round_trip(documents(spark, [])).count() == 0


def test_token_files_many_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shards = tokenbin.write_shards(docs.repartition(5), str(tmp_path), shard_tokens=2_000)
    assert shards.count() > 10
    got = rows_of(tokenbin.read_shards(shards, str(tmp_path)), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == expected_token_rows([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_running_totals_over_blocks(spark):
    rows = [(p, n, f"f{p}-{n}", 1, 10 * p + n, 1) for p in range(9) for n in range(3)]
    shards = spark.createDataFrame(rows, tokenbin.SHARDS_DDL)
    got = {r.file: r.base for r in tokenbin.with_offsets(shards, block=2).collect()}
    total = 0
    for r in rows:
        assert got[r[2]] == total
        total += r[4]
