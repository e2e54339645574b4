"""SimHash components and LM scores against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_rows import documents, odd_documents, rows_of
from tickwarden.llm import components, lm, simhash
from tickwarden.llm.common import words

# ------------------------------------------------------------------ SimHash


def _plain_fingerprint(text):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_components(prints):
    """doc id -> (fingerprint, smallest id reachable), all pairs compared."""
    parent = {d: d for d, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 3:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: (format(f, "016x"), find(d)) for d, f in prints}


def test_fingerprints_match_the_definition():
    for text in ["", "One", "one two", "A b C d", "É é a", *[r[1] for r in odd_documents() if r[1] and len(r[1]) < 5000]]:
        assert simhash.fingerprint(text) == _plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def _clustered(n, seed):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(4 * n):  # chains and near copies
        x = rng.choice(out)
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("limit", [4096, 3])
def test_tree_links_connect_exactly_the_near_pairs(spark, limit):
    prints = _clustered(60, 1) + [2**64 - 1 - (1 << i) for i in range(40)]
    prints = sorted(set(prints))
    rows = [(i, p - (1 << 64) if p >= 1 << 63 else p) for i, p in enumerate(prints)]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "node bigint, bits bigint"), tree_limit=limit)
    labels = dict(tuple(r) for r in components.connected_components(links).collect())
    want = _plain_components(list(enumerate(prints)))
    assert {i: labels.get(i, i) for i in range(len(prints))} == {i: c for i, (_, c) in want.items()}
    assert links.count() < 16 * len(prints) * max(1, len(prints) // limit)


def test_bk_tree_finds_every_match():
    values = np.array(_clustered(100, 3), np.uint64)
    got = {(m, int(q)) for m, near in simhash.BKTree(values).matches(values, 3) for q in near}
    d = np.bitwise_count(values[:, None] ^ values[None, :])
    assert got == set(zip(*map(lambda x: x.tolist(), np.where(d <= 3))))
    small = values[:40].tolist()
    assert {tuple(sorted(p)) for p in simhash._small_links(small, 3)} == {p for p in got if p[0] < p[1] < 40}


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(1, 40)] + [(i, 900 + i) for i in range(1, 40)]
    random.Random(4).shuffle(chain)
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in [500, *range(1, 40), *range(901, 940)]} == {1}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = _plain_components([(d, _plain_fingerprint(t)) for d, t in rows])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_near_duplicates_odd_documents(spark):
    docs = documents(spark, clash=True)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(odd_documents())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].fingerprint == "0" * 16 and by_id[1].component_id == by_id[12].component_id == 1
    assert by_id[5].component_id == 4
    nulls = sorted((r.fingerprint, r.component_id) for r in got if r.doc_id is None)
    assert ("0" * 16, 1) in nulls
    kept = simhash.keep_one(docs)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert kept.columns == docs.columns and ids == sorted({r.component_id for r in got if r.doc_id is not None})
    # both rows without an id are near-duplicates of rows with one
    assert sum(r.doc_id is None for r in kept.collect()) == 0
    assert simhash.keep_one(documents(spark, [])).count() == simhash.near_duplicates(documents(spark, [])).count() == 0


# ---------------------------------------------------------------- LM scores


def _plain_scores(rows):
    single, pairs = Counter(), Counter()
    for _, t in rows:
        ws = words(t)
        single.update(ws)
        pairs.update(zip(ws, ws[1:]))
    total = sum(single.values())
    out = []
    for d, t in rows:
        ws, s, off = words(t), 0.0, 0
        for i, w in enumerate(ws):
            if i and pairs[ws[i - 1], w] >= lm.MIN_COUNT:
                s += math.log(pairs[ws[i - 1], w] / single[ws[i - 1]])
            else:
                s += math.log(single[w] / total) + (math.log(lm.BACKOFF) if i else 0.0)
                off += bool(i)
        out.append((d, len(ws), off, s))
    return sorted(out, key=lambda r: (str(r[0]), r[1:]))


@pytest.mark.parametrize("block_words,part_bytes", [(lm.BLOCK_WORDS, lm.PART_BYTES), (500, 1 << 14)])
def test_scores_match_plain_counting(spark, monkeypatch, block_words, part_bytes):
    monkeypatch.setattr(lm, "PART_BYTES", part_bytes)
    rows = [(r[0], r[1]) for r in odd_documents()]
    docs = documents(spark, clash=True)
    got = sorted((tuple(r) for r in lm.score(docs).select("doc_id", "n_words", "backed_off", "log_score").collect()),
                 key=lambda r: (str(r[0]), r[1:]))
    want = _plain_scores(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])
    assert lm.score(documents(spark, [])).count() == 0
