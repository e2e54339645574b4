"""Prefix trie of rebuilt conversations against a plain trie."""

import hashlib
import random
import zlib

import pytest

from llm_rows import rows_of
from tickwarden.llm import prefix_trie

DDL = "conv_id bigint, turn bigint, role string, text string, `a.b` string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows, period=20, heads=4):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = tuple(convs.get(c - c % period, [])[:h] + own[h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for seq, who in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        ends = sorted(c for c in who if len(rebuilt[c]) == len(seq))
        out.append((
            min(who), len(seq), min(members[seq[:-1]]) if seq else None, len(who),
            sum(len(s) == len(seq) + 1 for s in below),
            sum(not any(len(o) == len(s) + 1 and o[: len(s)] == s for o in below) for s in below),
            sum((len(members[s]) - 1) * len(s[-1][1].encode().split()) for s in below if s),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def random_rows(seed, n=90):
    """Short alphabets (so that prefixes meet), nulls, ties and copies."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(160), n):
        for k in range(rng.choice([0, 1, 1, 2, 3, 5, 7])):
            rows.append((c, rng.choice([k, k, k, None]), rng.choice(["u", "u", "a", None]),
                         rng.choice(["a b", "a b", "c", "", None]), "x", "y"))
    rows += [(None, 1, "u", "lost", "x", "y"), *rng.sample(rows, 9)]
    rng.shuffle(rows)
    return rows


def trie_of(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    return rows_of(prefix_trie.trie(df.repartition(3) if rows else df), *COLUMNS)


@pytest.fixture
def split_tasks(spark):
    """Every range of turns stays a task of its own."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_a_plain_trie(spark, split_tasks, seed):
    rows = random_rows(seed)
    assert trie_of(spark, rows) == plain_trie(rows)


def test_a_conversation_with_a_third_of_the_rows_spreads_over_tasks(spark, split_tasks, monkeypatch):
    monkeypatch.setattr(prefix_trie, "DEPTH_BUCKET", 7)
    rows = random_rows(3, 40)
    rows += [(c, k, "u", f"t{k % 3}", "x", "y") for c in (40, 43, 47) for k in range(60)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_deeply_nested_branches(spark):
    # conversation c has c turns "a" and then "b": every chain hangs from the one before
    rows = [(c * 20, k, "u", "a" if k < c else "b", "x", "y") for c in range(12) for k in range(c + 1)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_many_equal_conversations_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 5)
    rows = [(20 * c, 0, "u", "same", "x", "y") for c in range(64)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_long_text_and_turnless_conversations(spark):
    long_text = "word " * 60_000
    # 1, 21 ... have no base; some have no turn after their head and end at the root
    rows = [(c, 0, "u", long_text, "x", "y") for c in range(1, 400, 20)]
    got = trie_of(spark, rows)
    assert got == plain_trie(rows)
    assert [r[4] for r in got if r[1] == 0] == [1]


def test_empty_table(spark):
    assert trie_of(spark, []) == []


def test_state_is_the_same_from_any_cut():
    rng = random.Random(5)
    turns = [(c, rng.getrandbits(100), 1, i) for i, c in enumerate(sorted(rng.choices([0, 3, 5, 20, 27, 41], k=60)))]
    whole = prefix_trie.Rebuilder(12345, 20, 4)
    cuts = sorted(rng.sample(range(1, 60), 12))
    state = prefix_trie.Rebuilder(12345, 20, 4)
    for a, b in zip([0, *cuts], [*cuts, 60]):
        summary = prefix_trie.Summary(12345, 20, 4)
        for t in turns[a:b]:
            summary.turn(*t)
            if whole.conv != t[0]:
                list(whole.begin(t[0]))
            list(whole.turn(*t[1:]))
        state = prefix_trie.carried(summary.text(), state)
        assert state.state() == whole.state()


def test_a_collision_is_noticed_and_another_seed_taken(spark, monkeypatch):
    seen = []
    real = prefix_trie._verified

    def check(turns, nodes):
        seen.append(real(turns, nodes))
        return len(seen) > 1 and seen[-1]

    monkeypatch.setattr(prefix_trie, "_verified", check)
    rows = random_rows(4, 20)
    assert trie_of(spark, rows) == plain_trie(rows)
    assert seen == [True, True]


def test_verification_rejects_unequal_turns(spark):
    turns = spark.createDataFrame([("d", "u", "a"), ("d", "u", "b")], "digest string, role string, text string")
    nodes = prefix_trie._grouped(spark.createDataFrame([(0, 1, 1, 5, 5, 0, 0, 1, 1, 1, 1)], prefix_trie._ROWS_DDL))
    assert not prefix_trie._verified(turns, nodes)
    rows = [(0, 1, 1, 5, 5, 0, 0, 1, 1, 1, 1), (0, 2, 1, 5, 5, 0, 0, 1, 2, 1, 2)]
    nodes = prefix_trie._grouped(spark.createDataFrame(rows, prefix_trie._ROWS_DDL))
    assert not prefix_trie._verified(turns.limit(1), nodes)
