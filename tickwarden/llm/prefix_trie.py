"""Prefix trie of rebuilt conversations by composable fingerprints.

A conversation c is rebuilt from two stored parts: the *head*, the first
``h`` turns of its base conversation ``c - c % period`` (``h = crc32(c) %
heads``), and its own turns after its first ``h``.  Every distinct
sequence of first d rebuilt turns is a node; its members are the rebuilt
conversations that start with it.

Method: a sequence of turns has the fingerprint (H, B^n) of a monoid,
``(H, x) . (G, y) = (H y + G, x y)`` modulo 2^127 - 1, with the product of
the empty sequence (0, 1).  The fingerprint of a rebuilt prefix is the
product of the base's head and of the conversation's own suffix, so it is
combined from the two without a rebuilt text ever being put together.
Rows carry the fingerprint, the parent's fingerprint and a reference to
the stored turn that ends the prefix.  Groups of equal fingerprints are
verified: all members must have the same parent fingerprint and the same
last turn, and all turns of one turn digest must have the same role and
text; by induction over the depth, a group then is one sequence.  If a
check ever failed, everything is done again with other multipliers.

Distribution: turns are sorted by range over (conversation, turn), so a
conversation of any length spreads over tasks.  A task multiplies its own
turns; the products of a task's first and last conversation (one small
row a task) go through the driver and come back as the carry of the next
task.  A node is owned by its smallest member, and the nodes of one owner
form a chain; sums over subtrees are sums over chains (pointer doubling
over one row per chain, log2 of the nesting in rounds) and a suffix sum
within a chain, in buckets of depth.  Members that end at a node are
joined to chunks of text before one task hashes them in order.

Defined cases: a null conv_id takes no part; a null turn sorts first; a
null role or text is empty; rows of equal (conv_id, turn) sort by role
and text, equal rows count once each; ``c % period`` is the non-negative
remainder; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.llm.common import WORD_PATTERN, batches, prepare, stored, worker_task

PERIOD = 20
HEADS = 4
PRIME = (1 << 127) - 1
SEEDS = 8
DEPTH_BUCKET = 65_536
IDS_PER_CHUNK = 4_096
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

_LOW = (1 << 64) - 1


def _words_of(fingerprint: int) -> tuple[int, int]:
    """A fingerprint as two signed 64-bit integers."""
    low = fingerprint & _LOW
    return fingerprint >> 64, low - (1 << 64) if low >> 63 else low


def head_length(conv_id: int, heads: int) -> int:
    return zlib.crc32(b"%d" % conv_id) % heads


class Rebuilder:
    """Walks turns in the order of (conversation, turn) and yields the rows
    of the rebuilt conversations.  The state between two turns is small and
    can be handed from one task to the next as JSON."""

    def __init__(self, multiplier: int, period: int, heads: int, state: str | None = None) -> None:
        self.multiplier, self.period, self.heads = multiplier, period, heads
        if state:
            (self.conv, self.n, self.base, self.base_head, self.head, self.hash, self.power, self.depth) = json.loads(state)
        else:
            self.conv, self.n, self.base, self.base_head = None, 0, None, []
            self.head, self.hash, self.power, self.depth = 0, 0, 1, 0

    def state(self) -> str:
        return json.dumps(
            [self.conv, self.n, self.base, self.base_head, self.head, self.hash, self.power, self.depth]
        )

    def _skip(self) -> int:
        # a base conversation is its own head: all its turns are own turns
        return 0 if self.conv % self.period == 0 else head_length(self.conv, self.heads)

    def _extend(self, digest: int, words: int, ref: int) -> tuple:
        """The next depth: the product so far times one turn."""
        parent = self._product()
        self.hash = (self.hash * self.multiplier + digest) % PRIME
        self.power = self.power * self.multiplier % PRIME
        self.depth += 1
        return (0, self.conv, self.depth, *_words_of(self._product()), *_words_of(parent), *_words_of(digest), words, ref)

    def _product(self) -> int:
        """Head times suffix: H(head) B^len(suffix) + H(suffix)."""
        return (self.head * self.power + self.hash) % PRIME

    def begin(self, conv: int) -> Iterator[tuple]:
        """The rows of the head, when a conversation starts."""
        self.conv, self.n = conv, 0
        own_base = conv - conv % self.period
        if own_base == conv:
            self.base, self.base_head = conv, []
        head = self.base_head[: self._skip()] if own_base == self.base else []
        self.head, self.hash, self.power, self.depth = 0, 0, 1, 0
        for digest, words, ref in head:
            parent, self.head = self.head, (self.head * self.multiplier + digest) % PRIME
            self.depth += 1
            yield (0, conv, self.depth, *_words_of(self.head), *_words_of(parent), *_words_of(digest), words, ref)

    def turn(self, digest: int, words: int, ref: int) -> Iterator[tuple]:
        self.n += 1
        if self.conv == self.base and self.n < self.heads:
            self.base_head.append([digest, words, ref])
        if self.n > self._skip():
            yield self._extend(digest, words, ref)

    def end(self) -> tuple:
        """The row that says where the conversation ends."""
        return (1, self.conv, self.depth, *_words_of(self._product()), 0, 0, 0, 0, 0, -1)


class Summary:
    """What a task's turns do to the state that they meet: the state after
    them, for any state before them, from a few turns and products."""

    def __init__(self, multiplier: int, period: int, heads: int) -> None:
        self.multiplier, self.period, self.heads = multiplier, period, heads
        # of the first, the last and the last base conversation: [id, number of
        # turns, first turns, products of the turns after the first 0, 1, ...]
        self.first = self.last = self.base = None

    def turn(self, conv: int, digest: int, words: int, ref: int) -> None:
        if self.last is None or self.last[0] != conv:
            self.last = [conv, 0, [], [[0, 1] for _ in range(self.heads)]]
            if self.first is None:
                self.first = self.last
            if conv % self.period == 0:
                self.base = self.last
        item = self.last
        item[1] += 1
        if len(item[2]) < self.heads:
            item[2].append([digest, words, ref])
        for skipped, product in enumerate(item[3]):
            if item[1] > skipped:
                product[0] = (product[0] * self.multiplier + digest) % PRIME
                product[1] = product[1] * self.multiplier % PRIME

    def text(self) -> str:
        return json.dumps([self.first, self.last, self.base])


def carried(summary: str, before: Rebuilder) -> Rebuilder:
    """The state after a task, from its summary and the state before it."""
    first, last, base = json.loads(summary)
    after = Rebuilder(before.multiplier, before.period, before.heads, before.state())

    def add(item: list) -> None:
        conv, n, turns, products = item
        if after.conv != conv:
            for _ in after.begin(conv):
                pass
        if conv == after.base:
            after.base_head.extend(turns[: max(0, after.heads - 1 - len(after.base_head))])
        skip = max(0, after._skip() - after.n)
        if n > skip:
            h, power = products[skip]
            after.hash = (after.hash * power + h) % PRIME
            after.power = after.power * power % PRIME
            after.depth += n - skip
        after.n += n

    done = []
    for item in (first, base, last):
        if item is not None and item[0] not in done:
            done.append(item[0])
            add(item)
    return after


_TURNS = pa.schema(
    [("at", pa.int64()), ("conv_id", pa.int64()), ("digest", pa.string()), ("words", pa.int64()), ("summary", pa.string())]
)
_TURNS_DDL = "at bigint, conv_id bigint, digest string, words bigint, summary string"
_ROWS = pa.schema(
    [("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64())]
    + [(c, pa.int64()) for c in ("f1", "f2", "p1", "p2", "t1", "t2", "words", "ref")]
)
_ROWS_DDL = ("kind int, conv_id bigint, depth bigint, f1 bigint, f2 bigint, p1 bigint, p2 bigint, "
             "t1 bigint, t2 bigint, words bigint, ref bigint")


def _sorted_turns(multiplier: int, period: int, heads: int):
    """Numbers a task's sorted turns and appends their summary."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        summary = Summary(multiplier, period, heads)

        def rows():
            nonlocal at
            for batch in parts:
                for conv, digest, words in zip(*(c.to_pylist() for c in batch.columns)):
                    summary.turn(conv, int(digest, 16) % PRIME, words, at)
                    yield at, conv, digest, words, None
                    at += 1
            if summary.first is not None:
                yield at, None, None, None, summary.text()

        yield from batches(rows(), _TURNS)

    return run


def _rebuild(multiplier: int, period: int, heads: int):
    """Rows of the rebuilt conversations; a task may hold several parts,
    each headed by its carry."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            walk = following = started = None
            for batch in parts:
                for ref, conv, digest, words, carry in zip(*(c.to_pylist() for c in batch.columns)):
                    if carry is not None:  # a new part starts
                        if walk is not None and walk.conv != following:
                            yield walk.end()
                        state, following = json.loads(carry)
                        walk = Rebuilder(multiplier, period, heads, state)
                        # the conversation before this part ended with the part before
                        started = walk.conv
                        continue
                    if walk.conv != conv:
                        if walk.conv is not None and walk.conv != started:
                            yield walk.end()
                        started = None
                        yield from walk.begin(conv)
                    started = None
                    yield from walk.turn(int(digest, 16) % PRIME, words, ref)
            if walk is not None and walk.conv != following:
                yield walk.end()

        yield from batches(rows(), _ROWS)

    return run


def _turns(conversations: DataFrame, seed: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    chosen = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"),
    )
    content = F.concat(F.lit(f"{seed}|"), F.length("role").cast("string"), F.lit("|"), F.col("role"), F.col("text"))
    return chosen.withColumn("digest", F.md5(content.cast("binary")))


def _rebuilt_rows(turns: DataFrame, seed: int, period: int, heads: int) -> DataFrame:
    spark = turns.sparkSession
    # an odd multiplier of 126 bits, another one for every seed
    multiplier = int.from_bytes(b"turn" + bytes([seed]) * 11, "big") * 2 + 1
    words = F.regexp_count("text", F.lit(WORD_PATTERN)).cast("bigint")
    ordered = turns.repartitionByRange(
        F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64)
    ).sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    numbered = stored(
        ordered.select("conv_id", "digest", words.alias("words"))
        .mapInArrow(worker_task(_sorted_turns(multiplier, period, heads)), _TURNS_DDL),
        "turns",
    )
    # one row a task comes to the driver and goes back as the next task's carry
    summaries = numbered.where(F.col("summary").isNotNull()).select("at", "summary").orderBy("at").collect()
    state, carries = Rebuilder(multiplier, period, heads), []
    for i, row in enumerate(summaries):
        following = json.loads(summaries[i + 1]["summary"])[0][0] if i + 1 < len(summaries) else None
        part = row["at"] >> 40
        carries.append(((part << 40) - 1, part, None, None, json.dumps([state.state(), following])))
        state = carried(row["summary"], state)
    part = F.shiftright("at", 40)
    turns_of = numbered.where(F.col("summary").isNull()).withColumn("part", part)
    heads_of = spark.createDataFrame(carries, "at bigint, part bigint, conv_id bigint, digest string, summary string")
    both = turns_of.unionByName(heads_of, allowMissingColumns=True)
    return (
        both.repartition("part").sortWithinPartitions("part", "at")
        .select("at", "conv_id", "digest", "words", "summary")
        .mapInArrow(worker_task(_rebuild(multiplier, period, heads)), _ROWS_DDL)
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """One row per group of equal fingerprints, with what its check needs."""
    same = [F.min(c).alias(f"{c}_min") for c in ("p1", "p2", "t1", "t2")]
    same += [F.max(c).alias(f"{c}_max") for c in ("p1", "p2", "t1", "t2")]
    return rows.where("kind = 0").groupBy("depth", "f1", "f2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
        F.min("ref").alias("ref"), *same,
    )


def _differs(names: list[str]):
    out = F.lit(False)
    for c in names:
        out = out | (F.col(f"{c}_min") != F.col(f"{c}_max"))
    return out


def _verified(turns: DataFrame, nodes: DataFrame) -> bool:
    """Whether equal digests mean equal turns and equal fingerprints equal
    sequences."""
    texts = turns.groupBy("digest").agg(
        F.min("role").alias("role_min"), F.max("role").alias("role_max"),
        F.min("text").alias("text_min"), F.max("text").alias("text_max"),
    )
    return (
        nodes.where(_differs(["p1", "p2", "t1", "t2"])).isEmpty()
        and texts.where(_differs(["role", "text"])).isEmpty()
    )


_CHUNKS = pa.schema([("depth", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("at", pa.int64()), ("ids", pa.string())])
_CHUNKS_DDL = "depth bigint, f1 bigint, f2 bigint, at bigint, ids string"
_HASHES = pa.schema([("depth", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("ends_sha256", pa.string())])
_HASHES_DDL = "depth bigint, f1 bigint, f2 bigint, ends_sha256 string"


def _chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, id) rows to pieces of each node's comma-joined ids."""

    def rows():
        node, ids = None, []
        for batch in parts:
            for *key, c in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node or len(ids) >= IDS_PER_CHUNK:
                    if ids:
                        yield (*node, ids[0], ",".join(map(str, ids)))
                    node, ids = key, []
                ids.append(c)
        if ids:
            yield (*node, ids[0], ",".join(map(str, ids)))

    yield from batches(rows(), _CHUNKS, size=64)


def _hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    def rows():
        node, state = None, None
        for batch in parts:
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != node:
                    if node:
                        yield (*node, state.hexdigest())
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if node:
            yield (*node, state.hexdigest())

    yield from batches(rows(), _HASHES)


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of each node's ends, ids ascending."""
    key = ["depth", "f1", "f2"]
    chunks = (
        rows.where("kind = 1").select(*key, "conv_id")
        .repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
        .mapInArrow(worker_task(_chunks), _CHUNKS_DDL)
    )
    return (
        chunks.repartition(*key).sortWithinPartitions(*key, "at")
        .mapInArrow(worker_task(_hashes), _HASHES_DDL)
    )


def chain_totals(chains: DataFrame, root: int) -> DataFrame:
    """(id, parent, leaves, saved) of a tree to sums over each subtree, by
    pointer doubling: after round k a row holds the sums of its descendants
    less than 2^k below it, and points 2^k up.  Most rows point at the root
    soon; as nothing is above it, they need no join (other parents of very
    many rows are left to the adaptive split of skewed joins)."""
    now = chains
    while not now.where(F.col("parent").isNotNull()).isEmpty():
        gains = now.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(
            F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved")
        )
        up = now.select(F.col("id").alias("parent"), F.col("parent").alias("_next"))
        done = F.col("parent").isNull() | (F.col("parent") == root)
        moved = now.where(~done).join(up, "parent").unionByName(
            now.where(done).withColumn("_next", F.lit(None).cast("bigint"))
        )
        now = stored(
            moved.join(gains, "id", "left").select(
                "id", F.col("_next").alias("parent"),
                (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"),
            ),
            "chains",
        )
    return now


def _suffix_sums(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Sums over a chain from each depth on, in buckets of depth so that a
    long chain spreads over tasks."""
    nodes = nodes.withColumn("_bucket", F.floor(F.col("depth") / DEPTH_BUCKET))
    inside = Window.partitionBy("conv_id", "_bucket").orderBy(F.desc("depth"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    after = nodes.groupBy("conv_id", "_bucket").agg(*[F.sum(c).alias(f"_{c}") for c in columns]).select(
        "conv_id", "_bucket", *[F.coalesce(F.sum(f"_{c}").over(later), F.lit(0)).alias(f"_{c}") for c in columns]
    )
    out = nodes.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in columns]).join(after, ["conv_id", "_bucket"])
    for c in columns:
        out = out.withColumn(c, F.col(f"_in_{c}") + F.col(f"_{c}"))
    return out.drop("_bucket", *[f"_in_{c}" for c in columns], *[f"_{c}" for c in columns])


def trie(conversations: DataFrame, period: int = PERIOD, heads: int = HEADS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and ``turn_ref``, the
    reference of the stored turn that ends the prefix (root: null)."""
    spark = conversations.sparkSession
    prepare(spark)
    for seed in range(SEEDS):
        turns = _turns(conversations, seed)
        rows = stored(_rebuilt_rows(turns, seed, period, heads), "rebuilt")
        groups = stored(_grouped(rows), "prefixes")
        if _verified(turns, groups):
            break
    else:
        raise RuntimeError(f"fingerprints collided under {SEEDS} seeds")

    # the root: every conversation ends somewhere, once
    root = rows.where("kind = 1").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    root_row = [(root["conv_id"], 0, None, root["n_convs"], 0, None, 0, 0)] if root["n_convs"] else []
    owner = groups.select(
        (F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1_min"), F.col("f2").alias("p2_min"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    top = groups.where("depth = 1").withColumn("parent_conv_id", F.lit(root["conv_id"]).cast("bigint"))
    below = groups.where("depth > 1").join(owner, ["depth", "p1_min", "p2_min"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "words", "ref", "f1", "f2"]
    nodes = stored(
        top.select(*columns).unionByName(below.select(*columns)).unionByName(
            spark.createDataFrame(root_row, ", ".join(f"{c} bigint" for c in columns))
        ),
        "nodes",
    )
    # (owner, depth) names a node
    children = nodes.where("depth > 0").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")
    ).agg(F.count("*").alias("n_children"))
    own = stored(
        nodes.join(children, ["conv_id", "depth"], "left").select(
            *columns, F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        ),
        "nodes",
    )
    chains = stored(
        own.groupBy("conv_id").agg(
            F.min("depth").alias("top"), F.min_by("parent_conv_id", "depth").alias("parent"),
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        ),
        "chains",
    )
    totals = chain_totals(chains.select(F.col("conv_id").alias("id"), "parent", "leaves", "saved"), root["conv_id"])
    hung = (
        chains.where(F.col("parent").isNotNull()).select(F.col("conv_id").alias("id"), F.col("parent").alias("at"), "top")
        .join(totals.select("id", "leaves", "saved"), "id")
        .groupBy(F.col("at").alias("conv_id"), (F.col("top") - 1).alias("depth"))
        .agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    )
    summed = _suffix_sums(
        own.join(hung, ["conv_id", "depth"], "left").select(
            *columns, "n_children",
            (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"),
        ),
        ["leaves", "saved"],
    )
    return summed.join(_ends(rows), ["depth", "f1", "f2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), F.col("ref").alias("turn_ref"),
    )
