"""SimHash near-duplicates, linked through BK-trees.

Fingerprint: A-Z lower-cased, words, shingles of ``shingle`` words
(repeats count; a shorter text is one shingle; no word: fingerprint 0),
XXH64 of each with seed 42, one vote per bit: 1 if set in over half.

Links: two fingerprints link at ``max_bits`` or fewer differing bits.
Equal fingerprints are one entry (its node is the smallest doc_id).  The
64 bits form four blocks, and the 48 bits outside a block form four
blocks again: within three differing bits some block is equal, and some
block of the rest too, so a linked pair meets in at least one of 4 x 4
*shards* keyed by 28 equal bits.  Each shard's entries form a BK-tree
(children keyed by their Hamming distance to the parent), and each entry
looks up its links following only edges whose key is within the radius
of its own distance.  A shard's tree goes to the entries that can meet
it rather than to every task: a broadcast of all trees would grow with
the corpus.

A shard of more than ``tree_limit`` entries is dealt into parts; the
tree of part i goes to the entries of every part j >= i, so each task
holds two parts at most and no pair is lost.  Only a spanning set of the
links found leaves a tree (entry, smallest entry it reaches there), so
a large group does not emit its pairs.  Links become components by
:func:`tickwarden.llm.components.connected_components`.

Defined cases: a null or empty text has fingerprint 0, linked like any
other.  A row with a null doc_id takes the component of the rows of its
own fingerprint, null if none of those has an id.  Rows of equal id each
keep their fingerprint and are one node where they share it.  An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.llm.common import batches, col_of, column, prepare, stored, whole_row, worker_task
from tickwarden.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
TREE_LIMIT = 4096

LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])

_UPPER = bytes(range(65, 91))
_LOWER_TABLE = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    ws = text.encode("utf-8", "replace").translate(_LOWER_TABLE).split() if text else []
    if not ws:
        return 0
    if len(ws) <= shingle:
        grams = [b" ".join(ws)]
    elif shingle == 3:
        grams = [b"%b %b %b" % g for g in zip(ws, ws[1:], ws[2:])]
    else:
        grams = [b" ".join(ws[i : i + shingle]) for i in range(len(ws) - shingle + 1)]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for i in range(0, len(grams), 1 << 16):  # a very long text in slices
        part = grams[i : i + (1 << 16)]
        h = np.fromiter((digest(g, seed) for g in part), "<u8", len(part))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(grams)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, bits), the fingerprint as a signed 64-bit integer, and the
    columns ``keep``."""
    prepare(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            prints = [fingerprint(t, shingle, seed) for t in column(batch, "text")]
            signed = np.array(prints, np.uint64).view(np.int64)
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([own[0], pa.array(signed), *own[1:]], names=["doc_id", "bits", *keep])

    chosen = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep
    )
    others = "".join(f", {c} {chosen.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(worker_task(run), f"doc_id bigint, bits bigint{others}")


class BKTree:
    """A BK-tree over distinct 64-bit integers.

    Nodes are stored level by level; lookups carry all queries of a node
    at once, so a step is a few vector operations.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.root = self._build(np.arange(len(values))) if len(values) else None

    def _build(self, members: np.ndarray):
        """(pivot, {distance: child}) without recursion on deep chains."""
        root = (int(members[0]), {})
        todo = [(root, members[1:])]
        while todo:
            (pivot, children), rest = todo.pop()
            if not len(rest):
                continue
            d = np.bitwise_count(self.values[rest] ^ self.values[pivot])
            order = np.argsort(d, kind="stable")
            rest, d = rest[order], d[order]
            cuts = np.flatnonzero(np.diff(d)) + 1
            for group, key in zip(np.split(rest, cuts), d[np.concatenate(([0], cuts))].tolist()):
                child = (int(group[0]), {})
                children[key] = child
                todo.append((child, group[1:]))
        return root

    def matches(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(member, positions of the queries within the radius of it)."""
        if self.root is None or not len(queries):
            return
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            (pivot, children), asked = todo.pop()
            d = np.bitwise_count(queries[asked] ^ self.values[pivot]).astype(np.int16)
            near = asked[d <= radius]
            if len(near):
                yield pivot, near
            for key, child in children.items():
                follow = asked[np.abs(d - key) <= radius]
                if len(follow):
                    todo.append((child, follow))


def _small_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """The same tree for a few integers, an entry at a time."""
    root: tuple[int, dict] = (0, {})
    for i in range(1, len(values)):
        v = values[i]
        todo = [root]
        while todo:
            node, children = todo.pop()
            d = (v ^ values[node]).bit_count()
            if d <= radius:
                yield node, i
            todo.extend(c for k, c in children.items() if -radius <= k - d <= radius)
        node, children = root
        d = (v ^ values[node]).bit_count()
        while d in children:
            node, children = children[d]
            d = (v ^ values[node]).bit_count()
        children[d] = (i, {})


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _shard_links(nodes: np.ndarray, prints: np.ndarray, sides: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Spanning links of one cell.  ``sides``: 0 both, 1 tree, 2 query."""
    order = np.argsort(nodes, kind="stable")
    nodes, prints, sides = nodes[order], prints[order], sides[order]
    n = len(nodes)
    sets = _Sets(n)
    if n <= 48 and not sides.any():
        for x, y in _small_links([int(p) for p in prints], radius):
            sets.union(x, y)
    else:
        members = np.flatnonzero(sides != 2)
        asked = np.flatnonzero(sides != 1)
        tree = BKTree(prints[members])
        for member, near in tree.matches(prints[asked], radius):
            x = int(members[member])
            for y in asked[near].tolist():
                sets.union(x, y)
    for i in range(n):
        r = sets.find(i)
        if r != i:
            yield int(nodes[r]), int(nodes[i])


def _blocks(positions: list[int]) -> list[list[int]]:
    size = len(positions) // 4
    return [positions[i * size : (i + 1) * size] for i in range(4)]


def shard_keys(bits) -> list:
    """The 16 shard keys of a fingerprint: shard number, then the 16 bits of a
    block and the 12 bits of a block of the rest."""
    bit_at = lambda lo, n: F.shiftrightunsigned(bits, lo).bitwiseAND(F.lit((1 << n) - 1))
    out = []
    for i in range(4):
        head = bit_at(16 * i, 16)
        rest = [16 * b for b in range(4) if b != i]
        for j in range(4):
            # the j-th 12 of the 48 bits outside block i, as parts of blocks
            lo, left, picked, width = 12 * j, 12, F.lit(0).cast("bigint"), 0
            while left:
                block, at = divmod(lo, 16)
                take = min(left, 16 - at)
                picked = picked.bitwiseOR(F.shiftleft(bit_at(rest[block] + at, take), width))
                lo, left, width = lo + take, left - take, width + take
            key = F.shiftleft(F.lit(4 * i + j).cast("bigint"), 28).bitwiseOR(F.shiftleft(head, 12)).bitwiseOR(picked)
            out.append(key)
    return out


def fingerprint_links(entries: DataFrame, max_bits: int = MAX_BITS, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """entries(node, bits), one row per distinct fingerprint, to links (a, b)
    that connect every two entries within ``max_bits`` (3 at most)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the shards find pairs within 3 bits")
    keyed = entries.select("node", "bits", F.explode(F.array(*shard_keys(F.col("bits")))).alias("shard"))
    sizes = keyed.groupBy("shard").count().where(F.col("count") > tree_limit)
    large = stored(sizes.select("shard", F.ceil(F.col("count") / tree_limit).cast("int").alias("parts")), "bk-large")
    dealt = keyed.join(large, "shard", "left").select(
        "node", "bits", "shard", F.coalesce("parts", F.lit(1)).alias("parts"),
        F.pmod(F.xxhash64("bits"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = dealt.select("node", "bits", "shard", "part", other).select(
        "node", "bits", "shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
        .cast("tinyint").alias("side"),
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            held: list[np.ndarray] | None = None
            for batch in parts:
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
                if held is not None:
                    cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
                change = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)
                starts = np.concatenate(([0], np.flatnonzero(change) + 1))
                sized = np.diff(starts)
                for s, n in zip(starts[:-1][sized > 1].tolist(), sized[sized > 1].tolist()):
                    yield [c[s : s + n] for c in cols[3:]]
                held = [c[starts[-1] :] for c in cols]  # the last cell may go on
            if held is not None and len(held[0]) > 1:
                yield held[3:]

        def rows():
            for nodes, prints, sides in groups():
                yield from _shard_links(nodes, prints.view(np.uint64), sides, max_bits)

        yield from batches(rows(), LINKS)

    key = ["shard", "i", "j"]
    ordered = cells.select(*key, "node", "bits", "side").repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(worker_task(run), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED, tree_limit: int = TREE_LIMIT,
) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    prints = stored(fingerprints(docs, shingle, seed), "simhash")
    heads = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("node")), "simhash-heads")
    entries = heads.where(F.col("node").isNotNull())
    # a doc_id with several fingerprints is one node of several entries
    links = fingerprint_links(entries, max_bits, tree_limit)
    labels = connected_components(links)
    placed = heads.join(labels, "node", "left").select("bits", F.coalesce("root", "node").alias("component_id"))
    placed = stored(placed, "simhash-components")
    return prints.join(placed, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def row_mark(docs: DataFrame):
    """SHA-256 of a row's content: its text, and its other columns as JSON."""
    others = [col_of(c).alias(c) for c in docs.columns if c != "text"]
    rest = F.to_json(F.struct(*others, F.col("text").isNull().alias("null text")), {"ignoreNullFields": "false"})
    content = F.concat(rest, F.lit("\n"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.unhex(F.sha2(content.cast("binary"), 256))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """``docs`` without near-duplicates: one row of each component of linked
    fingerprints stays, that of the smallest doc_id (rows without an id come
    last; rows of one id by their content).

    Components are of fingerprints, so rows that share an id but not a
    fingerprint stay apart, and rows without an id are compared like any
    other.  The choice is made on ids and content hashes; whole rows travel
    once, to meet the hashes that stay.
    """
    marked = docs.select("doc_id", "text", row_mark(docs).alias("mark"))
    prints = stored(fingerprints(marked, shingle, seed, keep=("mark",)), "simhash")
    entries = stored(prints.select("bits", F.col("bits").alias("node")).distinct(), "simhash-heads")
    labels = connected_components(fingerprint_links(entries, max_bits))
    placed = prints.join(labels.withColumnRenamed("node", "bits"), "bits", "left")
    rows = placed.groupBy(F.coalesce("root", "bits").alias("component"), "doc_id", "mark").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "n"))
    chosen = stored(rows.groupBy("component").agg(first.alias("r")).select("r.mark", "r.n"), "simhash-kept")
    whole = docs.select(whole_row(docs).alias("row"), row_mark(docs).alias("mark"))
    kept = whole.join(chosen, "mark")
    # equal rows of one component: one of them
    again = kept.where("n > 1").groupBy("mark").agg(F.first("row").alias("row"))
    return kept.where("n = 1").select("row").unionByName(again.select("row")).select("row.*")
