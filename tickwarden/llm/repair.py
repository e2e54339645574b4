"""Re-Pair grammar compression of id sequences, and its shard file.

A shard holds the ids of consecutive documents.  Rounds count the
adjacent pairs inside documents and replace the most frequent ones, each
by a new symbol (a nonterminal) with the rule "symbol -> pair"; later
rounds pair nonterminals too, until no pair is found ``MIN_COUNT`` times.
A pair of old symbols never becomes more frequent, so a round looks only
at places that the last one changed or found frequent enough.
Where chosen pairs overlap, the leftmost is replaced; a rule that this
leaves without a use is not kept.  Symbols have 16 bits until those are
used up, then 32.

File layout (little-endian):

    8 bytes   magic
    8 x u64   symbol bytes, vocabulary, documents, symbols, tokens, rules, 0, 0
    rules     left, right (symbol bytes each)
    u32       expansion length of each rule
    u8        1 if the document's id is null
    i64       document id, per document
    u64       first symbol, per document, and the end
    u64       first token, per document, and the end
    symbols   (symbol bytes each)

Any document, or any stretch of its ids, is decoded from its own symbols
by range reads: expansion lengths tell where a symbol's ids begin.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable

import numpy as np

MAGIC = b"REPAIR1\n"
HEADER = struct.Struct("<8s8Q")
ROUNDS = None  # until no pair is frequent
RULES_PER_ROUND = 4096
MIN_COUNT = 8
_BINS = 20


class RepairError(ValueError):
    """The file is not a shard of this format."""


def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if left.dtype == np.uint16:
        return (left.astype(np.uint32) << np.uint32(16)) | right
    return (left.astype(np.uint64) << np.uint64(32)) | right


def _bins(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BINS)).astype(np.int64)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BINS)).astype(np.int64)


def _frequent_pairs(s: np.ndarray, places: np.ndarray, most: int, min_count: int):
    """The most frequent pairs (their keys) that begin at ``places``, the
    positions that hold one and the pair's number there, and the places whose
    pair may be frequent."""
    if 2 * len(places) > len(s):  # by slices, which is faster than by places
        keys = _keys(s[:-1], s[1:])[places]
    else:
        keys = _keys(s[places], s[places + 1])
    bins = _bins(keys)
    counts = np.bincount(bins, minlength=1 << _BINS).astype(np.int32)
    # a pair is no more frequent than its bin: take the bins of the highest counts
    full = counts[counts >= min_count]
    ladder = np.cumsum(np.bincount(np.minimum(full, 1 << 16), minlength=min_count + 1)[::-1])[::-1]
    edge = max(min_count, int(np.searchsorted(-ladder, -most, side="right")) - 1)
    while True:
        at = np.flatnonzero((counts >= edge)[bins])
        here = keys[at]
        found, n = np.unique(here, return_counts=True)
        order = np.lexsort((found, -n))[:most]
        found = found[order[n[order] >= min_count]]
        if len(found) or edge == min_count:
            break
        edge = min_count  # full bins of rare pairs: a frequent one may be in any other
    # one pair per bin; a less frequent one in its bin waits for a later round
    own = _bins(found)
    _, first = np.unique(own, return_index=True)
    first.sort()
    found, own = found[first], own[first]
    number = np.full(1 << _BINS, -1, np.int16 if len(found) < 1 << 15 else np.int32)
    number[own] = np.arange(len(found))
    which = number[bins[at]]
    hit = np.flatnonzero((which >= 0) & (found[which] == here)) if len(found) else at[:0]
    return found, places[at[hit]], which[hit], places[np.flatnonzero((counts >= min_count)[bins])]


def compress(
    ids: np.ndarray, starts: np.ndarray, vocabulary: int, rounds: int | None = ROUNDS, per_round: int = RULES_PER_ROUND,
    min_count: int = MIN_COUNT,
):
    """ids of documents that begin at ``starts`` to (symbols, first symbol
    of each document and the end, rules).  ``rounds``: at most so many."""
    s = ids.astype(np.uint16 if vocabulary <= 1 << 16 else np.uint32)
    n = len(s)
    last = np.zeros(n, bool)  # last symbol of its document
    if n:
        last[starts[1:] - 1] = True
        last[-1] = True
    rules: list[np.ndarray] = []
    symbol = vocabulary
    places = np.flatnonzero(~last)  # where a frequent pair may begin
    for _ in itertools.count() if rounds is None else range(rounds):
        if len(s) < 2:
            break
        pairs, at, which, places = _frequent_pairs(s, places, per_round, min_count)
        if not len(pairs):
            break
        # in a run of overlapping candidates every other one is replaced
        begins = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
        run_start = np.repeat(begins, np.diff(np.append(begins, len(at))))
        take = np.flatnonzero((np.arange(len(at)) - run_start) & 1 == 0)
        at, which = at[take], which[take]
        used = np.bincount(which, minlength=len(pairs)) > 0
        pairs, which = pairs[used], (np.cumsum(used) - 1)[which]
        half = np.uint64(16 if s.dtype == np.uint16 else 32)
        if symbol + len(pairs) > 1 << 16:
            s = s.astype(np.uint32, copy=False)
        s[at] = (symbol + which).astype(s.dtype)
        last[at] = last[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        # a new symbol makes a new pair with either neighbour
        live = np.zeros(len(s), bool)
        live[places] = True
        live[at] = True
        live[at[at > 0] - 1] = True
        live &= ~last
        keep = np.flatnonzero(keep)
        s, last = s[keep], last[keep]
        places = np.flatnonzero(live[keep])
        pairs = pairs.astype(np.uint64)
        rules.append(np.stack((pairs >> half, pairs & ((np.uint64(1) << half) - np.uint64(1))), axis=1).astype(np.uint32))
        symbol += len(pairs)
    ends = np.flatnonzero(last) + 1
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return s, np.concatenate(([0], ends)).astype(np.uint64), table


def shard_bytes(doc_ids: list, lengths: list[int], ids: bytes, vocabulary: int, **options) -> bytes:
    """A shard file.  ``ids``: all documents' ids (32-bit); no document is empty."""
    tokens = np.frombuffer(ids, "<u4")
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.uint64)
    symbols, firsts, rules = compress(tokens, ends[:-1].astype(np.int64), vocabulary, **options)
    wide = np.dtype("<u2") if vocabulary + len(rules) <= 1 << 16 else np.dtype("<u4")
    sizes = np.ones(vocabulary + len(rules), np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):
        sizes[vocabulary + i] = sizes[a] + sizes[b]
    return b"".join([
        HEADER.pack(MAGIC, wide.itemsize, vocabulary, len(doc_ids), len(symbols), len(tokens), len(rules), 0, 0),
        rules.astype(wide).tobytes(),
        sizes[vocabulary:].astype("<u4").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        firsts.astype("<u8").tobytes(), ends.astype("<u8").tobytes(),
        symbols.astype(wide).tobytes(),
    ])


class Shard:
    """A shard file behind ``read(offset, length)``."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        self.read = read
        head = read(0, HEADER.size)
        if len(head) < HEADER.size or head[:8] != MAGIC:
            raise RepairError("not a shard file")
        _, size, self.vocabulary, docs, self.symbols, self.tokens, rules, _, _ = HEADER.unpack(head)
        self.wide = np.dtype(f"<u{size}")
        lengths = [2 * rules * size, 4 * rules, docs, 8 * docs, 8 * (docs + 1), 8 * (docs + 1)]
        data = read(HEADER.size, sum(lengths))
        if len(data) != sum(lengths):
            raise RepairError("the file ends early")
        parts = np.split(np.frombuffer(data, np.uint8), np.cumsum(lengths)[:-1])
        self.rules = parts[0].view(self.wide).reshape(-1, 2)
        self.rule_sizes = parts[1].view("<u4")
        ids = parts[3].view("<i8").tolist()
        self.doc_ids = [None if null else d for d, null in zip(ids, parts[2].tolist())]
        self.first_symbol, self.first_token = parts[4].view("<u8"), parts[5].view("<u8")
        self._at = HEADER.size + sum(lengths)
        self._tables()

    def _tables(self) -> None:
        """Every symbol's ids in one array: terminals, then expansions."""
        v = self.vocabulary
        self.sizes = np.concatenate((np.ones(v, np.int64), self.rule_sizes.astype(np.int64)))
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        flat = np.zeros(int(self.sizes.sum()), "<u4")
        flat[:v] = np.arange(v)
        offsets, sizes = self.offsets.tolist(), self.sizes.tolist()
        for i, (a, b) in enumerate(self.rules.tolist()):
            o, n = offsets[v + i], sizes[a]
            flat[o : o + n] = flat[offsets[a] : offsets[a] + n]
            flat[o + n : o + sizes[v + i]] = flat[offsets[b] : offsets[b] + sizes[b]]
        self.flat = flat

    def _read_symbols(self, start: int, end: int) -> np.ndarray:
        size = self.wide.itemsize
        return np.frombuffer(self.read(self._at + size * start, size * (end - start)), self.wide)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.sizes[symbols]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.offsets[symbols] - (ends - sizes), sizes)
        at += np.arange(total)
        return self.flat[at]

    def documents(self, start: int, end: int) -> np.ndarray:
        """The ids of documents start..end-1, one after the other."""
        return self._expand(self._read_symbols(int(self.first_symbol[start]), int(self.first_symbol[end])))

    def slice(self, doc: int, start: int, end: int) -> np.ndarray:
        """Ids start..end-1 of one document, expanding only the symbols that
        cover them."""
        symbols = self._read_symbols(int(self.first_symbol[doc]), int(self.first_symbol[doc + 1]))
        ends = np.cumsum(self.sizes[symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
        begin = int(ends[a - 1]) if a else 0
        return self._expand(symbols[a:b])[start - begin : end - begin]
