"""Byte-level BPE encoding and decoding by a file of ranks.

A text is split by a pattern into pre-tokens, each of which is encoded by
itself.  Method, in two tiers: a minimal perfect hash over the vocabulary
(hash, displace: one displacement per bucket of about four keys sends n
keys to n slots; the key stored at the slot decides) resolves pre-tokens
that are a vocabulary entry as a whole; the others start as a linked list
of bytes, and a heap gives the pair of lowest rank, leftmost first, until
no neighbours form an entry.  Decoding joins the entries' bytes.

Distribution: every row is encoded by itself, without a shuffle.  A worker
builds the table once from the vocabulary file and remembers the ids of
chunks of text that recur, at most ``MEMO_CHUNKS`` of them.
A chunk starts at a blank that no white space follows: pre-tokens of this
pattern hold a blank only as their first character, so such a place is
always a border.  A text is handled in stretches of whole chunks of about
``STRETCH`` characters, so one of any length takes bounded memory apart
from its own ids (a single pre-token is never cut).

Defined cases: a null or empty text has no ids and decodes to nothing; a
null id or a repeated row is a row like any other; the strings of special
tokens are ordinary text; other columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.llm.common import batches, column, prepare, worker_task

MEMO_CHUNKS = 600_000
STRETCH = 1 << 20
KEYS_PER_BUCKET = 4
SLOTS = 1 << 22

_CODERS: dict[tuple[str, str], Coder] = {}


def default_vocabulary() -> tuple[str, str]:
    """The path of the rank file and the pattern of its pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """A minimal perfect hash: n keys at n slots."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // KEYS_PER_BUCKET))
        self.shift = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes | None] = [None] * self.n
        self.place = np.zeros(self.n, np.int64)  # slot -> position in keys
        hashes = self._hashes(keys)
        if len(np.unique(hashes)) < self.n:
            raise ValueError("keys repeat")
        taken = np.zeros(self.n, bool)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            members = order[starts[b] : starts[b + 1]]
            if len(members) < 2:
                singles.extend((b, m) for m in members)
                continue
            self.shift[b], slots = self._displace(hashes[members], taken)
            taken[slots] = True
            self._settle(keys, members, slots)
        # a bucket of one key names its slot outright
        for (b, m), slot in zip(singles, np.flatnonzero(~taken)):
            self.shift[b] = -1 - slot
            self._settle(keys, [m], [slot])

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
        return ((mixed >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def _displace(self, hashes: np.ndarray, taken: np.ndarray) -> tuple[int, np.ndarray]:
        """The first shift that sends all keys of a bucket to free slots."""
        first = 1
        while True:
            shifts = np.arange(first, first + 64)
            slots = np.sort(self._slots(hashes[:, None], shifts[None, :]), axis=0)
            good = ~taken[slots].any(axis=0) & (slots[1:] != slots[:-1]).all(axis=0)
            if good.any():
                shift = int(shifts[np.argmax(good)])
                return shift, self._slots(hashes, np.array(shift))
            first += 64

    def _settle(self, keys: list[bytes], members, slots) -> None:
        for m, slot in zip(members, slots):
            self.keys[slot] = keys[m]
            self.place[slot] = m

    def find(self, words: list[bytes]) -> list[int]:
        """Each word's position among the keys, -1 if it is none of them."""
        if not self.n or not words:
            return [-1] * len(words)
        hashes = self._hashes(words)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self._slots(hashes, shift))
        stored = self.keys
        return [
            at if stored[slot] == word else -1
            for word, slot, at in zip(words, slots.tolist(), self.place[slots].tolist())
        ]


def short_ranks(ranks: dict[bytes, int]) -> tuple[list[int | None], list[int | None]]:
    """Ranks of all single bytes, and of all pairs of bytes (256 a + b)."""
    single = [ranks.get(bytes([a])) for a in range(256)]
    return single, [ranks.get(bytes([a, b])) for a in range(256) for b in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int], single: list, double: list) -> list[int]:
    """Ids of one pre-token: a heap over its linked bytes."""
    n = len(piece)
    get = ranks.get
    place = n.bit_length()  # low bits of a heap entry: where the pair starts
    low = (1 << place) - 1
    ids = [single[a] for a in piece]
    pair = [double[a << 8 | b] for a, b in pairwise(piece)]  # rank of the pair that starts here
    heap = [rank << place | i for i, rank in enumerate(pair) if rank is not None]
    heapify(heap)
    pair.append(None)
    following, before = list(range(1, n + 2)), list(range(-1, n))
    while heap:
        top = heappop(heap)
        i, rank = top & low, top >> place
        if pair[i] != rank:  # merged away or changed since
            continue
        j = following[i]
        k = following[j]
        ids[i] = rank
        ids[j] = pair[j] = None
        following[i], before[k] = k, i
        if k < n:
            pair[i] = rank = get(piece[i : following[k]])
            if rank is not None:
                heappush(heap, rank << place | i)
        else:
            pair[i] = None
        p = before[i]
        if p >= 0:
            pair[p] = rank = get(piece[p:k])
            if rank is not None:
                heappush(heap, rank << place | p)
    return [i for i in ids if i is not None]


RUN = regex.compile(r" \s")


def chunks(text: str) -> tuple[str, list[str]]:
    """The text cut before every blank that no white space follows: the first
    piece, and the others without their blank."""
    first, *rest = text.split(" ")
    if not rest or not (text[-1] == " " or RUN.search(text)):
        return first, rest
    out: list[str] = []
    for s in rest:
        if s and not s[0].isspace():
            out.append(s)
        elif out:
            out[-1] += " " + s
        else:
            first += " " + s
    return first, out


class Coder:
    def __init__(self, path: str, pattern: str, memo: int = MEMO_CHUNKS) -> None:
        self.ranks = read_ranks(path)
        tokens = list(self.ranks)
        self.table = PerfectHash(tokens)
        self.codes = [self.ranks[t] for t in tokens]
        self.bytes: list[bytes | None] = [None] * (max(self.codes, default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.digits = [str(i) for i in range(len(self.bytes))]
        self.split = regex.compile(pattern).findall
        self.single, self.double = short_ranks(self.ranks)
        self.limit = memo
        self.memo: dict[str, bytes] = {}
        self.seen = bytearray(SLOTS)  # marks of chunks met before

    def _resolve(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens: the perfect hash, else merges."""
        codes, tables = self.codes, (self.ranks, self.single, self.double)
        raw = [p.encode() for p in pieces]
        return [
            array("I", [codes[at]] if at >= 0 else merge(text, *tables)).tobytes()
            for text, at in zip(raw, self.table.find(raw))
        ]

    def _learn(self, wanted: set[str]) -> list[str]:
        """Put the ids of all wanted chunks (with a blank before them) into
        the memo; returns those that are not to stay.  Once it is half full, a
        chunk stays from its second time on, as most new ones never recur."""
        new = list(wanted.difference(self.memo))
        if not new:
            return []
        memo = self.memo
        room = self.limit - len(memo)
        pieces = [self.split(" " + chunk) for chunk in new]
        # the first pre-token may be known as a chunk of its own
        inner = {p for ps in pieces for p in ps[1:]}
        known = {p for ps in pieces if (p := ps[0][1:]) in memo}
        heads = list({ps[0] for ps in pieces if ps[0][1:] not in known})
        tails = list(inner)
        found = dict(zip(heads, self._resolve(heads)))
        rest = dict(zip(tails, self._resolve(tails)))
        for head, ids in found.items():
            memo[head[1:]] = ids
        get = rest.__getitem__
        for chunk, ps in zip(new, pieces):
            if len(ps) > 1:
                memo[chunk] = memo[ps[0][1:]] + b"".join(map(get, ps[1:]))
        if 2 * room > self.limit + 2 * len(new):
            return []
        passing, seen = [], self.seen
        for chunk in {*new, *(h[1:] for h in heads)}:
            slot = hash(chunk) % SLOTS
            if seen[slot] and room > 0:
                room -= 1
            else:
                seen[slot] = 1
                passing.append(chunk)
        return passing

    def stretches(self, text: str | None) -> Iterator[bytes]:
        """A text's ids, as little-endian unsigned 32-bit integers, stretch by stretch."""
        at, n = 0, len(text or "")
        while at < n:
            end = n
            if n - at > STRETCH:
                end = text.find(" ", at + STRETCH)
                while end >= 0 and (end + 1 >= n or text[end + 1].isspace()):
                    end = text.find(" ", end + 1)
                end = n if end < 0 else end
            first, rest = chunks(text[at:end])
            passing = self._learn(set(rest))
            yield b"".join([*self._resolve(self.split(first)), *map(self.memo.__getitem__, rest)])
            for chunk in passing:
                del self.memo[chunk]
            at = end

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.stretches(text))

    def decode(self, ids: bytes | None) -> bytes:
        get = self.bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids or b"", "<u4").tolist()))


def coder(path: str, pattern: str) -> Coder:
    """One coder per Python worker and vocabulary."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def forget() -> None:
    """Drop the coders (tasks of other operators need the memory)."""
    _CODERS.clear()


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.binary())])
_DECODED = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])
_DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def _texts(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, token_ids), the ids as
    little-endian unsigned 32-bit integers."""
    path, split = vocabulary or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, split)

        def rows():
            for batch in parts:
                for doc, text in zip(column(batch, "doc_id"), column(batch, "text")):
                    ids = code.encode(text)
                    yield doc, len(ids) // 4, ids

        yield from batches(rows(), _ENCODED, size=64)

    return _texts(docs).mapInArrow(worker_task(run, pieces=True), "doc_id bigint, n_tokens bigint, token_ids binary")


def decode(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, token_ids) to (doc_id, bytes)."""
    prepare(encoded.sparkSession)
    path, split = vocabulary or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, split)

        def rows():
            for batch in parts:
                for doc, ids in zip(column(batch, "doc_id"), column(batch, "token_ids")):
                    yield doc, code.decode(ids)

        yield from batches(rows(), _DECODED, size=64)

    return encoded.select("doc_id", "token_ids").mapInArrow(worker_task(run, pieces=True), "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 (of the
    decimal ids joined by commas), decoded_sha256 (of the decoded bytes)."""
    path, split = vocabulary or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, split)
        digits = code.digits.__getitem__

        def rows():
            for batch in parts:
                for doc, text in zip(column(batch, "doc_id"), column(batch, "text")):
                    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in code.stretches(text):
                        if ids:
                            of_ids.update(b"," if n else b"")
                            of_ids.update(",".join(map(digits, np.frombuffer(ids, "<u4").tolist())).encode())
                            of_bytes.update(code.decode(ids))
                            n += len(ids) // 4
                    yield doc, n, of_ids.hexdigest(), of_bytes.hexdigest()

        yield from batches(rows(), _DIGESTS)

    return _texts(docs).mapInArrow(
        worker_task(run, pieces=True), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
