"""Token ids of whole texts by the ``tokenizers`` library.

A byte-level BPE with the usual pre-tokenisation pattern never merges
across a blank that is followed by a non-blank: every pre-token that
holds a blank starts with it.  Texts are therefore cut before such
blanks and the library encodes each *distinct* piece once; a text's ids
are the concatenation of its pieces' ids.  Where the pattern is the usual
one, pieces are put together from words and line ends: a line feed
between two other characters that are no white space is a pre-token of
its own, and so is punctuation behind letters.  Tests compare with
encoding whole texts.

Arrow cuts the texts, numbers the distinct pieces and puts the ids
together; Python and the library see distinct pieces only.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
MEMO_PIECES = 400_000  # pieces remembered per Python worker
LETTER_LAST = r"[A-Za-zÀ-ÖØ-öø-ɏ]$"
TAIL = ".,;:!?"
_SLOTS = (1 << 22) - 1
GROUP_BYTES = 8 << 20  # of text encoded at once

_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, memo: int = MEMO_PIECES) -> PieceEncoder:
    """The encoder of a vocabulary file, one per Python worker."""
    key = (path, memo)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, memo)
    return _ENCODERS[key]


def forget() -> None:
    """Drop the remembered pieces (tasks of other operators need the memory)."""
    _ENCODERS.clear()


def encoded(batches: Iterable[pa.RecordBatch], enc: PieceEncoder, group: int = GROUP_BYTES) -> Iterator[tuple]:
    """(doc_id, ids) of the rows of batches with doc_id and text, several
    batches at a time."""
    docs: list[int | None] = []
    texts: list[pa.Array] = []
    size = 0

    def flush() -> Iterator[tuple]:
        column = pa.concat_arrays(texts)
        texts.clear()
        rows = list(zip(docs, enc.encode_array(column)))
        docs.clear()
        return iter(rows)

    for batch in batches:
        docs += batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        texts.append(batch.column(batch.schema.get_field_index("text")))
        size += texts[-1].nbytes
        if size >= group:
            yield from flush()
            size = 0
    if texts:
        yield from flush()


class PieceEncoder:
    def __init__(self, path: str, memo: int = MEMO_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.memo = memo
        self._ids: dict[str, bytes] = {}
        self._heads: dict[str, bytes] = {}
        self._tails: dict[str, bytes] = {}
        self._seen = bytearray(_SLOTS + 1)  # marks of pieces met before
        # ids whose token starts with a blank, or with a line feed
        self._starts = {" ": np.zeros(self.size, bool), "\n": np.zeros(self.size, bool)}
        for token, i in self.tokenizer.get_vocab().items():
            self._starts[" "][i] = token.startswith("Ġ")
            self._starts["\n"][i] = token.startswith("Ċ")
        # the pattern that keeps a line feed apart from what is beside it
        cut = self.tokenizer.pre_tokenizer
        self._lines = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and self.tokenizer.normalizer is None

    def _encode_new(self, pieces: list[str], lead: str = " ") -> dict[str, bytes]:
        """Ids of lead + piece, for pieces without blanks (and without line
        feeds, if that is the lead): encoded as one text, split again where a
        token starts with the lead."""
        out: dict[str, bytes] = {}
        blocks = [pieces[i : i + 2000] for i in range(0, len(pieces), 2000)]
        encoded = self.tokenizer.encode_batch_fast([lead + lead.join(b) for b in blocks], add_special_tokens=False)
        for block, code in zip(blocks, encoded):
            ids = np.array(code.ids, dtype="<u4")
            cuts = (4 * np.flatnonzero(self._starts[lead][ids])).tolist()
            if len(cuts) == len(block) and cuts[0] == 0:
                raw = ids.tobytes()
                cuts.append(len(raw))
                out.update(zip(block, [raw[a:b] for a, b in pairwise(cuts)]))
            else:  # a vocabulary of another kind
                out.update((p, self._whole(lead + p)) for p in block)
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        return self.encode_array(pa.array(texts, pa.string()))

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """The same for an Arrow column of texts."""
        if not len(texts):
            return []
        lists = pc.split_pattern(texts.fill_null(""), " ")
        words = lists.flatten().dictionary_encode()
        borders = lists.offsets.to_numpy()
        borders = borders - borders[0]
        pieces, units = words.dictionary, words.indices.to_numpy()
        # a blank before white space or the end is no cut
        spaced = pc.not_equal(pc.utf8_ltrim_whitespace(pieces), pieces)
        joined = pc.or_(spaced, pc.equal(pieces, "")).to_numpy(zero_copy_only=False)[units]
        joined[borders[:-1]] = False
        if joined.any():
            pieces, units, borders = _join_runs(pieces, units, borders, joined)
        else:
            units = units.copy()
        # first pieces have no blank before them
        heads = [self._head(p) for p in _strings(pieces.take(pa.array(units[borders[:-1]])))]
        units[borders[:-1]] = len(pieces) + np.arange(len(heads))
        used = np.zeros(len(pieces) + len(heads), bool)
        used[units] = True
        chosen = pieces.take(pa.array(np.flatnonzero(used[: len(pieces)])))
        codes = pa.concat_arrays([self._codes(chosen), pa.array(heads, pa.large_binary())])
        place = (np.cumsum(used) - 1).astype(units.dtype)  # heads are all used
        ends, raw = _parts(codes.take(pa.array(place[units])))
        raw = memoryview(raw)
        return [raw[a:b].tobytes() for a, b in pairwise(ends[borders].tolist())]

    def _head(self, text: str) -> bytes:
        """Ids of a text's first piece, which has no blank before it."""
        if text in self._heads:
            return self._heads[text]
        found = self._whole(text) if text else b""
        if len(self._heads) < self.memo // 8 and len(text) < 64:
            self._heads[text] = found
        return found

    def _tail(self, text: str) -> bytes:
        """Ids of punctuation by itself."""
        if text in self._tails:
            return self._tails[text]
        found = self._whole(text)
        if len(self._tails) < self.memo // 8 and len(text) < 64:
            self._tails[text] = found
        return found

    def _codes(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces, given without their leading blank."""
        words, later, starts = self._words(pieces)
        # letters and the punctuation behind them are pre-tokens of their own
        core = pc.utf8_rtrim(words, TAIL)
        cut = pc.not_equal(core, words).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(cut)
        letter = pc.match_substring_regex(core.take(pa.array(at)), LETTER_LAST).to_numpy(zero_copy_only=False)
        cut[at[~letter]] = False
        at = at[letter]
        core = pc.if_else(pa.array(cut), core, words)
        number: dict[str, int] = {"": 0}
        tails = np.zeros(len(words), np.int64)
        with_tail = zip(_strings(words.take(pa.array(at))), _strings(core.take(pa.array(at))))
        tails[at] = [number.setdefault(w[len(c):], len(number)) for w, c in with_tail]
        # a word behind a line feed goes by the name "line feed + word"
        if later.any():
            core = pc.if_else(pa.array(later), pc.binary_join_element_wise("\n", core, ""), core)
        core = core.dictionary_encode()
        known = self._known(_strings(core.dictionary))
        table = pa.array([*known, *map(self._tail, number)], pa.large_binary())
        order = np.stack((core.indices.to_numpy(), len(known) + tails), axis=1).ravel()
        ends, raw = _parts(table.take(pa.array(order)))
        ends = pa.py_buffer(ends[2 * starts].tobytes())
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, ends, raw])

    def _words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of pieces, which of them stand behind a line feed, and
        where each piece's begin (and the end).  A piece is cut at line feeds
        if those are its only white space and stand between words."""
        rows = np.arange(len(pieces))
        some = np.flatnonzero(pc.match_substring(pieces, "\n").to_numpy(zero_copy_only=False)) if self._lines else rows[:0]
        if not len(some):
            return pieces, np.zeros(len(pieces), bool), np.arange(len(pieces) + 1)
        sub = pieces.take(pa.array(some))
        lists = pc.split_pattern(sub, "\n")
        lines, first = lists.flatten(), lists.offsets.to_numpy()
        bad = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(lines), lines), pc.equal(lines, ""))
        bad = np.add.reduceat(bad.to_numpy(zero_copy_only=False).astype(np.int64), first[:-1]) > 0
        bad |= pc.match_substring(sub, " ").to_numpy(zero_copy_only=False)
        count = np.ones(len(pieces), np.int64)
        begin = rows.copy()
        count[some[~bad]] = np.diff(first)[~bad]
        begin[some[~bad]] = len(pieces) + first[:-1][~bad]
        starts = np.concatenate(([0], np.cumsum(count)))
        inside = np.arange(starts[-1]) - np.repeat(starts[:-1], count)
        words = pa.concat_arrays([pieces, lines]).take(pa.array(np.repeat(begin, count) + inside))
        return words, inside > 0, starts

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, line feed + word, or pieces with white space."""
        ids = self._ids
        codes = list(map(ids.get, words))
        missing = [w for w, c in zip(words, codes) if c is None]
        if not missing:
            return codes
        plain, lines, odd = [], [], []
        for w in missing:
            if " " in w:
                odd.append(w)
            elif w[0] == "\n":
                lines.append(w[1:])
            else:
                plain.append(w)
        fresh = self._encode_new(plain)
        fresh.update(("\n" + w, c) for w, c in self._encode_new(lines, "\n").items())
        fresh.update((p, self._whole(" " + p)) for p in odd)
        ids.update(fresh)
        codes = [fresh[w] if c is None else c for w, c in zip(words, codes)]
        self._forget_rare(fresh)
        return codes

    def _forget_rare(self, fresh: dict[str, bytes]) -> None:
        """From half the memo on remember what is new for the second time;
        most new pieces never recur."""
        ids = self._ids
        if 2 * len(ids) > self.memo:
            seen, room = self._seen, self.memo - (len(ids) - len(fresh))
            for p in fresh:
                slot = hash(p) & _SLOTS
                if seen[slot] and room > 0:
                    room -= 1
                else:
                    seen[slot] = 1
                    del ids[p]


def _strings(values: pa.Array) -> list[str]:
    """A column without nulls as a list (``to_pylist`` takes several times as long)."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _parts(values: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets (and the end) and bytes of a large binary column without nulls."""
    _, ends, raw = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    return ends, raw if raw is not None else pa.py_buffer(b"")


def _join_runs(pieces: pa.Array, units: np.ndarray, borders: np.ndarray, joined: np.ndarray):
    """Undo cuts before a blank that white space or nothing follows:
    ``joined`` marks the places whose piece goes to the one before."""
    begin = np.flatnonzero(~joined)
    end = np.append(begin[1:], len(units))
    out = units[begin]
    number: dict[str, int] = {}
    for u in np.flatnonzero(end - begin > 1).tolist():
        text = " ".join(pieces.take(pa.array(units[begin[u] : end[u]])).to_pylist())
        out[u] = number.setdefault(text, len(pieces) + len(number))
    return pa.concat_arrays([pieces, pa.array(number, pieces.type)]), out, np.searchsorted(begin, borders)


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
