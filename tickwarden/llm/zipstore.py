"""ZIP archives with stored members: written as a stream, read by ranges.

The reader never extracts: it parses the end record (and, where the
archive has one, the ZIP64 end record), then the central directory with
its ZIP64 extra fields, and turns a member's name into the byte range of
its content.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

STORED = 0
_LOCAL, _DESCRIPTOR, _ENTRY = 0x04034B50, 0x08074B50, 0x02014B50
_END, _END64, _LOCATOR64 = 0x06054B50, 0x06064B50, 0x07064B50
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
_FLAGS = 0x0808  # sizes follow the content; names are UTF-8
_DOS_DATE = 0x0021  # 1980-01-01: archives of equal content are equal


class ZipStoreError(ValueError):
    """The file is not an archive this reader understands."""


@dataclass
class Member:
    name: str
    method: int
    header_offset: int
    size: int
    crc32: int


class StoredZipWriter:
    """Writes stored members to anything with ``write``.

    ZIP64 records are written where a size, an offset or the number of
    members needs them, or always with ``zip64=True``.
    """

    def __init__(self, out, zip64: bool = False) -> None:
        self._out, self._zip64 = out, zip64
        self._at = 0
        self.members: list[Member] = []
        self._open: Member | None = None

    def _write(self, data: bytes) -> None:
        self._out.write(data)
        self._at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self._open = Member(name, STORED, self._at, 0, 0)
        # the content's size is not known yet: a ZIP64 extra field announces
        # a 64-bit data descriptor
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(struct.pack("<IHHHHHIIIHH", _LOCAL, 45, _FLAGS, STORED, 0, _DOS_DATE, 0, _FULL32, _FULL32,
                                len(raw), len(extra)) + raw + extra)

    @property
    def written(self) -> int:
        """Bytes of the open member so far."""
        return self._open.size

    def write(self, data: bytes) -> None:
        m = self._open
        m.size += len(data)
        m.crc32 = zlib.crc32(data, m.crc32)
        self._write(data)

    def end(self) -> None:
        m, self._open = self._open, None
        self._write(struct.pack("<IIQQ", _DESCRIPTOR, m.crc32, m.size, m.size))
        self.members.append(m)

    def add(self, name: str, data: bytes) -> None:
        self.begin(name)
        self.write(data)
        self.end()

    def finish(self) -> None:
        start = self._at
        for m in self.members:
            raw = m.name.encode()
            wide = self._zip64 or max(m.size, m.header_offset) >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.size, m.header_offset) if wide else b""
            size, offset = (_FULL32, _FULL32) if wide else (m.size, m.header_offset)
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", _ENTRY, 45, 45, _FLAGS, STORED, 0, _DOS_DATE, m.crc32, size,
                                    size, len(raw), len(extra), 0, 0, 0, 0, offset) + raw + extra)
        size, n = self._at - start, len(self.members)
        if self._zip64 or n >= _FULL16 or max(start, size) >= _FULL32:
            end64 = self._at
            self._write(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<IIQI", _LOCATOR64, 0, end64, 1))
            n, size, start = _FULL16, _FULL32, _FULL32
        self._write(struct.pack("<IHHHHIIH", _END, 0, 0, n, n, size, start, 0))


def read_directory(read, size: int) -> dict[str, Member]:
    """Members by name.  ``read(offset, length)`` returns bytes of the file."""
    tail_at = max(0, size - 65_557)  # the end record with the longest comment
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", _END))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(struct.pack("<I", _END), 0, at) if at else -1
    if at < 0:
        raise ZipStoreError("no end record")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = read(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
    if locator[:4] == struct.pack("<I", _LOCATOR64):
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != struct.pack("<I", _END64):
            raise ZipStoreError("no ZIP64 end record where the locator points")
        n, length, start = struct.unpack_from("<QQQ", end64, 32)
    return _entries(read(start, length), n)


def _entries(data: bytes, n: int) -> dict[str, Member]:
    members, at = {}, 0
    for _ in range(n):
        if data[at : at + 4] != struct.pack("<I", _ENTRY):
            raise ZipStoreError("damaged central directory")
        method, = struct.unpack_from("<H", data, at + 10)
        crc32, packed, size, names, extras, comments = struct.unpack_from("<IIIHHH", data, at + 16)
        offset, = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + names].decode("utf-8", "replace")
        at += 46 + names
        extra, stop = at, at + extras
        while extra + 4 <= stop:
            tag, length = struct.unpack_from("<HH", data, extra)
            if tag == 1:  # 64-bit values for the fields that are full
                wide = iter(struct.unpack_from(f"<{length // 8}Q", data, extra + 4))
                size = next(wide) if size == _FULL32 else size
                packed = next(wide) if packed == _FULL32 else packed
                offset = next(wide) if offset == _FULL32 else offset
            extra += 4 + length
        at = stop + comments
        members[name] = Member(name, method, offset, packed, crc32)
    return members


def content_start(read, member: Member) -> int:
    """Offset of a stored member's first byte in the file."""
    if member.method != STORED:
        raise ZipStoreError(f"{member.name} is compressed (method {member.method}); its records have no ranges")
    head = read(member.header_offset, 30)
    if head[:4] != struct.pack("<I", _LOCAL):
        raise ZipStoreError(f"no local header for {member.name}")
    names, extras = struct.unpack_from("<HH", head, 26)
    return member.header_offset + 30 + names + extras
