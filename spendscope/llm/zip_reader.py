"""Reading stored members of ZIP files by ranges: end records, ZIP64, central directory. Nothing is extracted."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol


class RangeFile(Protocol):
    def size(self) -> int: ...

    def read_at(self, nbytes: int, offset: int) -> bytes: ...


# Fixed values of the file format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
FULL16, FULL32, STORED, ZIP64_EXTRA = 0xFFFF, 0xFFFFFFFF, 0, 1
END_SIZE, LOCATOR_SIZE, LONGEST_COMMENT = 22, 20, 65535


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # where its local header stands

    def start(self, file: RangeFile) -> int:
        """Where its data stand; the local header has its own name and extra lengths."""
        head = bytes(file.read_at(30, self.header))
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {self.name}")
        name, extra = struct.unpack("<HH", head[26:30])
        return self.header + 30 + name + extra


def directory_range(file: RangeFile) -> tuple[int, int]:
    """Offset and size of the central directory."""
    size = file.size()
    at = max(0, size - END_SIZE - LONGEST_COMMENT)
    tail = bytes(file.read_at(size - at, at))
    k = tail.rfind(END, 0, max(0, len(tail) - END_SIZE + len(END)))
    while k >= 0 and k + END_SIZE + struct.unpack("<H", tail[k + 20 : k + 22])[0] != len(tail):
        k = tail.rfind(END, 0, k)
    if k < 0:
        raise ValueError("not a ZIP file: no end record")
    entries, length, offset = struct.unpack("<HII", tail[k + 10 : k + 20])
    if FULL16 == entries or FULL32 in (length, offset):
        locator = bytes(file.read_at(LOCATOR_SIZE, at + k - LOCATOR_SIZE)) if at + k >= LOCATOR_SIZE else b""
        if locator[:4] == LOCATOR64:
            (end64,) = struct.unpack("<Q", locator[8:16])
            record = bytes(file.read_at(56, end64))
            if record[:4] != END64:
                raise ValueError("no ZIP64 end record where its locator points")
            length, offset = struct.unpack("<QQ", record[40:56])
    return offset, length


def members(file: RangeFile) -> Iterator[Member]:
    offset, length = directory_range(file)
    data, at = bytes(file.read_at(length, offset)), 0
    while at < len(data):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", data[at + 10 : at + 12])
        packed, size, n_name, n_extra, n_comment = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        (header,) = struct.unpack("<I", data[at + 42 : at + 46])
        name = data[at + 46 : at + 46 + n_name]
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == ZIP64_EXTRA:  # has only the fields that are full in the entry, in this order
                body, fields = extra[4 : 4 + n], []
                for value in (size, packed, header):
                    if value == FULL32:
                        fields.append(struct.unpack("<Q", body[:8])[0])
                        body = body[8:]
                    else:
                        fields.append(value)
                size, packed, header = fields
            extra = extra[4 + n :]
        yield Member(name.decode("utf-8", "replace"), method, packed, header)
        at += 46 + n_name + n_extra + n_comment
