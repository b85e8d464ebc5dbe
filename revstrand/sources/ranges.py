"""Byte ranges of sequence files: plain files, and gzip files made of blocks (BGZF) by their compressed bytes.

A range of a plain file is its bytes. A range of a BGZF file holds the blocks that begin in it, found by their headers. Other gzip
files can't be entered in the middle, so they are one range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

#: Bytes of a range, and of what is read at once.
RANGE, STEP = 32 << 20, 1 << 20
#: No block of a BGZF file is longer, compressed or not.
BLOCK = 1 << 16


def open_store(path: str):
    """(file system, path inside it) by the scheme that pyarrow and Hadoop share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def block_size(head: bytes) -> int | None:
    """Compressed length of the BGZF block that begins with `head`, None if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


def kind_of(path: str, stream) -> str:
    """plain, bgzf or gzip, by the first bytes."""
    head = stream.read_at(64, 0)
    return "plain" if head[:2] != b"\x1f\x8b" else "bgzf" if block_size(head) else "gzip"


def planned(files: list[tuple[str, int]], size: int = RANGE) -> list[tuple[str, int, int, str]]:
    """(file, begin, end, kind) of all ranges of files(path, bytes). Only the first bytes of compressed files are read."""
    out = []
    for path, n in files:
        store, at = open_store(path)
        with store.open_input_file(at) as f:
            kind = kind_of(path, f)
        out += [(path, 0, n, kind)] if kind == "gzip" else [(path, i, min(i + size, n), kind) for i in range(0, n, size)]
    return out


def _first_block(f, begin: int, size: int) -> int:
    """Where the first block at or after `begin` starts: a header whose successors are headers too, or the file's end."""
    if begin <= 0:
        return 0
    raw = f.read_at(min(2 * BLOCK, size - begin), begin)
    at = raw.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        to, sure = begin + at, 0
        while to < size and sure < 3 and (n := block_size(f.read_at(64, to))):
            to, sure = to + n, sure + 1
        if sure and (sure == 3 or to == size):
            return begin + at
        at = raw.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


@dataclass
class Range:
    """The content of one range. `pulled` counts the bytes of the range itself that were given out so far."""

    path: str
    begin: int
    end: int
    kind: str
    pulled: int = 0

    def __post_init__(self):
        store, at = open_store(self.path)
        self.file = store.open_input_file(at)
        self.size = self.file.size()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def _blocks(self, at: int) -> Iterator[tuple[int, bytes]]:
        while at < self.size:
            n = block_size(self.file.read_at(64, at))
            if not n:
                raise ValueError(f"{self.path} has no block at {at}")
            yield at, zlib.decompress(self.file.read_at(n, at), 31)
            at += n

    def before(self) -> bytes:
        """The last byte before the range, empty at the file's start."""
        if self.begin == 0 or self.kind == "gzip":
            return b""
        if self.kind == "plain":
            return self.file.read_at(1, self.begin - 1)
        last, start = b"", _first_block(self.file, max(self.begin - 4 * BLOCK, 0), self.size)
        for at, body in self._blocks(start):
            if at >= self.begin:
                break
            last = body[-1:] or last
        return last

    def chunks(self) -> Iterator[bytes]:
        """The range's bytes, and then what follows in the file for as long as it is asked for."""
        if self.kind == "plain":
            for at in range(self.begin, self.size, STEP):
                body = self.file.read_at(min(STEP, (self.end if at < self.end else self.size) - at), at)
                self.pulled += len(body) if at < self.end else 0
                yield body
                if at < self.end < at + STEP and self.end < self.size:  # what the step left out after the range
                    yield self.file.read_at(min(at + STEP, self.size) - self.end, self.end)
        elif self.kind == "bgzf":
            for at, body in self._blocks(_first_block(self.file, self.begin, self.size)):
                self.pulled += len(body) if at < self.end else 0
                yield body
        else:
            rest = self.file.read(STEP)
            while rest:
                z = zlib.decompressobj(31)
                while not z.eof:
                    if not rest and not (rest := self.file.read(STEP)):
                        raise EOFError(f"{self.path} is incomplete")
                    body = z.decompress(rest)
                    rest = z.unused_data
                    self.pulled += len(body)
                    if body:
                        yield body
                rest = rest or self.file.read(STEP)

    def body(self) -> bytes:
        """All bytes of the range itself."""
        parts = []
        for body in self.chunks():
            parts.append(body)
            if self.kind == "plain" and self.pulled >= self.end - self.begin or self.kind == "bgzf" and sum(map(len, parts)) > self.pulled:
                break
        return b"".join(parts)[: self.pulled]

    def lines(self) -> Iterator[tuple[int, bytes]]:
        """(offset in the content, line with its end) from the range's start on, past its end for as long as it is asked for."""
        rest, at = b"", 0
        for body in self.chunks():
            first, *more = body.split(b"\n")
            rest += first
            for x in more:
                yield at, rest + b"\n"
                at += len(rest) + 1
                rest = x
        if rest:
            yield at, rest
