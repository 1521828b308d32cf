"""Members of a zip read as a stream of byte chunks, without seeking and without holding the archive."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

LOCAL, DIRECTORY, DESCRIPTOR, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x07\x08", b"PK\x05\x06"
STEP = 1 << 16


class Feed:
    """Bytes of a chunk iterator, read forward; what was read too far is put back."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held = iter(chunks), b""

    def peek(self, n: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < n and (chunk := next(self.chunks, None)) is not None:
            parts.append(chunk)
            size += len(chunk)
        self.held = b"".join(parts)
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.held = self.held[len(out):]
        return out

    def back(self, data: bytes) -> None:
        self.held = data + self.held


class Reader(io.RawIOBase):
    """A file object over an iterator of byte strings."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.rest = parts, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest:
            part = next(self.parts, None)
            if part is None:
                return 0
            self.rest = part
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _stored(feed: Feed, size: int) -> Iterator[bytes]:
    while size:
        part = feed.take(min(size, STEP))
        if not part:
            raise ValueError("The archive ends inside a member.")
        size -= len(part)
        yield part


def _deflated(feed: Feed) -> Iterator[bytes]:
    engine = zlib.decompressobj(-15)
    pending = b""
    while not engine.eof:
        pending = pending or feed.take(STEP)
        if not pending:
            raise ValueError("The archive ends inside a member.")
        part = engine.decompress(pending, STEP)
        pending = engine.unconsumed_tail
        if part:
            yield part
    feed.back(engine.unused_data)


def _descriptor_crc(feed: Feed) -> int:
    """Checksum of a data descriptor: with or without a signature, sizes of four or eight bytes."""
    ahead = feed.peek(28)
    lead = 4 if ahead[:4] == DESCRIPTOR else 0
    for length in (lead + 12, lead + 20):
        if ahead[length:length + 4] in (LOCAL, DIRECTORY):
            return struct.unpack("<I", feed.take(length)[lead:lead + 4])[0]
    raise ValueError("A member's data descriptor is damaged.")


def members(chunks: Iterable[bytes]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(name, parts of its content) of each member, in the order of the archive.

    A member's parts must be read before the next member is asked for; parts
    left over are read and dropped. Checksums are verified at a member's end.
    """
    feed = Feed(chunks)
    while (mark := feed.peek(4)) == LOCAL:
        _, flags, method, _, _, crc, size, _, name_length, extra_length = struct.unpack("<4xHHHHHIIIHH", feed.take(30))
        name = feed.take(name_length).decode("utf-8" if flags & 0x800 else "cp437")
        extra = feed.take(extra_length)
        while size == 0xFFFFFFFF and len(extra) >= 4:
            kind, length = struct.unpack("<HH", extra[:4])
            if kind == 1:
                size = struct.unpack("<8xQ", extra[4:20])[0]
            extra = extra[4 + length:]
        if flags & 1 or method not in (0, 8) or (method == 0 and flags & 8):
            raise ValueError(f"{name}: encrypted, compressed by method {method}, or stored without its size.")

        def parts(late=bool(flags & 8), crc=crc, name=name, content=_deflated(feed) if method else _stored(feed, size)):
            found = 0
            for part in content:
                found = zlib.crc32(part, found)
                yield part
            if found != (_descriptor_crc(feed) if late else crc):
                raise ValueError(f"{name}: wrong checksum.")

        running = parts()
        yield name, running
        for _ in running:
            pass
    if mark not in (DIRECTORY, END):
        raise ValueError("Not a zip archive, or a damaged one.")
