"""Archives through Python's file objects: readers, writers, whole files."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable
from typing import BinaryIO

from blockframe.functions import codec, wire
from blockframe.functions.wire import ArchiveError
from blockframe.streaming.push import Decoder, Encoder

#: Called with the bytes done and, where it is known, the bytes in all (else None).
Progress = Callable[[int, int | None], None]


class ArchiveReader(io.RawIOBase):
    """The content of an archive that a binary file object gives. OSError if that ends before the archive does or the archive is damaged. The file object stays open."""

    def __init__(self, source: BinaryIO, buffer_size: int = 0):
        super().__init__()
        if not hasattr(source, "read"):
            raise TypeError("source has no read()")
        self._source, self._machine, self._size, self._ready = source, Decoder(), buffer_size, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int | None:
        if self.closed:
            raise ValueError("the reader is closed")
        while not self._ready and len(buffer) and not self._machine.finished:
            data = self._source.read(self._size if self._size > 0 else self._machine.in_size)
            if data is None:
                return None  # nothing yet
            self._ready = self._machine.push(data) if data else self._machine.end()
            if self._machine.error and not self._ready:
                raise OSError(f"archive cannot be read: {self._machine.error}")
        n = min(len(buffer), len(self._ready))
        buffer[:n], self._ready = self._ready[:n], self._ready[n:]
        return n


class ArchiveWriter(io.RawIOBase):
    """Writes an archive of what is written to it to a binary file object, which stays open. Only close() completes the archive."""

    def __init__(self, target: BinaryIO, level: int = 3, checksum: bool = False, block_size: int = wire.DEFAULT_BLOCK):
        super().__init__()
        self._target = None
        if not hasattr(target, "write"):
            raise TypeError("target has no write()")
        self._target, self._machine = target, Encoder(codec.Options(level, block_size, checksum))

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        if self.closed:
            raise ValueError("the writer is closed")
        raw = bytes(data)
        if raw:
            self._target.write(self._machine.push(raw))
        return len(raw)

    def close(self) -> None:
        if not self.closed and self._target is not None:
            try:
                self._target.write(self._machine.end())
            finally:
                super().close()


def _left(f: BinaryIO) -> int | None:
    if not f.seekable():
        return None
    at = f.tell()
    end = f.seek(0, io.SEEK_END)
    f.seek(at)
    return end - at


def compress_file(source: BinaryIO, target: BinaryIO, options: codec.Options = codec.Options(), progress: Progress | None = None) -> int:  # noqa: B008
    """Writes source as an archive, block by block; returns the archive's bytes. Holds a few blocks and, of a seekable archive, its blocks' sizes."""
    total = _left(source)
    size = done = hashed = 0

    def put(data: bytes) -> None:
        nonlocal size
        target.write(data)
        size += len(data)

    put(wire.file_header(options.block_size, checksums=options.checksums, dict_id=options.dictionary.id if options.dictionary.content else None))
    sizes = []
    while data := source.read(options.block_size):
        while len(data) < options.block_size and (more := source.read(options.block_size - len(data))):
            data += more
        block = codec.encode_block(data, options.level, checksums=options.checksums, dictionary=options.dictionary)
        if options.checksums:
            hashed = wire.fold_block(hashed, struct.unpack("<I", block[-4:])[0])
        put(block)
        sizes.append(len(block)) if options.seekable else None
        done += len(data)
        if progress:
            progress(done, total)
    put(wire.block_header(wire.EOF, 0))
    if options.seekable:
        put(wire.block_header(wire.SEK, 4 * len(sizes)) + struct.pack(f"<{len(sizes)}I", *sizes))
    put(wire.footer(done, hashed))
    return size


def decompress_file(source: BinaryIO, target: BinaryIO | None, progress: Progress | None = None, dictionary: codec.Dictionary = codec.NO_DICT) -> int:
    """Writes the content of the archive in source to target (None: only checks it); returns the content's bytes. Damage, truncation and a missing dictionary raise ArchiveError."""
    total, machine, done, size = _left(source), Decoder(dictionary=dictionary), 0, 0
    while not machine.finished:
        data = source.read(machine.in_size)
        out = machine.push(data) if data else machine.end()
        if machine.error:
            raise ArchiveError(machine.error)
        if target is not None:
            target.write(out)
        size += len(out)
        done += len(data)
        if progress:
            progress(done, total)
    return size


def content_size(source: BinaryIO) -> int:
    """The content's size as the footer states it: only length and magic number are checked. The place in source stays where it is."""
    at = source.tell()
    try:
        end = source.seek(0, io.SEEK_END)
        if end < 28:
            raise ArchiveError("SRC_TOO_SMALL")
        source.seek(0)
        head = source.read(16)
        source.seek(end - 12)
        return codec.content_size(head + source.read(12), strict=False)
    finally:
        source.seek(at)
