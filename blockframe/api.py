"""The engine by the names that bindings of the format offer: whole buffers, streams, seekable archives, dictionaries. Explicit defaults: level 3, no checksum for buffers."""

from __future__ import annotations

import struct
from typing import BinaryIO

from blockframe.functions import codec, wire
from blockframe.functions.codec import dictionary_id as dict_get_id
from blockframe.functions.wire import ArchiveError
from blockframe.functions.wire import is_archive as detect
from blockframe.streaming import files
from blockframe.streaming.files import ArchiveReader as Reader
from blockframe.streaming.files import ArchiveWriter as Writer
from blockframe.streaming.push import Decoder, Encoder

__all__ = [
    "ArchiveError", "CStream", "DStream", "Dictionary", "Reader", "Seekable", "Writer", "compress", "decompress", "default_level", "detect", "dict_get_id", "dict_huf", "dict_id", "dict_load", "dict_save",
    "get_decompressed_size", "get_dict_id", "max_level", "min_level", "seek_table_size", "stream_compress", "stream_decompress", "train_dict", "train_dict_huf", "write_seek_table",
]


def min_level() -> int:
    return wire.LEVELS["min"]


def max_level() -> int:
    return wire.LEVELS["max"]


def default_level() -> int:
    return wire.LEVELS["default"]


# -- buffers ----------------------------------------------------------------------------------------------------


def _dictionary(content, table: bytes | None) -> codec.Dictionary:
    if isinstance(content, Dictionary):
        return content.own
    return codec.Dictionary(content, table) if content else codec.NO_DICT


def compress(data: bytes, level: int = 3, checksum: bool = False, dict=None, dict_huf: bytes | None = None, block_size: int = 0, seekable: bool = False) -> bytes:  # noqa: A002
    """An archive of data. block_size 0: the smallest power of two that holds data, up to the default."""
    size = block_size or min(wire.DEFAULT_BLOCK, wire.block_size_for(len(data)))
    return codec.encode(bytes(data), codec.Options(level, size, checksum, seekable, _dictionary(dict, dict_huf)))


def decompress(data: bytes, decompress_size: int | None = None, checksum: bool = False, dict=None, dict_huf: bytes | None = None) -> bytes:  # noqa: A002
    """The content; decompress_size is what may come out at most, checksum whether checksums are looked at."""
    if decompress_size is not None and codec.content_size(bytes(data)) > decompress_size:
        raise ArchiveError("DST_TOO_SMALL")
    return codec.decode(bytes(data), _dictionary(dict, dict_huf), verify=checksum)


def get_decompressed_size(data: bytes) -> int:
    return codec.content_size(bytes(data))


def stream_compress(src: BinaryIO, dst: BinaryIO, level: int = 3, checksum: bool = False, seekable: bool = False, dict=None, dict_huf: bytes | None = None, progress: files.Progress | None = None) -> int:  # noqa: A002
    return files.compress_file(src, dst, codec.Options(level, wire.DEFAULT_BLOCK, checksum, seekable, _dictionary(dict, dict_huf)), progress)


def stream_decompress(src: BinaryIO, dst: BinaryIO | None, dict=None, dict_huf: bytes | None = None, progress: files.Progress | None = None) -> int:  # noqa: A002
    return files.decompress_file(src, dst, progress, _dictionary(dict, dict_huf))


# -- push streams -----------------------------------------------------------------------------------------------


class CStream:
    """Push encoder: compress() what comes, then end()."""

    def __init__(self, level: int = 3, checksum: bool = False, block_size: int = wire.DEFAULT_BLOCK):
        self._own = Encoder(codec.Options(level, block_size, checksum))
        self.in_size, self.out_size = self._own.in_size, self._own.out_size

    def compress(self, data) -> bytes:
        return self._own.push(bytes(data))

    def end(self) -> bytes:
        return self._own.end()

    def __enter__(self) -> CStream:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._own.phase = "done"


class DStream:
    """Push decoder: decompress() what comes; finished tells whether the archive is complete. Errors raise, and go on to."""

    def __init__(self):
        self._own = Decoder()

    def decompress(self, data) -> bytes:
        out = self._own.push(bytes(data))
        if self._own.error and not out:
            raise ArchiveError(self._own.error)
        return out

    @property
    def finished(self) -> bool:
        return self._own.finished

    @property
    def in_size(self) -> int:
        return self._own.in_size

    @property
    def out_size(self) -> int:
        return self._own.out_size

    def __enter__(self) -> DStream:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._own.error = self._own.error or ("" if self.finished else "NULL_INPUT")


# -- seekable archives ------------------------------------------------------------------------------------------


class Seekable:
    """Random access to a seekable archive, given as bytes or as a file object that seeks; of the latter only header, footer, seek table and the blocks asked for are read.

    strict: the seek table must add up to where the content ends. Bytes are checked so by default, file objects are not.
    """

    def __init__(self, source: bytes | BinaryIO, strict: bool | None = None):
        self._file = None if isinstance(source, (bytes, bytearray, memoryview)) else source
        self._data = b"" if self._file else bytes(source)
        strict = self._file is None if strict is None else strict
        self.size = self._file.seek(0, 2) if self._file else len(self._data)
        if self.size < 44:
            raise ArchiveError("SRC_TOO_SMALL")
        head, tail = self._read(0, 16), self._read(self.size - 12, 12)
        block, total = wire.parse_file_header(head)["block_size"], struct.unpack("<Q", tail[:8])[0]
        n = -(-total // block)
        if n > self.size // 8:
            raise ArchiveError("CORRUPT_DATA")
        table = self._read(self.size - 20 - 4 * n, 8 + 4 * n) if self.size >= 36 + 4 * n else b""
        self._head = codec.directory(head, table + tail, self.size, strict)
        if not self._head["seekable"]:
            raise ArchiveError("BAD_BLOCK_TYPE")
        self._dictionary = codec.NO_DICT

    def _read(self, at: int, n: int) -> bytes:
        if self._file is None:
            return self._data[at : at + n]
        self._file.seek(at)
        return self._file.read(n)

    @property
    def num_blocks(self) -> int:
        return self._head["n_blocks"]

    @property
    def decompressed_size(self) -> int:
        return self._head["decompressed_size"]

    def block_compressed_size(self, block_idx: int) -> int | None:
        return self._head["blocks"][block_idx][1] if 0 <= block_idx < self.num_blocks else None

    def block_decompressed_size(self, block_idx: int) -> int | None:
        return self._head["blocks"][block_idx][3] if 0 <= block_idx < self.num_blocks else None

    def set_dict(self, dict, dict_huf: bytes | None = None) -> None:  # noqa: A002
        made = _dictionary(dict, dict_huf)
        codec.check_dictionary(self._head["dict_id"], made)
        self._dictionary = made

    def decompress_range(self, offset: int, length: int) -> bytes:
        if not length:
            return b""
        if offset < 0 or offset + length > self.decompressed_size:
            raise ArchiveError("SRC_TOO_SMALL")
        codec.check_dictionary(self._head["dict_id"], self._dictionary)
        use, size = self._dictionary if self._head["dict_id"] is not None else codec.NO_DICT, self._head["block_size"]
        first, last = offset // size, (offset + length - 1) // size
        out = b"".join(codec.decode_block(self._read(at, n), size, dictionary=use) for at, n, _, _ in self._head["blocks"][first : last + 1])
        return out[offset - first * size :][:length]

    def close(self) -> None:
        self._data = b""

    def __enter__(self) -> Seekable:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def seek_table_size(num_blocks: int) -> int:
    return 8 + 4 * num_blocks


def write_seek_table(comp_sizes: list[int]) -> bytes:
    return wire.block_header(wire.SEK, 4 * len(comp_sizes)) + struct.pack(f"<{len(comp_sizes)}I", *comp_sizes)


# -- dictionaries -----------------------------------------------------------------------------------------------


def train_dict(samples: list[bytes], max_size: int = 65_535) -> bytes:
    """A dictionary's content from samples that fit one machine; for a corpus see operators.training."""
    from blockframe.operators import training

    return training.choose(samples, max_size)


def train_dict_huf(samples: list[bytes], dict: bytes) -> bytes:  # noqa: A002
    slices = [s[i : i + 4096] for s in samples for i in range(0, len(s), 4096)]
    return codec.train_table(codec.literal_counts(slices, dict))


def dict_id(content: bytes) -> int:
    return codec.Dictionary(content).id


def get_dict_id(archive: bytes) -> int:
    return wire.parse_file_header(archive)["dict_id"] or 0


def dict_save(content: bytes, huf_lengths: bytes) -> bytes:
    return codec.Dictionary(content, huf_lengths).save()


def dict_load(saved: bytes) -> tuple[bytes, int]:
    own = codec.Dictionary.load(saved)
    return own.content, own.id


def dict_huf(saved: bytes) -> bytes | None:
    try:
        return codec.Dictionary.load(saved).table
    except ArchiveError:
        return None


class Dictionary:
    """content, huf (packed code lengths) and id of a trained dictionary."""

    def __init__(self, content: bytes, huf: bytes):
        self.own = codec.Dictionary(content, huf)
        self.content, self.huf, self.id = content, huf, self.own.id

    @classmethod
    def train(cls, samples: list[bytes], max_size: int = 65_535) -> Dictionary:
        content = train_dict(samples, max_size)
        return cls(content, train_dict_huf(samples, content))

    @classmethod
    def load(cls, saved: bytes) -> Dictionary:
        own = codec.Dictionary.load(saved)
        return cls(own.content, own.table)

    def save(self) -> bytes:
        return self.own.save()

    def __eq__(self, other) -> bool:
        return isinstance(other, Dictionary) and (self.content, self.huf) == (other.content, other.huf)

    def __hash__(self) -> int:
        return hash((self.content, self.huf))
