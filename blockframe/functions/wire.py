"""The archive's bytes: constants, hashes, headers, variable-length integers, sizes."""

from __future__ import annotations

import struct

# Fixed values of the archive format.
MAGIC = 0x9CB02EF5
DICT_MAGIC = 0x9CB0D1C7
VERSION = 8
RAW, GLO, GHI, SEK, EOF = 0, 1, 2, 254, 255
LIT_RAW, LIT_RLE, LIT_HUFFMAN, LIT_SHARED = 0, 1, 2, 3
HAS_CHECKSUM, HAS_DICT = 0x80, 0x40
MIN_BLOCK, DEFAULT_BLOCK, MAX_BLOCK = 1 << 12, 1 << 19, 1 << 21
SLACK = 32
BLOCK_SALT, FILE_SALT = 0x9E3779B97F4A7C15, 0xD2D84A61D2D84A61
SECRET = (0x2D358DCCAA6C78A5, 0x8BB84B93962EACC9, 0x4B33A62ED433D4A3, 0x4D5A2DA51DE1AA47, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x90ED1765281C388C, 0xAAAAAAAAAAAAAAAA)
ERRORS = {
    0: "OK", -1: "MEMORY", -2: "DST_TOO_SMALL", -3: "SRC_TOO_SMALL", -4: "BAD_MAGIC", -5: "BAD_VERSION", -6: "BAD_HEADER", -7: "BAD_CHECKSUM", -8: "CORRUPT_DATA", -9: "BAD_OFFSET",
    -10: "OVERFLOW", -11: "IO", -12: "NULL_INPUT", -13: "BAD_BLOCK_TYPE", -14: "BAD_BLOCK_SIZE", -15: "DICT_REQUIRED", -16: "DICT_MISMATCH", -17: "DICT_TOO_LARGE", -18: "BAD_LEVEL",
}
LEVELS = {"min": 1, "default": 3, "max": 7}

M64, M32 = (1 << 64) - 1, (1 << 32) - 1


class ArchiveError(ValueError):
    def __init__(self, name: str):
        super().__init__(name)
        self.name, self.code = name, next(k for k, v in ERRORS.items() if v == name)


def _shifted(h: int) -> int:
    h ^= h << 13 & M64
    h ^= h >> 7
    return h ^ (h << 17 & M64)


def hash8(header: bytes) -> int:
    h = _shifted(int.from_bytes(header, "little") ^ BLOCK_SALT)
    return (h >> 32 ^ h) & 0xFF


def hash16(header: bytes) -> int:
    h = _shifted(int.from_bytes(header[:8], "little") ^ int.from_bytes(header[8:], "little") ^ FILE_SALT)
    folded = (h >> 32 ^ h) & M32
    return (folded >> 16 ^ folded) & 0xFFFF


def _fold(a: int, b: int) -> int:
    product = a * b
    return (product ^ product >> 64) & M64


def rapidhash(data: bytes, seed: int = 0) -> int:
    """The published 64-bit hash of that name (version 3, eight secrets)."""
    s, n = SECRET, len(data)
    seed ^= _fold(seed ^ s[2], s[1])
    if n <= 16:
        if n >= 4:
            seed ^= n
            width = 8 if n >= 8 else 4
            a, b = int.from_bytes(data[:width], "little"), int.from_bytes(data[-width:], "little")
        elif n:
            a, b = data[0] << 45 | data[-1], data[n >> 1]
        else:
            a = b = 0
        rest = n
    else:
        at, rest = 0, n
        if n > 112:
            lanes, rounds = [seed] * 7, (n - 1) // 112
            words = struct.unpack_from(f"<{14 * rounds}Q", data)
            for k in range(7):
                lane, secret = seed, s[k]
                for a, b in zip(words[2 * k :: 14], words[2 * k + 1 :: 14], strict=True):
                    product = (a ^ secret) * (b ^ lane)
                    lane = (product ^ product >> 64) & M64
                lanes[k] = lane
            seed = 0
            for lane in lanes:
                seed ^= lane
            at, rest = 112 * rounds, n - 112 * rounds
        # each further pair of words in the tail goes in with its own secret
        for k, secret in enumerate((s[2], s[2], s[1], s[1], s[2], s[1])):
            if rest > 16 * (k + 1):
                a, b = struct.unpack_from("<2Q", data, at + 16 * k)
                seed = _fold(a ^ secret, b ^ seed)
        a, b = struct.unpack("<2Q", data[-16:])
        a ^= rest
    product = (a ^ s[1]) * (b ^ seed)
    return _fold(product & M64 ^ s[7], product >> 64 ^ s[1] ^ rest)


def checksum(data: bytes, seed: int = 0) -> int:
    h = rapidhash(data, seed)
    return (h ^ h >> 32) & M32


def fold_block(total: int, block: int) -> int:
    return (total << 1 & M32 | total >> 31) ^ block


# -- headers ----------------------------------------------------------------------------------------------------


def file_header(block_size: int, *, checksums: bool = False, dict_id: int | None = None) -> bytes:
    flags = HAS_CHECKSUM * checksums | HAS_DICT * (dict_id is not None)
    head = struct.pack("<IBBBI3x2x", MAGIC, VERSION, block_size.bit_length() - 1, flags, dict_id or 0)
    return head[:14] + struct.pack("<H", hash16(head))


def is_archive(data: bytes | None) -> bool:
    """Whether data begin with an archive's magic number."""
    return data is not None and bytes(data[:4]) == struct.pack("<I", MAGIC)


def parse_file_header(data: bytes) -> dict:
    if len(data) < 16:
        raise ArchiveError("SRC_TOO_SMALL")
    magic, version, code, flags, dict_id = struct.unpack_from("<IBBBI", data)
    if magic != MAGIC:
        raise ArchiveError("BAD_MAGIC")
    if version != VERSION:
        raise ArchiveError("BAD_VERSION")
    if hash16(data[:14] + b"\0\0") != struct.unpack_from("<H", data, 14)[0] or flags & 0x0F:
        raise ArchiveError("BAD_HEADER")
    if not 12 <= code <= 21:
        raise ArchiveError("BAD_BLOCK_SIZE")
    return {"version": version, "block_size": 1 << code, "checksums": bool(flags & HAS_CHECKSUM), "dict_id": dict_id if flags & HAS_DICT else None}


def block_header(kind: int, size: int) -> bytes:
    head = struct.pack("<B2xIx", kind, size)
    return head[:7] + bytes([hash8(head)])


def parse_block_header(data: bytes) -> tuple[int, int]:
    if len(data) < 8:
        raise ArchiveError("SRC_TOO_SMALL")
    if hash8(data[:7] + b"\0") != data[7]:
        raise ArchiveError("BAD_HEADER")
    return data[0], struct.unpack_from("<I", data, 3)[0]


def footer(size: int, total: int) -> bytes:
    return struct.pack("<QI", size, total)


# -- variable-length integers -----------------------------------------------------------------------------------


def varint(value: int) -> bytes:
    if value < 1 << 7:
        return bytes([value])
    if value < 1 << 14:
        return bytes([0x80 | value & 0x3F, value >> 6])
    if value < 1 << 21:
        return bytes([0xC0 | value & 0x1F, value >> 5 & 0xFF, value >> 13])
    raise ArchiveError("OVERFLOW")


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """Value and the place after it; CORRUPT_DATA beyond the end or for prefixes of four bytes and more."""
    if at >= len(data):
        raise ArchiveError("CORRUPT_DATA")
    first = data[at]
    if first < 0x80:
        return first, at + 1
    size = 2 if first < 0xC0 else 3
    if first >= 0xE0 or at + size > len(data):
        raise ArchiveError("CORRUPT_DATA")
    if size == 2:
        return first & 0x3F | data[at + 1] << 6, at + 2
    return first & 0x1F | data[at + 1] << 5 | data[at + 2] << 13, at + 3


# -- sizes ------------------------------------------------------------------------------------------------------


def compress_bound(n: int) -> int:
    blocks = max(1, -(-n // MIN_BLOCK))
    return 16 + blocks * 80 + n + 8 + 8 + 4 * blocks + 12


def block_bound(n: int) -> int:
    return n + 80 if 1 <= n <= MAX_BLOCK else 0


def decompress_block_bound(n: int) -> int:
    return n + 2112 if n <= MAX_BLOCK else 0


def in_place_margin(n: int, block_size: int, checksums: bool) -> int:
    blocks = -(-n // block_size)
    return block_size + blocks * (12 if checksums else 8) + 8 + 8 + 4 * blocks + 12 + 2112


def block_size_for(n: int) -> int:
    return max(MIN_BLOCK, 1 << max(0, n - 1).bit_length())
