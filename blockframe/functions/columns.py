"""The format's scalar functions as Column expressions on signed 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockframe.functions import wire

MASK32 = (1 << 32) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def le_bytes(value: Column, n: int) -> Column:
    """Hex digits of value's n lowest bytes, lowest first."""
    return F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)])


def byte_at(hexed: Column, i: Column | int) -> Column:
    """Byte i (from 0) of a hex string, as int."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(hexed, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _xorshift(h: Column) -> Column:
    h = h.bitwiseXOR(F.shiftleft(h, 13))
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 7))
    return h.bitwiseXOR(F.shiftleft(h, 17))


def hash8(word: Column) -> Column:
    """Check byte of a block header given as a little-endian integer whose last byte is 0."""
    h = _xorshift(word.bitwiseXOR(F.lit(_signed(wire.BLOCK_SALT)).cast("long")))
    return F.shiftrightunsigned(h, 32).bitwiseXOR(h).bitwiseAND(F.lit(255))


def hash16(low: Column, high: Column) -> Column:
    """Check of a file header given as two little-endian integers, bytes 14 and 15 zero."""
    h = _xorshift(low.bitwiseXOR(high).bitwiseXOR(F.lit(_signed(wire.FILE_SALT)).cast("long")))
    r = F.shiftrightunsigned(h, 32).bitwiseXOR(h).bitwiseAND(F.lit(MASK32))
    return F.shiftrightunsigned(r, 16).bitwiseXOR(r).bitwiseAND(F.lit(0xFFFF))


def block_header_word(kind: Column, size: Column) -> Column:
    return F.shiftleft(size.cast("long"), 24).bitwiseOR(kind.cast("long"))


def rotate32(v: Column, r: Column) -> Column:
    """v, below 2^32, rotated left by r in 0 to 31."""
    return F.call_function("shiftleft", v, r).bitwiseOR(F.call_function("shiftrightunsigned", v, (32 - r).cast("int"))).bitwiseAND(F.lit(MASK32))


def varint_length(v: Column) -> Column:
    """Bytes of v as a prefix integer; null beyond 21 bits."""
    return F.when(v < 1 << 7, 1).when(v < 1 << 14, 2).when(v < 1 << 21, 3)


def compress_bound(n: Column) -> Column:
    blocks = F.greatest(F.lit(1), F.ceil(n / wire.MIN_BLOCK))
    return (16 + blocks * 84 + n + 28).cast("long")


def block_bound(n: Column) -> Column:
    return F.when((n >= 1) & (n <= wire.MAX_BLOCK), n + 80).otherwise(0).cast("long")


def decompress_block_bound(n: Column) -> Column:
    return F.when(n <= wire.MAX_BLOCK, n + 2112).otherwise(0).cast("long")


def in_place_margin(n: Column, block_size: int, checksums: bool) -> Column:
    blocks = F.ceil(n / block_size)
    return (block_size + blocks * (12 if checksums else 8) + 8 + 8 + 4 * blocks + 12 + 2112).cast("long")


def error_name(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in wire.ERRORS.items() for x in kv]), code)


def is_archive(data: Column) -> Column:
    """Whether a binary column begins with an archive's magic number."""
    return F.coalesce(F.substring(data, 1, 4) == F.lit(wire.MAGIC.to_bytes(4, "little")), F.lit(False))


def block_size_for(n: Column) -> Column:
    """The smallest power of two, from the least block size on, that holds n bytes."""
    return F.element_at(F.filter(F.array(*[F.lit(wire.MIN_BLOCK << i).cast("long") for i in range(40)]), lambda b: b >= n), 1)


def footer_size(archive: Column) -> Column:
    """The content's size that the footer of an archive states (as a signed integer)."""
    at = F.octet_length(archive) - 12
    return sum((F.shiftleft(F.conv(F.hex(F.substring(archive, at + 1 + i, F.lit(1))), 16, 10).cast("long"), 8 * i) for i in range(1, 8)), F.conv(F.hex(F.substring(archive, at + 1, F.lit(1))), 16, 10).cast("long"))
