import hashlib

import pytest

from blockframe.functions import wire
from blockframe.functions.wire import ArchiveError


def lcg(n, seed):
    out, s = bytearray(), seed
    for _ in range(n):
        s = (s * 1103515245 + 12345) & wire.M32
        out.append(s >> 24)
    return bytes(out)


def test_published_digests_of_empty_and_raw_archives():
    empty = wire.file_header(1 << 19) + wire.block_header(wire.EOF, 0) + wire.footer(0, 0)
    assert hashlib.sha256(empty).hexdigest() == "946c6a8895ed4a860bca87a478575b995752bd1de23b139cd661e55a603c28d4"
    data = lcg(4096, 0x1234567)
    raw = wire.file_header(1 << 19) + wire.block_header(wire.RAW, 4096) + data + wire.block_header(wire.EOF, 0) + wire.footer(4096, 0)
    assert hashlib.sha256(raw).hexdigest() == "88f32bc5a99c28c55adea28a140cead436a5fb3a975de6b4daa0a4ebbdecd41d"


def test_header_checks():
    assert wire.file_header(1 << 19, checksums=True).hex() == "f52eb09c081380000000000000006e5b"
    assert wire.block_header(wire.RAW, 10)[7] == 0x69
    assert wire.block_header(wire.EOF, 0)[7] == 0x02
    assert wire.block_header(wire.SEK, 4)[7] == 0xD2


@pytest.mark.parametrize("value", [0, 1, 127, 128, 16383, 16384, (1 << 21) - 1])
def test_varint(value):
    data = wire.varint(value)
    assert wire.read_varint(data, 0) == (value, len(data))
    with pytest.raises(ArchiveError):
        wire.read_varint(data[:-1], 0)


def test_varint_limits():
    with pytest.raises(ArchiveError):
        wire.varint(1 << 21)
    with pytest.raises(ArchiveError):
        wire.read_varint(b"\xe0\0\0\0", 0)


def test_hash_depends_on_every_byte():
    for n in (1, 3, 4, 7, 8, 16, 17, 33, 112, 113, 224, 225, 1000):
        data = lcg(n, n)
        seen = {wire.rapidhash(data)}
        for i in range(n):
            seen.add(wire.rapidhash(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]))
        assert len(seen) == n + 1


def test_sizes():
    assert wire.block_bound(0) == 0 and wire.block_bound(10) == 90
    assert wire.block_size_for(5000) == 8192 and wire.block_size_for(1) == 4096
    assert wire.ERRORS[-18] == "BAD_LEVEL"
