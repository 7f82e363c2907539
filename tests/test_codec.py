import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockframe.functions import codec, wire
from blockframe.functions.huffman import Tree, code_lengths, pack_lengths, unpack_lengths
from blockframe.functions.wire import ArchiveError

DICE = random.Random(42)
TEXT = b"a fixed paragraph that comes again and again, with small changes now and then. " * 200
PAYLOADS = {
    "empty": b"", "one": b"x", "random": DICE.randbytes(20_000), "text": TEXT, "zeros": bytes(9_000), "near": b"ABCDE" * 3_000,
    "far": (block := DICE.randbytes(300)) + block + DICE.randbytes(2_000) + block, "runs": b"".join(bytes([DICE.randrange(256)]) + b"\xaa" * 4 for _ in range(3_000)),
    "skewed": bytes(DICE.choice(b"aaaaaabbbbccdefg") for _ in range(16_384)), "wide": bytes(DICE.randrange(220) ** 2 // 220 for _ in range(12_000)), "numbers": np.arange(0, 400_000, 100, dtype="<u4").tobytes(),
}


@pytest.mark.parametrize("level", range(1, 8))
@pytest.mark.parametrize("name", PAYLOADS)
def test_round_trip(name, level):
    data = PAYLOADS[name]
    for size in (4096, 1 << 16):
        options = codec.Options(level, size, seekable=level % 2 == 0, checksums=level != 3)
        assert codec.decode(codec.encode(data, options)) == data


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40), st.integers(1, 60)), max_size=30), st.integers(1, 7))
def test_round_trip_of_anything(parts, level):
    data = b"".join(a * n for a, n in parts)
    assert codec.decode(codec.encode(data, codec.Options(level, 4096))) == data


def test_ranges_read_only_what_they_need():
    data = PAYLOADS["wide"] * 5
    archive = codec.encode(data, codec.Options(3, 4096, seekable=True))
    for offset, n in ((0, 1), (4095, 2), (4096, 4096), (10_000, 30_000), (len(data) - 1, 1), (5, 0)):
        assert codec.read_range(archive, offset, n) == data[offset : offset + n]
    with pytest.raises(ArchiveError, match="SRC_TOO_SMALL"):
        codec.read_range(archive, len(data), 1)
    broken = bytearray(archive)
    broken[30] ^= 1  # in the first block, which a later range doesn't touch
    assert codec.read_range(bytes(broken), 8192, 100) == data[8192:8292]


@pytest.mark.parametrize("level", (3, 6, 7))
def test_dictionaries(level):
    own = codec.Dictionary(TEXT[:800], codec.train_table(codec.literal_counts([TEXT[300:2000] + b"rest of it"], TEXT[:800])))
    assert codec.Dictionary.load(own.save()) == own
    data = TEXT[100:700] + b"something else"
    archive = codec.encode(data, codec.Options(level, 4096, dictionary=own))
    assert len(archive) < len(codec.encode(data, codec.Options(level, 4096)))
    assert codec.decode(archive, own) == data
    with pytest.raises(ArchiveError, match="DICT_REQUIRED"):
        codec.decode(archive)
    with pytest.raises(ArchiveError, match="DICT_MISMATCH"):
        codec.decode(archive, codec.Dictionary(b"another"))


def test_errors():
    archive = codec.encode(TEXT, codec.Options(3, 4096))
    cases = {
        "SRC_TOO_SMALL": [b"", archive[:4], archive[:16], archive[:40]],
        "BAD_MAGIC": [b"\xff" * 100, b"\0" + archive[1:]],
        "BAD_VERSION": [archive[:4] + b"\0" * 60],
        "BAD_HEADER": [archive[:14] + b"\0\0" + archive[16:], archive[:23] + bytes([archive[23] ^ 1]) + archive[24:]],
        "BAD_CHECKSUM": [archive[:60] + bytes([archive[60] ^ 1]) + archive[61:], archive[:-1] + bytes([archive[-1] ^ 1])],
    }
    for name, bad in cases.items():
        for b in bad:
            with pytest.raises(ArchiveError, match=name):
                codec.decode(b)
    kind = wire.block_header(7, 5)
    with pytest.raises(ArchiveError, match="BAD_BLOCK_TYPE"):
        codec.decode(archive[:16] + kind + archive[24:])
    head = wire.file_header(4096)
    forged = head[:5] + b"\x08" + head[6:14]
    import struct

    forged += struct.pack("<H", wire.hash16(forged + b"\0\0"))
    with pytest.raises(ArchiveError, match="BAD_BLOCK_SIZE"):
        codec.decode(forged + archive[16:])


def test_forged_payloads_never_read_outside():
    kind, payload = codec.encode_payload(TEXT, 3)
    for i in range(len(payload)):
        for bit in (1, 128):
            bad = payload[:i] + bytes([payload[i] ^ bit]) + payload[i + 1 :]
            try:
                assert len(codec.decode_payload(kind, bad, len(TEXT))) <= len(TEXT)
            except ArchiveError:
                pass


@pytest.mark.parametrize("limit", (8, 11))
def test_code_lengths(limit):
    for counts in (np.array([1] * 256), np.array([2**i for i in range(30)] + [0] * 226), np.array([5, 1] + [0] * 254), np.array([7] + [0] * 255)):
        lengths = code_lengths(counts, limit)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= limit
        assert (unpack_lengths(pack_lengths(lengths)) == lengths).all()
        data = np.repeat(np.arange(256), np.minimum(counts, 50)).astype(np.uint8)
        np.random.default_rng(1).shuffle(data)
        assert (Tree(lengths).decode(Tree(lengths).encode(data), len(data)) == data).all()


def test_bad_code_lengths():
    with pytest.raises(ArchiveError):
        Tree(np.zeros(256, np.uint8))
    with pytest.raises(ArchiveError):
        Tree(np.array([1, 2] + [0] * 254, np.uint8))


def test_cheapest_paths_cover_the_data_and_pay():
    for level in (6, 7):
        for data in (*PAYLOADS.values(), b"abcde" * 2, bytes(5)):
            sequences, rest = codec.parse(data, 0, level)
            out, at = bytearray(), 0
            for run, length, distance in sequences:
                out += data[at : at + run]
                assert 5 <= length and 0 < distance <= min(len(out), codec.MAX_DISTANCE)
                for _ in range(length):
                    out.append(out[-distance])
                at += run + length
            assert bytes(out) == data[:rest]
    prose = " ".join(DICE.choice(("block", "stream", "table", "archive", "seek", "window")) + DICE.choice(("s", "ed", "ing", "")) for _ in range(4_000)).encode()
    sizes = [len(codec.encode(prose, codec.Options(level))) for level in (5, 6, 7)]
    assert sizes[0] > sizes[1] > sizes[2]
