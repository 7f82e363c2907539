"""The array forms of match search and decoding against plain loops."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockframe.functions import codec, matches, wire
from blockframe.functions.wire import ArchiveError

pieces = st.lists(st.sampled_from([b"a", b"ab", b"abcde", b"abcdef", b"xyzxyz", b"the cat ", b"\0" * 9, b"q"]), max_size=60).map(b"".join)


def plain(literals, before, sequences):
    out, used = bytearray(before), 0
    for run, length, distance in sequences:
        out += literals[used : used + run]
        used += run
        for _ in range(length):
            out.append(out[-distance])
    return bytes(out[len(before) :] + literals[used:])


@settings(max_examples=200, deadline=None)
@given(st.lists(pieces, max_size=6), pieces, st.integers(1, 7))
def test_sequences_rebuild_their_blocks(blocks, before, level):
    line = matches.Line(blocks, before)
    found = codec.find(line, level)
    texts = line.texts(found)
    for k, (data, text) in enumerate(zip(blocks, texts, strict=True)):
        a, b = found.bounds[k], found.bounds[k + 1]
        own = [x[a:b] for x in (found.literals, found.length, found.distance)]
        assert all(5 <= n for n in own[1]) and all(0 < d <= matches.MAX_DISTANCE for d in own[2])
        assert plain(text, before, zip(*(x.tolist() for x in own), strict=True)) == data
        assert matches.resolve(np.frombuffer(text, np.uint8), np.frombuffer(before, np.uint8), *own).tobytes() == data


@settings(max_examples=100, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=4), pieces)
def test_longest_is_what_the_nearest_candidate_gives(blocks, before):
    line = matches.Line(blocks, before)
    length, distance = line.longest(1)
    for start, data in zip(line.starts.tolist(), blocks, strict=True):
        whole = before + data
        for i in range(len(data)):
            own = len(before) + i
            near = [j for j in range(own - 1, len(before) - 1, -1) if whole[j : j + 5] == whole[own : own + 5] and own + 5 <= len(whole)]
            if near:
                n = 0
                while own + n < len(whole) and whole[near[0] + n] == whole[own + n]:
                    n += 1
                assert (length[start + i], distance[start + i]) == (n, own - near[0])


@given(st.lists(st.integers(0, (1 << 21) - 1), max_size=50))
def test_varints(values):
    data, at = matches.varints(np.array(values, np.int64))
    assert data == b"".join(map(wire.varint, values)) and at[-1] == len(data)


def test_far_and_long_matches():
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, 70_000).astype(np.uint8).tobytes()
    for data in (noise[:65_530] + noise[:500], noise + noise, b"z" * 300_000, (noise[:1000] + b"!") * 90):
        for level in (1, 3, 6):
            block = codec.encode_block(data, level)
            assert codec.decode_block(block) == data
            if data[:1] == b"z" or len(data) == 90 * 1001:
                assert len(block) < len(data) // 20


def test_errors_come_in_the_order_of_the_sequences():
    """A bad distance before a bad length is the one that is named, and the other way round."""
    import struct

    def payload(*sequences, literals=b"abcdefgh"):
        words = b"".join(struct.pack("<I", r << 24 | m << 16 | d - 1) for r, m, d in sequences)
        body = words + bytes(max(0, wire.SLACK - len(words)))
        return struct.pack("<IIBBBB", len(sequences), len(literals), 0, 0, 0, 0) + literals + body

    with pytest.raises(ArchiveError, match="BAD_OFFSET"):
        codec.decode_payload(wire.GHI, payload((2, 0, 9), (200, 0, 1)), 1000)
    with pytest.raises(ArchiveError, match="CORRUPT_DATA"):
        codec.decode_payload(wire.GHI, payload((200, 0, 1), (2, 0, 900)), 1000)
    assert codec.decode_payload(wire.GHI, payload((2, 0, 2), (1, 1, 1)), 1000) == b"ab" + b"ababa" + b"c" + b"cccccc" + b"defgh"


def test_blocks_encoded_together_equal_blocks_alone():
    rng = np.random.default_rng(1)
    blocks = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (0, 1, 4, 5, 6, 300, 5000, 40_000, 7)]
    for level in range(1, 7):
        together = codec.encode_blocks(blocks, level, checksums=True)
        assert [codec.decode_block(b, checksums=True) for b in together] == blocks
        assert together == [codec.encode_block(b, level, checksums=True) for b in blocks]


def test_archives_decoded_together():
    """Good ones, damaged ones and ones with a dictionary among each other: each has its own content or error."""
    rng = np.random.default_rng(2)
    contents = [bytes(rng.integers(97, 99 + n % 5, n * 37).astype(np.uint8)) for n in range(60)] + [b"abc" * 100_000, b""]
    own = codec.Dictionary(contents[50])
    made = [codec.encode(c, codec.Options(1 + i % 5, 4096, dictionary=own if i % 7 == 3 else codec.NO_DICT)) for i, c in enumerate(contents)]
    assert codec.decode_many(made, own) == contents
    bad = [a[:-1] + bytes([a[-1] ^ 1]) if i % 3 == 0 else a for i, a in enumerate(made)]
    got = codec.decode_many(bad)
    for i, (g, c) in enumerate(zip(got, contents, strict=True)):
        if i % 7 == 3:
            assert g.name == "DICT_REQUIRED"
        elif i % 3 == 0:
            assert g.name == "BAD_CHECKSUM"
        else:
            assert g == c
    assert codec.decode_many([]) == []
