"""Archives equal byte by byte to published ones, by their digests and the inputs these are of. Inputs come from a linear congruential generator (fixed values)."""

import hashlib

import pytest

from blockframe.functions import codec, wire
from blockframe.functions.wire import ArchiveError


def generator(seed):
    while True:
        seed = (seed * 1103515245 + 12345) % (1 << 32)
        yield seed


def noise(seed, n):
    dice = generator(seed)
    return bytes(next(dice) >> 24 for _ in range(n))


def repeated(unit, n):
    return (unit * (n // len(unit) + 1))[:n]


def short_runs():
    dice, out = generator(0x1357BD13), bytearray()
    while len(out) < 16_384:
        out += bytes([next(dice) >> 24]) + b"\xaa" * 4
    return bytes(out[:16_384])


DEFAULT = wire.DEFAULT_BLOCK
#: Digest, content, level.
PUBLISHED = {
    "empty": ("946c6a8895ed4a860bca87a478575b995752bd1de23b139cd661e55a603c28d4", b"", 1),
    "raw": ("88f32bc5a99c28c55adea28a140cead436a5fb3a975de6b4daa0a4ebbdecd41d", noise(0x1234567, 4096), 1),
    "far": ("12a2863619cad16f5a6138071e009b5a7017dfd6e88b427377af9ce861bd0597", repeated(noise(0x5EED1234, 1024), 8192), 3),
    "runs": ("d68513b7a6d23ee3074891e33998ba470192e64d3f976a947e1693088a2b4110", short_runs(), 3),
}


@pytest.mark.parametrize("name", PUBLISHED)
def test_digest(name):
    digest, data, level = PUBLISHED[name]
    archive = codec.encode(data, codec.Options(level, DEFAULT, False, exact=True))
    assert hashlib.sha256(archive).hexdigest() == digest and codec.decode(archive) == data


def test_every_exact_level_decodes():
    text = repeated(b"the cat sat on the mat, and the dog lay on the rug while the bird sang. ", 9000)
    for data in (text, short_runs(), noise(3, 9000), b"", b"ab" * 5, repeated(noise(9, 3000), 200_000), b"\0" * 70_000):
        for level in range(1, 6):
            for content in (b"", b"the dog lay on the rug", text[:5000]):
                own = codec.Dictionary(content)
                assert codec.decode(codec.encode(data, codec.Options(level, 1 << 16, dictionary=own, exact=True)), own) == data
    with pytest.raises(ArchiveError, match="BAD_LEVEL"):
        codec.encode(text, codec.Options(6, exact=True))
