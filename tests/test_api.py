"""Buffers, streams, file objects, seekable archives and dictionaries by the bindings' names."""

import io
import random

import numpy as np
import pytest

from blockframe import api
from blockframe.functions import codec, huffman, wire
from blockframe.operators import training
from blockframe.streaming import files, push

DICE = random.Random(11)
TEXT = " ".join(DICE.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(DICE.randrange(30)) for _ in range(20_000)).encode()


def test_buffers():
    for level in range(api.min_level(), api.max_level() + 1):
        made = api.compress(TEXT[:30_000], level, checksum=level % 2 == 0)
        assert api.decompress(made, checksum=True) == TEXT[:30_000] and api.get_decompressed_size(made) == 30_000
    assert api.default_level() == 3 and api.decompress(api.compress(b"")) == b""
    with pytest.raises(api.ArchiveError, match="DST_TOO_SMALL"):
        api.decompress(api.compress(TEXT), 10)
    assert api.detect(made) and not api.detect(b"\xf5") and not api.detect(None)


def test_streams_end_once():
    with api.CStream(checksum=True, block_size=4096) as c:
        made = c.compress(TEXT) + c.end()
        assert (c.in_size, c.out_size) == (4096, 4096 + 80)
        for again in (lambda: c.compress(b"more"), c.end):
            with pytest.raises(api.ArchiveError, match="NULL_INPUT"):
                again()
    with api.DStream() as d:
        assert d.in_size == wire.DEFAULT_BLOCK == d.out_size
        first = d.decompress(made[:100])
        assert d.out_size == 4096 and not d.finished
        assert first + d.decompress(made[100:]) == TEXT and d.finished
        assert d.decompress(b"beyond") == b""


def test_decoder_tells_truncation_and_what_follows():
    made = codec.encode(TEXT, codec.Options(3, 4096))
    for cut in (0, 10, 20, 5000, len(made) - 1):
        dec = push.Decoder()
        dec.push(made[:cut])
        dec.end()
        assert dec.error == "SRC_TOO_SMALL" and not dec.finished
    dec = push.Decoder()
    assert dec.push(made + b"xyz") == TEXT and dec.finished and dec.unused == 3 and dec.rest == b""
    assert dec.push(b"more") == b"" and dec.unused == 4
    dec.end()
    assert dec.error == ""


def test_file_objects():
    target = io.BytesIO()
    with files.ArchiveWriter(target, 3, True, 4096) as w:
        for i in range(0, len(TEXT), 777):
            assert w.write(TEXT[i : i + 777]) == len(TEXT[i : i + 777])
    with pytest.raises(ValueError):
        w.write(b"x")
    made = target.getvalue()
    assert made == codec.encode(TEXT, codec.Options(3, 4096, True)) and not target.closed
    for size in (0, 1000, 1 << 20):
        assert files.ArchiveReader(io.BytesIO(made + b"tail"), size).read() == TEXT
    assert io.BufferedReader(files.ArchiveReader(io.BytesIO(made))).read(100) == TEXT[:100]
    for bad in (made[:-5], made[:40], b"", made[:5000] + b"\xff" + made[5001:]):
        with pytest.raises(OSError):
            files.ArchiveReader(io.BytesIO(bad)).read()
    for wrong in (files.ArchiveReader, files.ArchiveWriter):
        with pytest.raises(TypeError):
            wrong(object())


@pytest.mark.parametrize("seekable", (False, True))
def test_whole_files(seekable):
    seen, options = [], codec.Options(3, 4096, True, seekable)
    target = io.BytesIO()
    size = files.compress_file(io.BytesIO(TEXT), target, options, lambda done, total: seen.append((done, total)))
    made = target.getvalue()
    assert made == codec.encode(TEXT, options) and size == len(made)
    assert seen[-1] == (len(TEXT), len(TEXT)) and len(seen) == -(-len(TEXT) // 4096) and seen == sorted(seen)
    back, f = io.BytesIO(), io.BytesIO(made)
    f.seek(5)
    assert files.content_size(f) == len(TEXT) and f.tell() == 5
    assert files.decompress_file(io.BytesIO(made), back) == len(TEXT) and back.getvalue() == TEXT
    assert files.decompress_file(io.BytesIO(made), None) == len(TEXT)  # only checked
    with pytest.raises(api.ArchiveError, match="SRC_TOO_SMALL"):
        files.decompress_file(io.BytesIO(made[:-3]), None)
    forged = made[:-12] + (1 << 40).to_bytes(8, "little") + made[-4:]
    assert files.content_size(io.BytesIO(forged)) == 1 << 40  # trusts the footer
    with pytest.raises(api.ArchiveError, match="CORRUPT_DATA"):
        codec.content_size(forged)
    for bad, name in ((b"\0" * 40, "BAD_MAGIC"), (b"", "SRC_TOO_SMALL")):
        with pytest.raises(api.ArchiveError, match=name):
            files.content_size(io.BytesIO(bad))


def test_seekable():
    made = api.compress(TEXT, seekable=True, block_size=4096, checksum=True)
    for source in (made, io.BytesIO(made)):
        with api.Seekable(source) as s:
            assert s.decompressed_size == len(TEXT) and s.num_blocks == -(-len(TEXT) // 4096)
            assert sum(s.block_decompressed_size(i) for i in range(s.num_blocks)) == len(TEXT)
            assert s.block_compressed_size(s.num_blocks) is None
            for a, n in ((0, 1), (4095, 2), (5000, 20_000), (len(TEXT) - 7, 7), (3, 0)):
                assert s.decompress_range(a, n) == TEXT[a : a + n]
            with pytest.raises(api.ArchiveError, match="SRC_TOO_SMALL"):
                s.decompress_range(len(TEXT) - 1, 2)
    n = -(-len(TEXT) // 4096)
    sizes = [api.Seekable(made).block_compressed_size(i) for i in range(n)]
    assert api.write_seek_table(sizes) == made[-12 - api.seek_table_size(n) : -12]
    # a table that adds up to something else: bytes are refused, a file object is taken unless asked to be strict
    forged = made[: -12 - 4] + (sizes[-1] + 1).to_bytes(4, "little") + made[-12:]
    with pytest.raises(api.ArchiveError, match="CORRUPT_DATA"):
        api.Seekable(forged)
    assert api.Seekable(io.BytesIO(forged)).decompress_range(0, 10) == TEXT[:10]
    with pytest.raises(api.ArchiveError, match="CORRUPT_DATA"):
        api.Seekable(io.BytesIO(forged), strict=True)
    with pytest.raises(api.ArchiveError):
        api.Seekable(api.compress(TEXT))


def test_dictionaries():
    samples = [TEXT[i : i + 500] for i in range(0, 40_000, 500)]
    own = api.Dictionary.train(samples, 4096)
    assert 0 < len(own.content) <= 4096 and len(own.huf) == 128 and api.Dictionary.load(own.save()) == own
    assert api.dict_get_id(own.save()) == own.id and api.dict_get_id(b"no dictionary at all") == 0
    assert api.dict_load(own.save()) == (own.content, own.id) and api.dict_huf(own.save()) == own.huf and api.dict_huf(b"") is None
    made = api.compress(TEXT[50_000:51_000], 6, dict=own, seekable=True)
    assert api.get_dict_id(made) == own.id and len(made) < len(api.compress(TEXT[50_000:51_000], 6, seekable=True))
    assert api.decompress(made, dict=own) == TEXT[50_000:51_000]
    with api.Seekable(made) as s:
        with pytest.raises(api.ArchiveError, match="DICT_REQUIRED"):
            s.decompress_range(0, 5)
        s.set_dict(own)
        assert s.decompress_range(10, 50) == TEXT[50_010:50_060]
    assert api.train_dict([b"0123456789"], 4) == b"6789"  # nothing repeats: the tail
    for samples, size, name in (([b"abc"], 100, "SRC_TOO_SMALL"), ([TEXT], 70_000, "DICT_TOO_LARGE")):
        with pytest.raises(api.ArchiveError, match=name):
            api.train_dict(samples, size)


def test_training_in_spark_equals_training_alone(spark):
    texts = [TEXT[i : i + 700].decode() for i in range(0, 30_000, 700)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(900, None), (901, "")], "k long, t string").repartition(3)
    assert training.train(df, "k", "t", 2048).content == api.train_dict([t.encode() for t in texts], 2048)
    alone = spark.createDataFrame([(1, "abcdefgh"), (2, "ijklmnop")], "k long, t string")
    assert training.train(alone, "k", "t", 10).content == b"ghijklmnop"
    counts = {r.h: r.n for r in training.gram_table(df, "t").collect()}
    want: dict = {}
    for t in texts:
        for h in training.gram_hashes(np.frombuffer(t.encode(), np.uint8)).tolist():
            want[h] = want.get(h, 0) + 1
    assert counts == want


def test_gram_hash():
    raw = bytes(range(200, 211))
    got = training.gram_hashes(np.frombuffer(raw, np.uint8)).tolist()
    want = [((int.from_bytes(raw[i : i + 4], "little") ^ raw[i + 4]) * training.FACTOR % (1 << 32)) >> 16 for i in range(len(raw) - 4)]
    assert got == want and training.gram_hashes(np.frombuffer(raw, np.uint8), 5).tolist() == want[::5]


def test_sections_are_sized_without_coding():
    rng = np.random.default_rng(3)
    for kinds in (2, 3, 17, 256):
        data = np.minimum(rng.geometric(0.15, 5000), kinds - 1).astype(np.uint8)
        counts = np.bincount(data, minlength=256)
        for lengths in (huffman.code_lengths(counts), huffman.nudged(counts)):
            tree = huffman.Tree(lengths)
            assert tree.size(counts) == len(tree.encode(data)) and (tree.decode(tree.encode(data), len(data)) == data).all()


def test_nudged_codes_are_shallower_and_hardly_longer():
    rng = np.random.default_rng(4)
    won = 0
    for _ in range(30):
        counts = np.zeros(256, np.int64)
        counts[: rng.integers(4, 256)] = 1
        counts *= rng.integers(1, 2000, 256) ** 2
        best, other = huffman.code_lengths(counts), huffman.nudged(counts)
        bits = [int((x.astype(np.int64) * counts).sum()) for x in (best, other)]
        assert bits[1] <= 1.015 * bits[0] and other.max() <= huffman.MAX_BITS
        if (best != other).any():
            won += 1
            assert huffman.touches(other, counts) <= 230 / 256 * huffman.touches(best, counts)
    few = np.array([5, 3, 1] + [0] * 253)
    assert (huffman.nudged(few) == huffman.code_lengths(few)).all()
