import os

import pytest

from blockframe.functions import codec, wire
from blockframe.operators import archives, blocks
from blockframe.sources.archive import register
from blockframe.streaming import push

TEXT = "one sentence that is repeated with a number {} in it. "


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("arc")) + "/out"
    register(spark)
    rows = [(f"f{i}", "".join(TEXT.format(j * i) for j in range(300 * i)).encode()) for i in range(1, 4)] + [("none", b"")]
    spark.createDataFrame(rows, "name string, data binary").write.format("blkarc").option("level", "3").option("block_size", "4096").mode("append").save(top)
    return top, dict(rows)


def test_files_read_back(spark, written):
    top, rows = written
    got = {os.path.basename(r.path)[:-4]: bytes(r.data) for r in spark.read.format("blkarc").option("mode", "bytes").load(top).collect()}
    assert got == rows
    assert not [f for f in os.listdir(top) if f.endswith(".part")]


def test_index_and_blocks(spark, written):
    top, rows = written
    index = {os.path.basename(r.path)[:-4]: r for r in spark.read.format("blkarc").option("mode", "index").load(top).collect()}
    assert {k: r.decompressed_size for k, r in index.items()} == {k: len(v) for k, v in rows.items()}
    some = spark.read.format("blkarc").load(top).where("block_idx >= 2 and block_idx < 4").collect()
    assert {r.block_idx for r in some} == {2, 3}
    for r in some:
        assert bytes(r.data) == rows[os.path.basename(r.path)[:-4]][r.decomp_off : r.decomp_off + r.decomp_size]


@pytest.mark.parametrize("step", (1, 7, 4096, 100_000))
def test_chunk_borders_do_not_matter(step):
    data = (TEXT * 300).encode()
    options = codec.Options(3, 4096)
    enc = push.Encoder(options)
    made = b"".join(enc.push(data[i : i + step]) for i in range(0, len(data), step)) + enc.end()
    assert made == codec.encode(data, options)
    dec = push.Decoder()
    assert b"".join(dec.push(made[i : i + step]) for i in range(0, len(made), step)) == data
    assert dec.finished


def test_errors_stick():
    made = bytearray(codec.encode((TEXT * 300).encode(), codec.Options(3, 4096)))
    made[-1] ^= 1
    dec = push.Decoder()
    assert dec.push(bytes(made)) and dec.error == "BAD_CHECKSUM" and not dec.finished
    assert dec.push(b"more") == b"" and dec.error == "BAD_CHECKSUM"
    with pytest.raises(wire.ArchiveError):
        push.Encoder(codec.Options(3, 4096, dictionary=codec.Dictionary(b"words")))


def test_empty_and_null_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "abc")], "id int, text string")
    assert {r.id: r.archive and bytes(r.archive) for r in archives.encode_by_block(df, "id", "text", codec.Options(3, 4096)).collect()} == {1: None, **{i: codec.encode(t, codec.Options(3, 4096)) for i, t in ((2, b""), (3, b"abc"))}}
    made = archives.encode(df, "id", "text", codec.Options(3, 4096))
    assert {r.id: r.data and bytes(r.data) for r in archives.decode(made, "id").collect()} == {1: None, 2: b"", 3: b"abc"}
    from pyspark.sql import functions as F

    parts = blocks.split_blocks(df.select("id", F.encode("text", "utf-8").alias("data")), "data", 2)
    assert sorted((r.id, r.block, bytes(r.part)) for r in parts.collect()) == [(3, 0, b"ab"), (3, 1, b"c")]
    nothing = spark.createDataFrame([], "id int, text string")
    assert archives.decode(archives.encode(nothing, "id", "text", codec.Options()), "id").count() == 0


def test_large_archives_are_split_over_tasks(spark, written, monkeypatch):
    from blockframe.sources import archive

    top, rows = written
    monkeypatch.setattr(archive, "PARTITION_BYTES", 2000)
    reader = archive.ArchiveReader({"path": top})
    parts = reader.partitions()
    biggest = max(rows, key=lambda k: len(rows[k]))
    ranges = sorted(p.files[0][1:] for p in parts if p.files[0][0].endswith(f"{biggest}.blk"))
    assert len(ranges) > 1 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    got: dict = {}
    for p in parts:
        for path, i, _, _, _, _, data in reader.read(p):
            got.setdefault(os.path.basename(path)[:-4], {})[i] = bytes(data)
    assert {k: b"".join(v[i] for i in sorted(v)) for k, v in got.items()} == {k: v for k, v in rows.items() if v}
    reader.low, reader.high = 1, 2
    assert {r[1] for p in reader.partitions() for r in reader.read(p)} == {1, 2}
    bytes_ = archive.ArchiveReader({"path": f"file://{top}/f*.blk", "mode": "bytes"})
    assert {os.path.basename(r[0])[:-4] for p in bytes_.partitions() for r in bytes_.read(p)} == {"f1", "f2", "f3"}


def test_dictionaries_in_the_source(spark, tmp_path):
    register(spark)
    own = codec.Dictionary((TEXT * 20).encode())
    (tmp_path / "words.dict").write_bytes(own.save())
    rows = [("a", TEXT.format(7).encode()), ("b", (TEXT.format(8) * 300).encode())]
    spark.createDataFrame(rows, "name string, data binary").write.format("blkarc").option("dictionary", f"{tmp_path}/words.dict").option("level", "6").option("block_size", "4096").mode("append").save(f"{tmp_path}/out")
    for mode in ("bytes", "blocks"):
        read = spark.read.format("blkarc").option("mode", mode).option("dictionary", f"{tmp_path}/words.dict").load(f"{tmp_path}/out").collect()
        assert sum(len(r.data) for r in read) == sum(len(d) for _, d in rows)
        with pytest.raises(Exception, match="DICT_REQUIRED"):
            spark.read.format("blkarc").option("mode", mode).load(f"{tmp_path}/out").collect()
    ids = {r.dict_id for r in spark.read.format("blkarc").option("mode", "index").load(f"{tmp_path}/out").collect()}
    assert ids == {codec.Dictionary.load(own.save()).id}


def test_names_of_written_archives(spark, tmp_path):
    register(spark)

    def write(names, mode="append", data=b"x" * 100):
        spark.createDataFrame([(n, data) for n in names], "name string, data binary").write.format("blkarc").mode(mode).save(f"{tmp_path}/out")

    def there():
        return sorted(f for f in os.listdir(tmp_path / "out"))

    write(["a", "b"])
    for bad in (["../c"], ["x/y"], [".z"], [""], ["c", "c"], ["b"]):
        with pytest.raises(Exception):  # noqa: B017
            write(bad)
        assert there() == ["a.blk", "b.blk"] and not (tmp_path / "c.blk").exists()
    write(["d"], "overwrite", b"new")
    assert there() == ["d.blk"]
    got = spark.read.format("blkarc").option("mode", "bytes").load(f"{tmp_path}/out").collect()
    assert [bytes(r.data) for r in got] == [b"new"]


def test_streams_name_their_errors_and_leave_no_state(spark, tmp_path):
    """Through Structured Streaming: a whole archive, one that is cut, one with bytes after it, rows after the end."""
    made = codec.encode((TEXT * 200).encode(), codec.Options(3, 4096))
    streams = {"whole": made, "cut": made[:-7], "more": made + b"zz", "bad": made[:100] + bytes([made[100] ^ 255]) + made[101:]}
    rows = [(k, i, v[i * 1000 : i * 1000 + 1000], (i + 1) * 1000 >= len(v)) for k, v in streams.items() for i in range(-(-len(v) // 1000))]
    rows.append(("whole", 10_000, b"late", False))
    df = spark.createDataFrame(rows, push.IN)
    out = push.run_once(spark, df, push.decode_stream, str(tmp_path / "s")).collect()
    errors = {}
    for r in sorted(out, key=lambda r: r.seq):
        errors.setdefault(r.stream_id, []).append(r.error)
    assert errors["whole"][:-1] == [""] * (len(errors["whole"]) - 1) and errors["whole"][-1] == "NULL_INPUT"
    assert errors["cut"][-1] == "SRC_TOO_SMALL" and errors["more"][-1] == "CORRUPT_DATA" and errors["bad"][-1] in ("BAD_CHECKSUM", "BAD_HEADER")
    whole = b"".join(bytes(r.chunk) for r in sorted(out, key=lambda r: r.seq) if r.stream_id == "whole")
    assert whole == (TEXT * 200).encode()
    coded = push.run_once(spark, spark.createDataFrame([("e", 0, TEXT.encode(), True), ("e", 1, b"late", False)], push.IN), lambda d: push.encode_stream(d, codec.Options(3, 4096)), str(tmp_path / "e")).collect()
    assert {r.seq: r.error for r in coded} == {0: "", 1: "NULL_INPUT"}
