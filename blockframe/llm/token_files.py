"""Token ids in bit- or byte-plane files: encode, write in id order, read back."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockframe.llm.common import handing_back, parts_for, shared_folder, shuffle_partitions, table
from blockframe.llm.segments import SegmentEncoder, chunks

#: Ids of a block, whose planes are compressed one by one.
BLOCK_IDS = 1 << 16
#: Ids of a chunk, about: one row of the file, decoded at once.
CHUNK_IDS = 1 << 20
#: Bytes of the input for each shard; there are as many shards as this or the shuffle partitions ask for.
SHARD_BYTES = 64 << 20
#: Distinct segments that a worker remembers.
REMEMBERED = 200_000
LEVEL = 1
MAGIC = b"IDP1"
_HEAD = struct.Struct("<4sBBIQI")  # magic, bytes of an id, 1 for bit planes, ids of a block, ids, planes in the index


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The bit or byte planes of one block, lowest first."""
    raw = ids.view(np.uint8).reshape(len(ids), ids.itemsize)
    if not bits:
        return [raw[:, i].tobytes() for i in range(ids.itemsize)]
    planes = np.unpackbits(raw, axis=1, bitorder="little").T
    return [np.packbits(p, bitorder="little").tobytes() for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str, bits: bool) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not bits:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)).view(kind).reshape(n)
    got = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
    return np.packbits(got, axis=1, bitorder="little").reshape(n, width).copy().view(kind).reshape(n)


def pack(ids: np.ndarray, *, bits: bool = False, block: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """A chunk: header, index (compressed size of each plane of each block), planes. Ids fit 32 bits; 16 are used where they do."""
    ids = np.ascontiguousarray(ids, "<u4")
    ids = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids
    squeeze = zstandard.ZstdCompressor(level=level).compress
    planes = [squeeze(p) for at in range(0, len(ids), block) for p in to_planes(ids[at : at + block], bits)]
    index = np.array([len(p) for p in planes], "<u4").tobytes()
    return _HEAD.pack(MAGIC, ids.itemsize, bits, block, len(ids), len(planes)) + index + b"".join(planes)


def unpack(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of a chunk (default: all), as unsigned 32-bit integers. Only the blocks that hold them are decompressed."""
    magic, width, bits, block, n, count = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("no chunk of ids")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    each = width * (8 if bits else 1)
    at = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", count, _HEAD.size), dtype=np.int64)]) + _HEAD.size + 4 * count
    open_, out = zstandard.ZstdDecompressor().decompress, []
    for b in range(start // block, -(-stop // block)):
        size = min(block, n - b * block)
        out.append(from_planes([open_(data[at[p] : at[p + 1]]) for p in range(b * each, (b + 1) * each)], size, f"<u{width}", bool(bits)))
    first = start // block * block
    return np.concatenate(out)[start - first : stop - first].astype(np.uint32)


#: One piece of the tokenizer's pattern: letters of ASCII and U+00C0 to U+00FF (without the two signs there), after a space or not.
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _borders(flat: np.ndarray) -> np.ndarray:
    """Where the tokenizer's pattern always ends a piece: white space after a letter, digit or mark; and between letters and ASCII marks, an apostrophe excepted."""
    low = flat | 32
    ascii_letter = (low >= 97) & (low <= 122) & (flat < 128)
    space = (flat == 32) | ((flat >= 9) & (flat <= 13))
    seen = (flat > 32) & (flat < 127)
    mark = seen & ~ascii_letter & ((flat < 48) | (flat > 57)) & (flat != 39)
    latin = np.zeros(len(flat), bool)
    latin[1:] = (flat[1:] >= 128) & (flat[:-1] == 0xC3) & (flat[1:] != 0x97) & (flat[1:] != 0xB7)
    letter = ascii_letter | latin
    out = np.zeros(len(flat), bool)
    out[1:] = space[1:] & (seen | latin)[:-1] | mark[1:] & letter[:-1] | ascii_letter[1:] & mark[:-1]
    return out


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*shown}))}


@lru_cache(4)
def encoder(path: str) -> SegmentEncoder:
    """Plain segments go straight to the library's merge model, all others through its whole pipeline."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own, letters = Tokenizer.from_file(path), _byte_letters()
    model = own.model

    def encode(segments: list[bytes]) -> list[list[int]]:
        plain = [_PLAIN.fullmatch(s) is not None for s in segments]
        rest = iter(own.encode_batch([s.decode("utf-8", "replace") for s, p in zip(segments, plain, strict=True) if not p], add_special_tokens=False))
        return [[t.id for t in model.tokenize(s.decode("latin-1").translate(letters))] if p else next(rest).ids for s, p in zip(segments, plain, strict=True)]

    return SegmentEncoder(encode, _borders, tuple(t.content.encode() for t in own.get_added_tokens_decoder().values()), most=REMEMBERED)


def shard_cuts(docs: DataFrame, id_col: str = "doc_id", shards: int | None = None) -> list[int]:
    """Ids that end a shard each, ascending: quantiles, so that shards hold about as many rows each. One number a shard comes to the driver."""
    shards = shards or parts_for(docs, SHARD_BYTES, shuffle_partitions(docs.sparkSession))
    return sorted({int(x) for x in docs.approxQuantile(id_col, [i / shards for i in range(1, shards)], 0.2 / shards)}) if shards > 1 else []


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, cuts: list[int] | None = None) -> DataFrame:
    """id, n, ids (little-endian unsigned 32-bit, or 16-bit where all fit: n tells), shard (the number of cuts below the id; 0 for null ids) for each row; null texts count as empty. Every document ends in end_id. Other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(np.array(cuts or [], np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts):
                ids, at = encoder(path).texts(texts[a:b])
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(b - a + 1)
                kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
                data, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * width).astype(np.int32).tobytes()), pa.py_buffer(data)])
                own = batch.column(0).slice(a, b - a)
                shard = np.searchsorted(sent.value, own.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.diff(at)), blobs, pa.array(shard.astype(np.int32))], ["id", "n", "ids", "shard"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(handing_back(encode), "id long, n long, ids binary, shard int")


def write_ids(encoded: DataFrame, out: str, cuts: list[int], *, bits: bool = False) -> None:
    """Writes id files below out, a Parquet table of chunks: shard, chunk, n_ids, doc_ids and sizes (one entry a document), data (see pack).

    encoded: see encode_texts(), made with the same cuts. Shards hold consecutive ranges of ids and are a task each; in a shard rows ascend by id (null ids first, rows of equal id by their tokens).
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, ids, sizes, parts, total = None, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = pack(np.concatenate(parts), bits=bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([total], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                ["shard", "chunk", "n_ids", "doc_ids", "sizes", "data"],
            )

        for batch in batches:
            for s, i, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (s != shard or total >= CHUNK_IDS):
                    yield flush()
                    ids, sizes, parts, total = [], [], [], 0
                    chunk = chunk + 1 if s == shard else 0
                shard = s
                ids.append(i)
                sizes.append(n)
                parts.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4"))
                total += n
        if ids:
            yield flush()

    dealt = encoded.select("shard", "id", "n", "ids").repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("id", "ids")
    dealt.mapInArrow(handing_back(build), "shard int, chunk int, n_ids long, doc_ids array<bigint>, sizes array<bigint>, data binary").write.parquet(out)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files below path."""
    files = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, chunk, _, ids, sizes, data = (c[i].as_py() for c in batch.columns)
                raw = memoryview(unpack(data).astype("<u4").tobytes())
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(at[:-1]), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["shard", "chunk", "doc_id", "local", "n_tokens", "ids_crc32"])

    sizes = files.select("shard", "chunk", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = shards.select(F.col("shard").alias("shard2"), (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))  # one row a shard
    line = Window.partitionBy("shard").orderBy("chunk")
    places = sizes.join(before, F.col("shard") == F.col("shard2")).select(F.col("shard").alias("s"), F.col("chunk").alias("c"), (F.col("base") + F.sum("n_ids").over(line) - F.col("n_ids")).alias("first"))
    docs = files.select("shard", "chunk", "n_ids", "doc_ids", "sizes", "data").mapInArrow(handing_back(decode), "shard int, chunk int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(places, (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("c"))).select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    out = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/ids-{uuid.uuid4().hex}"
    cuts = shard_cuts(docs)
    write_ids(encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), cuts=cuts), out, cuts)
    return read_ids(spark, out)


ORACLE_SQL: dict[str, str] = {}
