"""Archives as rows: encoding, decoding, listing, verifying and range reads of binary columns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.functions import codec
from blockframe.functions.wire import ERRORS, ArchiveError

_CODE = {name: code for code, name in ERRORS.items()}


#: Bytes of contents that are encoded together, and of a file's row group, as is usual.
TOGETHER, ROW_GROUP = 4 << 20, 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew over as many tasks as can run at once if Spark estimates that it holds less than ROW_GROUP for each of them: a file's row group is one task's, and coding costs far more than dealing
    its rows. Larger inputs, and those without an estimate, stay as they are. Nothing is run to find out."""
    least = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(least) if size < least * ROW_GROUP else df


def map_rows(df: DataFrame, columns: list[str], schema: str, f: Callable[..., tuple]) -> DataFrame:
    """f(values of columns) gives the values of schema's further columns, next to all of columns' first."""
    return map_columns(df, columns, schema, lambda *values: [f(*row) for row in zip(*values, strict=True)])


def map_columns(df: DataFrame, columns: list[str], schema: str, f: Callable[..., list[tuple]]) -> DataFrame:
    """f(lists of the columns' values) gives a tuple of schema's further columns for each row, next to all of columns' first. It gets rows of TOGETHER bytes about (or one larger one) at once."""
    names = [part.strip().split()[0] for part in schema.split(", ")]
    kinds = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in columns[:1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = np.zeros(batch.num_rows, np.int64)
            for c in batch.columns:
                if pa.types.is_binary(c.type) or pa.types.is_string(c.type):
                    sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))
                part = batch.slice(at, end - at)
                made = list(zip(*f(*(c.to_pylist() for c in part.columns)), strict=True))
                yield pa.RecordBatch.from_pydict({columns[0]: part.column(0)} | {n: pa.array(list(v), _TYPES[t.split()[1]]) for n, v, t in zip(names, made, schema.split(", "), strict=True)})
                at = end

    return df.select(*columns).mapInArrow(run, f"{kinds}, {schema.replace('blocks blocks', f'blocks {_BLOCKS}')}")


_TYPES = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "blocks": pa.list_(pa.struct([(c, pa.int64()) for c in ("at", "size", "skip", "upto", "most")]))}
_BLOCKS = "array<struct<at:bigint,size:bigint,skip:bigint,upto:bigint,most:bigint>>"


def to_bytes(value: str | bytes | None) -> bytes | None:
    return value.encode() if isinstance(value, str) else value


def encode(df: DataFrame, key: str, data: str, options: codec.Options) -> DataFrame:
    """key, archive. Null data give null. Blocks of many rows are encoded together."""

    def all_of(_, contents: list) -> list[tuple]:
        made = iter(codec.encode_many([to_bytes(d) for d in contents if d is not None], options))
        return [(None if d is None else next(made),) for d in contents]

    return map_columns(spread(df.select(key, data)), [key, data], "archive binary", all_of)


def encode_by_block(df: DataFrame, key: str, data: str, options: codec.Options) -> DataFrame:
    """As encode, with a task's work some blocks and not whole contents: they are cut in the JVM, dealt anew, encoded and put together in order, so one large content keeps many tasks busy. Keys are one row each."""
    size = options.block_size
    raw = df.select(key, (F.encode(data, "utf-8") if dict(df.dtypes)[data] == "string" else F.col(data)).alias("raw")).withColumn("total", F.octet_length("raw").cast("long"))
    at = F.when(F.col("total") > 0, F.sequence(F.lit(0), F.floor((F.col("total") - 1) / size).cast("int")))
    cut = raw.select(key, "raw", "total", F.explode_outer(at).alias("i")).select(F.struct(key, "total", "i").alias("row"), F.substring("raw", F.col("i") * size + 1, F.lit(size)).alias("part"))

    def blocks_of(_, parts: list) -> list[tuple]:
        made = iter(codec.encode_blocks([bytes(p) for p in parts if p is not None], options.level, checksums=options.checksums, dictionary=options.dictionary, exact=options.exact))
        return [(None if p is None else next(made),) for p in parts]

    def whole(_, total: int | None, blocks: list) -> tuple[bytes | None]:
        return (None if total is None else codec.assemble([bytes.fromhex(b["h"]) for b in blocks if b["h"] is not None], total, options),)

    made = map_columns(spread(cut), ["row", "part"], "block binary", blocks_of)
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("row.i"), F.lit(0)).alias("i"), F.hex("block").alias("h"))))
    grouped = made.groupBy(F.col(f"row.{key}").alias(key)).agg(F.max("row.total").alias("total"), ordered.alias("blocks"))
    return map_rows(grouped, [key, "total", "blocks"], "archive binary", whole)


def decode(df: DataFrame, key: str, archive: str = "archive", dictionary: codec.Dictionary = codec.NO_DICT) -> DataFrame:
    """key, data, error (name, OK if none). Null archives give null data and no error."""

    def all_of(_, archives: list) -> list[tuple]:
        made = iter(codec.decode_many([bytes(a) for a in archives if a is not None], dictionary))
        got = [None if a is None else next(made) for a in archives]
        return [(None, None) if g is None else (None, g.name) if isinstance(g, ArchiveError) else (g, "OK") for g in got]

    return map_columns(df, [key, archive], "data binary, error string", all_of)


def listing(df: DataFrame, key: str, archive: str = "archive") -> DataFrame:
    """key and header fields, sizes, ratio; error if the header, footer or directory can't be read. No payload is decoded."""

    def one(_, a: bytes) -> tuple:
        try:
            head = codec.index(bytes(a))
        except ArchiveError as e:
            return (len(a), None, None, None, None, None, None, None, None, e.name)
        return (len(a), head["version"], head["block_size"], head["checksums"], head["dict_id"], head["n_blocks"], head["decompressed_size"], head["global_hash"], head["seekable"], "OK")

    return map_rows(df, [key, archive], "file_size long, format_version int, block_size long, has_checksum boolean, dict_id long, n_blocks long, decompressed_size long, global_hash long, seekable boolean, error string", one)


def read_ranges(df: DataFrame, key: str, archive: str = "archive", offset: str = "offset", length: str = "len", dictionary: codec.Dictionary = codec.NO_DICT) -> DataFrame:
    """key, data, error of the byte range of each row; only the blocks it touches are decoded."""

    def one(_, a: bytes, o: int, n: int) -> tuple[bytes | None, str]:
        try:
            return codec.read_range(bytes(a), o, n, dictionary), "OK"
        except ArchiveError as e:
            return None, e.name

    return map_rows(df, [key, archive, offset, length], "data binary, error string", one)


def read_ranges_by_block(df: DataFrame, key: str, archive: str = "archive", offset: str = "offset", length: str = "len", dictionary: codec.Dictionary = codec.NO_DICT) -> DataFrame:
    """As read_ranges, with a task's work a block and not an archive: the directory gives the blocks that a range touches, only their bytes go on, are dealt anew, decoded and put together in
    order. Keys are one row each. An empty range has empty data; of several errors the one of the first block is told."""

    def plan(_, a: bytes, o: int, n: int) -> tuple[list | None, str]:
        try:
            if not n:
                return [], "OK"
            head = codec.index(bytes(a))
            if o + n > head["decompressed_size"] or not head["seekable"]:
                raise ArchiveError("SRC_TOO_SMALL")
            codec.check_dictionary(head["dict_id"], dictionary)
            size = head["block_size"]
            touched = head["blocks"][o // size : (o + n - 1) // size + 1]
            return [{"at": at, "size": stored, "skip": max(0, o - begin), "upto": min(own, o + n - begin), "most": size} for at, stored, begin, own in touched], "OK"
        except ArchiveError as e:
            return None, e.name

    def one(_, data: bytes | None, skip: int, upto: int, most: int) -> tuple[bytes | None, str]:
        if data is None:
            return b"", "OK"
        try:
            return codec.decode_block(bytes(data), most, dictionary=dictionary)[skip:upto], "OK"
        except ArchiveError as e:
            return None, e.name

    planned = map_rows(df, [key, archive, offset, length], "blocks blocks, error string", plan)
    joined = df.select(key, archive).join(planned, key).select(key, archive, "error", F.posexplode_outer("blocks").alias("i", "b"))
    cut = joined.select(key, "error", "i", F.substring(F.col(archive), F.col("b.at").cast("int") + 1, F.col("b.size").cast("int")).alias("data"), "b.skip", "b.upto", "b.most")
    good = cut.where("error = 'OK'").withColumn("row", F.struct(key, "i"))
    made = map_rows(spread(good), ["row", "data", "skip", "upto", "most"], "part binary, failed string", one)
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("row.i"), F.lit(0)).alias("i"), F.hex("part").alias("h"), "failed")))
    whole = made.groupBy(F.col(f"row.{key}").alias(key)).agg(parts.alias("parts")).select(key, "parts", F.filter("parts", lambda p: p["failed"] != "OK").alias("bad"))
    read = whole.select(key, F.when(F.size("bad") == 0, F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), ""))).alias("data"), F.when(F.size("bad") > 0, F.element_at("bad", 1)["failed"]).otherwise("OK").alias("error"))
    return read.unionByName(planned.where("error <> 'OK'").select(key, F.lit(None).cast("binary").alias("data"), "error"))


def dictionaries(df: DataFrame, key: str, saved: str) -> DataFrame:
    """key, dict_id, content_size, file_size, error of saved dictionaries; what can't be loaded has only its size and error."""

    def one(_, data: bytes) -> tuple:
        try:
            own = codec.Dictionary.load(bytes(data))
            return own.id, len(own.content), len(data), "OK"
        except ArchiveError as e:
            return None, None, len(data), e.name

    return map_rows(df, [key, saved], "dict_id long, content_size long, file_size long, error string", one)


def error_code(name: str) -> int:
    return _CODE[name]
