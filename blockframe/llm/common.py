"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither a space nor U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> None:
    """Makes sure that a checkpoint folder is set: the one the cluster names in spark.checkpoint.dir, else, in local mode only, a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local[") or sc.master == "local":
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="blockframe-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder; its lineage ends there, so a lost executor costs nothing that came before."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(c: Column) -> Column:
    """c with A-Z lower-cased and nothing else. Pure ASCII texts take the fast path, on which lower() does the same."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def unused(df: DataFrame, name: str) -> str:
    """name, or one like it that df has no column of (upper and lower case are one)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, each: int, least: int) -> int:
    """Into how many parts to deal df, so that a part stands for `each` bytes of what Spark estimates df to hold (for files: their size); `least` at least, and where Spark has no estimate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // each)) if size < 1 << 53 else least


#: Keys of more than 1 / HOT of all rows, of which there are fewer than HOT, are broadcast to their rows; rows of other keys meet theirs in a shuffle.
HOT = 10_000


def join_dealt(rows: DataFrame, groups: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner, left or left_anti) with groups, one row a key, whose column n is at least the number of the key's rows among the total. No key of the shuffle has more than total / HOT rows."""
    hot, cold = groups.where(F.col("n") > total / HOT), groups.where(F.col("n") <= total / HOT)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return rest if how == "left_anti" else rows.join(F.broadcast(hot), on).unionByName(rest)


def bit_of(data: bytes, slot: Column) -> Column:
    """Whether bit `slot` (from 0, lowest of each byte first) of data is set."""
    byte = F.conv(F.hex(F.substring(F.lit(data), (slot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), F.pmod(slot, F.lit(8)).cast("int") + 1)) != 0


def bits_at(slots: DataFrame, size: int) -> bytes:
    """size bits with those at column slot set; the driver receives at most a row for each byte."""
    data = bytearray(size // 8)
    bit = F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), F.pmod("slot", F.lit(8)).cast("int") + 1)
    for byte, value in slots.groupBy((F.col("slot") / 8).cast("int").alias("byte")).agg(F.bit_or(bit).alias("value")).collect():
        data[byte] = value
    return bytes(data)


#: Bits of may_be_in(), of which 64 are a row of the table that is broadcast.
MANY_BITS = 1 << 22


def may_be_in(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose column may be in the only column of ids, told by bits of its hash, and all other rows. Texts of the latter need no shuffle to join with ids; more ids than bits only mean that more rows are in the first part."""
    word, held, slot = (unused(rows, name) for name in ("_bits_word", "_bits_held", "_bits_slot"))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(MANY_BITS))
    slots = ids.select(place(ids.columns[0]).alias(slot))
    bits = checkpointed(slots.groupBy((F.col(slot) / 64).cast("long").alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({slot} % 64 AS int))")).alias(held)))
    known = rows.withColumn(slot, place(column)).join(F.broadcast(bits), (F.col(slot) / 64).cast("long") == F.col(word), "left")
    known = known.withColumn(held, F.coalesce(F.expr(f"shiftright({held}, cast({slot} % 64 AS int)) & 1L"), F.lit(0)) == 1)
    return tuple(known.where(F.col(held) == hit).select(*(F.col(f"`{c}`") for c in rows.columns)) for hit in (True, False))


_LIBC = ctypes.CDLL(None)


def hand_back() -> None:
    """Returns what this worker process has freed to the system; Arrow's pool and malloc keep it otherwise, also while the worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):  # glibc only
        trim(0)


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, with hand_back() at the end of each task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return tidy
