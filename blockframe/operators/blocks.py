"""Operators over blocks: splitting, directories, ranges, ordered hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockframe.functions import columns as C

HEADER = 8


def split_blocks(df: DataFrame, data: str, block_size: int) -> DataFrame:
    """A row for each block of the binary column data: block (from 0), part. Empty and null data have none."""
    n = F.octet_length(data)
    at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block_size).cast("int")))
    rest = [c for c in df.columns if c != data]
    return df.select(*rest, data, F.explode(at).alias("block")).select(*rest, "block", F.substring(F.col(data), F.col("block") * block_size + 1, F.lit(block_size)).alias("part"))


def seek_index(blocks: DataFrame, key: str, stored: Column) -> DataFrame:
    """blocks (key, block, n_bytes) with phys (bytes stored) and comp_off: a prefix sum in each archive."""
    line = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("phys", stored).withColumn("comp_off", 16 + F.coalesce(F.sum("phys").over(line), F.lit(0)))


def range_to_blocks(ranges: DataFrame, block_size: int) -> DataFrame:
    """Rows (…, offset, len) to the blocks they touch: block, skip, copy. Empty ranges touch none."""
    first, last = F.floor(F.col("offset") / block_size), F.floor((F.col("offset") + F.col("len") - 1) / block_size)
    touched = ranges.where("len > 0").withColumn("block", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    skip = F.greatest(F.lit(0), F.col("offset") - F.col("block") * block_size)
    upto = F.least(F.lit(block_size), F.col("offset") + F.col("len") - F.col("block") * block_size)
    return touched.withColumn("skip", skip.cast("long")).withColumn("copy", (upto - skip).cast("long"))


def fold_hash(blocks: DataFrame, key: str, value: str) -> DataFrame:
    """key, n_blocks, global_hash of rows (key, block, value). The running hash g = rotl(g, 1) ^ b is linear over XOR, so each block's share, rotated by its distance from the end, adds up in any order: no sort, partial aggregation."""
    n = blocks.groupBy(key).agg(F.count("*").alias("n_blocks"))
    share = C.rotate32(F.col(value), F.pmod(F.col("n_blocks") - 1 - F.col("block"), F.lit(32)).cast("int"))
    return blocks.join(n, key).withColumn("share", share).groupBy(key).agg(F.max("n_blocks").alias("n_blocks"), F.expr("bit_xor(share)").alias("global_hash"))


def fold_hash_ordered(blocks: DataFrame, key: str, value: str) -> DataFrame:
    """As fold_hash, by the recurrence itself over each archive's blocks in order. For checking; gathers an archive's hashes in one row."""
    ordered = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", F.col(value).alias("v")))).alias("list"))
    step = lambda g, x: C.rotate32(g, F.lit(1)).bitwiseXOR(x["v"])
    return ordered.select(key, F.size("list").cast("long").alias("n_blocks"), F.aggregate("list", F.lit(0).cast("long"), step).alias("global_hash"))


def footer_plausible(archives: DataFrame, size: str, block_size: str, stored: str) -> DataFrame:
    """Archives whose footer could be true: no more blocks than an eighth of the bytes stored."""
    return archives.where(F.ceil(F.col(size) / F.col(block_size)) <= F.floor(F.col(stored) / HEADER))
