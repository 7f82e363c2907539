"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe.llm.common import ascii_lower, bit_of, bits_at, checkpointed, join_dealt, table, unused

#: Bytes of the normalised text that the second level hashes.
PREFIX_BYTES = 256
#: Bits that tell which prefix groups may survive level 2, a literal of the second scan's plan. More groups than bits only mean that more texts are hashed.
SURVIVOR_BITS = 1 << 17


def _groups(docs: DataFrame, id_col: str, text_col: str, prefix_bytes: int, digest_all: bool) -> DataFrame:
    """exact_groups() and, of each row, len (bytes) and ph (hash of its prefix)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = ascii_lower(text)
    keys = [F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("len"), F.xxhash64(F.substring(F.encode(norm, "utf-8"), 1, prefix_bytes)).alias("ph")]
    digest = F.sha2(F.encode(F.col("norm") if not digest_all else norm, "utf-8"), 256).alias("text_sha256")
    rows = checkpointed(docs.select(*keys, *([digest] if digest_all else [])))
    total = rows.count()
    by_len = checkpointed(rows.groupBy("len").agg(F.count("*").alias("n")).where("n > 1"))
    level1 = join_dealt(rows, by_len, ["len"], total, "inner")
    prefix = ["len", "ph"]
    by_prefix = checkpointed(level1.groupBy(*prefix).agg(F.count("*").alias("n")).where("n > 1"))
    if not digest_all:
        slot = F.pmod(F.xxhash64(*prefix), F.lit(SURVIVOR_BITS))
        some = bits_at(by_prefix.select(slot.alias("slot")), SURVIVOR_BITS)
        hashed = docs.select(*keys, norm.alias("norm")).where(bit_of(some, slot)).select("id", *prefix, digest)
    level2 = checkpointed(join_dealt(rows if digest_all else hashed, by_prefix, prefix, total, "inner").drop("n"))
    full = [*prefix, "text_sha256"]
    groups = checkpointed(level2.groupBy(*full).agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1"))
    alone = join_dealt(rows, by_prefix, prefix, total, "left_anti").select("id", *prefix, "text_sha256" if digest_all else F.lit(None).cast("string").alias("text_sha256"))
    none = [F.lit(None).cast(groups.schema["keep"].dataType).alias("keep"), F.lit(None).cast("long").alias("n")]
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return join_dealt(level2, groups, full, total, "left").unionByName(alone.select("*", *none)).select(
        "id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256", "len", "ph"
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_bytes: int = PREFIX_BYTES, digest_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts
    the row with the largest id stays (several rows with that id: all of them). A null id loses to any id; rows of
    a group whose ids are all null have keep_id null and are all kept. Other columns of docs are ignored; an empty table gives no rows.

    Level 1 counts byte lengths, level 2 counts (length, hash of the first prefix_bytes bytes) among rows whose
    length is shared, level 3 groups by the full SHA-256 among rows that level 2 kept. digest_all=False hashes the whole text of only those
    rows, in a second scan (and of some that share a bit with them; text_sha256 is null elsewhere); digest_all=True hashes each text in
    the first scan, for callers that need every digest. Only keys and digests are shuffled, never a text.
    """
    return _groups(docs, id_col, text_col, prefix_bytes, digest_all).drop("len", "ph")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed("id", "doc_id")


ORACLE_SQL = {
    "op2_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d
"""
}


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs without the rows that lose to an equal text; all columns kept. Rows are told apart by id (null is one too), length and prefix; of
    those that agree in all three all stay if one does, so equal rows with one id stay together."""
    own, size, ph = (unused(docs, name) for name in ("_lost_id", "_lost_len", "_lost_ph"))
    found = _groups(docs, "doc_id", "text", PREFIX_BYTES, False)
    lost = found.groupBy("id", "len", "ph").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select(F.col("id").alias(own), F.col("len").alias(size), F.col("ph").alias(ph))
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(F.substring(F.encode(ascii_lower(text), "utf-8"), 1, PREFIX_BYTES))
    return docs.join(lost.hint("merge"), F.col("doc_id").eqNullSafe(F.col(own)) & (F.octet_length(text) == F.col(size)) & (key == F.col(ph)), "left_anti")
