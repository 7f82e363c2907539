"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockframe.llm.common import table

#: Bytes of query vectors and their histograms that a pass over the rows holds in each task; more queries are searched in further passes.
PASS_BYTES = 16_000_000
#: Bins of a histogram.
BINS = 256
#: Scores held at once by a task: queries times rows of a batch.
CELLS = 1 << 21


def _matrix(batch: pa.RecordBatch, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """ids and integer components of a batch's rows, in which nulls and other widths no longer occur."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, width or 0))


def _scores(queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products. Doubles are exact while every partial sum stays under 2^53."""
    if exact:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k highest scores among all other rows of vectors (all, if fewer); ties to the smaller vec_id.

    A component x counts as floor(scale * x); the score is the integer inner product. Rows whose id or vector is null, or whose
    vector is empty or holds null or non-finite components, take no part; a query is compared with rows of its own width. Rows
    that share the query's id are its own. Repeated rows are candidates each. Other columns are ignored; empty tables give no rows.

    Each pass scores a bounded set of broadcast queries against all rows, task by task. The first passes return histograms of
    the scores in each query's current interval; the interval narrows to the bin that holds the k-th value until the
    bin is one score wide. The last pass returns the rows above that value and, of each batch, the k smallest ids at it.
    Nothing but histograms and at most k rows per query and batch leaves a task. Sums beyond 2^62 are refused.
    """
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), F.col(vec_col).alias("raw")).where(
        F.col("id").isNotNull() & F.col("raw").isNotNull() & (F.size("raw") > 0) & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).select("id", "v")
    spark = vectors.sparkSession
    rows, asked = clean(vectors), clean(queries)
    shapes = asked.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = empty
    for w, n in sorted((r.w, r.n) for r in shapes):
        own = rows.where(F.size("v") == w)
        top = own.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
        reach = asked.where(F.size("v") == w).agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
        bound = int(top) * int(reach) * w + 1
        if bound >= 1 << 62:
            raise ValueError("scores exceed 62 bits")
        passes = -(-n * (w + 1 + BINS) * 8 // PASS_BYTES)
        for part in range(passes):
            some = asked.where(F.size("v") == w)
            some = some.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == part) if passes > 1 else some
            out = out.unionByName(_search(spark, own, some.distinct().toArrow(), k, bound, w))
    return out


def _search(spark: SparkSession, rows: DataFrame, asked: pa.Table, k: int, bound: int, width: int) -> DataFrame:
    """asked and its histograms fit PASS_BYTES about."""
    asked = asked.sort_by("id")
    qids, queries = _matrix(asked.combine_chunks().to_batches()[0], width) if asked.num_rows else (np.zeros(0, np.int64), np.zeros((0, width)))
    low, high, need = np.full(len(qids), -bound), np.full(len(qids), bound + 1), np.full(len(qids), k)
    exact = bound < 1 << 53
    sent = spark.sparkContext.broadcast((qids, queries))

    def blocks(batches: Iterator[pa.RecordBatch]):
        qids, queries = sent.value
        step = max(1, CELLS // max(1, len(qids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                ids, found = _matrix(batch.slice(at, step), width)
                scores = _scores(queries, found, exact)
                yield qids, ids, scores, ids[None, :] != qids[:, None]

    while len(qids) and (high - low).max() > 1:
        each = np.maximum(1, -(-(high - low) // BINS))

        def count(batches: Iterator[pa.RecordBatch], low=low, high=high, each=each):
            total = np.zeros((len(low), BINS), np.int64)
            for _, _, scores, other in blocks(batches):
                inside = other & (scores >= low[:, None]) & (scores < high[:, None])
                slot = (scores - low[:, None]) // each[:, None] + np.arange(len(low))[:, None] * BINS
                total += np.bincount(slot[inside], minlength=total.size).reshape(total.shape)
            q, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[q, b])], ["q", "b", "n"])

        sums = rows.mapInArrow(count, "q int, b int, n long").groupBy("q", "b").agg(F.sum("n").alias("n")).toArrow()
        hist = np.zeros((len(qids), BINS), np.int64)
        hist[sums["q"].to_numpy(), sums["b"].to_numpy()] = sums["n"].to_numpy()
        above = hist[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows in this bin or a higher one
        fits = above >= need[:, None]
        have = fits.any(axis=1)
        bin_ = np.where(have, BINS - 1 - fits[:, ::-1].argmax(axis=1), 0)
        over = above[np.arange(len(qids)), bin_] - hist[np.arange(len(qids)), bin_]
        need = np.where(have, need - over, need)
        new = low + bin_ * each
        high = np.where(have, np.minimum(high, new + each), low + 1)  # too few rows: all of them are wanted
        low = np.where(have, new, low)
    cut = low

    def chosen(batches: Iterator[pa.RecordBatch]):
        for qids, ids, scores, other in blocks(batches):
            order = np.argsort(ids, kind="stable")
            ids, scores, other = ids[order], scores[:, order], other[:, order]
            keep = other & (scores >= cut[:, None])
            ties = keep & (scores == cut[:, None])
            keep &= ~ties | (ties.cumsum(axis=1) <= k)
            q, r = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids[r]), pa.array(scores[q, r])], ["query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = rows.mapInArrow(chosen, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


ORACLE_SQL = {
    "op10_exact_top_k": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
