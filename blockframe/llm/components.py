"""Connected components of links; only a bounded number of links is ever gathered in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from blockframe.llm.common import checkpointed, hand_back, join_dealt

#: Links that a task holds at a time. When no more are left in all, one task ends the work; before that, rounds of Spark's shuffle bring them down.
MOST_LINKS = 1 << 18


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the links (a, b), the smallest node reachable from each, and how many nodes reach that.

    In each round all roots with a smaller neighbouring root hook to the least one; two rounds at least halve the roots.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (open_ := label[x] != label[y]).any():
        x, y = x[open_], y[open_]
        np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label], np.bincount(label, minlength=len(nodes))[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a task's links (a, b) fewer ones that connect the same nodes: each node's with the smallest that the links held at a time reach."""

    def flush() -> tuple[np.ndarray, np.ndarray]:
        nodes, least, _ = roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return nodes[nodes != least], least[nodes != least]

    held, n = [], 0
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        n += batch.num_rows
        if n > MOST_LINKS:
            held = [flush()]
            n = len(held[0][0])
            if n > MOST_LINKS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held[0]], ["a", "b"])
                held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flush()], ["a", "b"])
    hand_back()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all links, in one task: node, component, n."""
    held = [tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns) for batch in batches]
    if held:
        found = roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "component", "n"])
    hand_back()


def _mark(edges: DataFrame) -> Row:
    """Number and a hash of the links."""
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b (long). Returns node, component (the smallest node reachable), n (the component's nodes) for every node that has a link to another.

    Each task first leaves of its links only what connects the same nodes. While more than MOST_LINKS are left, large-star and small-star steps (Kiveris and
    others, "Connected Components in MapReduce and Beyond") alternate, at most until the links no longer change: a logarithmic number of rounds. A step joins each
    node's least neighbour with its links; neighbours are never listed, and nodes with a large part of all links, a bounded number, are broadcast to them.
    """
    edges = checkpointed(links.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long"))
    if (n := edges.count()) > MOST_LINKS:
        edges = checkpointed(edges.distinct())
        mark = _mark(edges)
        while (n := mark.n) > MOST_LINKS:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
            large = checkpointed(join_dealt(both.where("b > a"), least, ["a"], mark.n).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
            least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
            small = join_dealt(large, least, ["a"], mark.n)
            edges = checkpointed(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
            before, mark = mark, _mark(edges)
            if mark == before:
                break
    if n <= MOST_LINKS:
        return checkpointed(edges.repartition(1).mapInArrow(_settle, "node long, component long, n long"))
    sizes = checkpointed(edges.groupBy("b").agg((F.count("*") + 1).alias("n")))
    own = edges.select(F.col("a").alias("node"), "b").unionByName(sizes.select(F.col("b").alias("node"), "b"))
    return checkpointed(join_dealt(own, sizes, ["b"], n).select("node", F.col("b").alias("component"), "n"))
