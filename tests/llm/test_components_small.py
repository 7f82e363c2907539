"""Few links are settled in few tasks, however many partitions a shuffle has; many links by rounds, with the same result."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from blockframe.llm import components, jaccard_join


def brute(links):
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {i: find(i) for i in list(root)}
    n = Counter(found.values())
    return {i: (c, n[c]) for i, c in found.items()}


@pytest.fixture(scope="module")
def links():
    rng = np.random.default_rng(4)
    path = rng.permutation(np.arange(1000, 1200)).tolist()
    out = list(zip(path[:-1], path[1:], strict=True)) + rng.integers(-150, 150, (120, 2)).tolist() + [(500, i) for i in range(501, 560)] + [(7, 7), (9999, 9999)]
    return [(int(a), int(b)) for a, b in out]


def test_tasks_of_few_links(spark, links):
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    frame = spark.createDataFrame([*links, (None, 5)], "a long, b long").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sc.setJobGroup("few links", "")
    try:
        got = {r.node: (r.component, r.n) for r in components.components(frame).collect()}
    finally:
        sc.setJobGroup("", "")
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    known = sc.statusTracker()
    stages = {s for j in known.getJobIdsForGroup("few links") for s in known.getJobInfo(j).stageIds}
    tasks = sum(info.numTasks for s in stages if (info := known.getStageInfo(s)))
    assert got == brute(links) and 0 < tasks < 60


def test_rounds(spark, links, monkeypatch):
    """With no gathering at all, and with gathering after some rounds."""
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    for most in (0, 230):
        monkeypatch.setattr(components, "MOST_LINKS", most)
        assert {r.node: (r.component, r.n) for r in components.components(frame).collect()} == brute(links)


def test_tasks_hold_few_links(links, monkeypatch):
    batches = lambda: (pa.RecordBatch.from_arrays([pa.array([x[k] for x in links[i : i + 40]], pa.int64()) for k in (0, 1)], ["a", "b"]) for i in range(0, len(links), 40))
    for most in (1, 50, 1000):
        monkeypatch.setattr(components, "MOST_LINKS", most)
        out = [(a, b) for x in components._contract(batches()) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]
        assert brute(out) == brute(links) and all(a > b for a, b in out)
    assert len(out) == len(brute(links)) - len({c for c, _ in brute(links).values()})
    nodes, least, n = components.roots(*np.array([x for x in links if x[0] != x[1]]).T)
    assert dict(zip(nodes.tolist(), zip(least.tolist(), n.tolist(), strict=True), strict=True)) == brute(links)


def test_one_worker_a_task(docs, monkeypatch):
    """The links that components() reads need no Python worker beside its own."""
    plans, run = [], jaccard_join.components

    def seen(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return run(frame)

    monkeypatch.setattr(jaccard_join, "components", seen)
    assert jaccard_join.near_duplicates(docs).count() == docs.count()
    assert len(plans) == 3 and not any("InArrow" in p for p in plans)
