"""Documents that share passages and do not link cost no shuffle of their texts or sets."""

import random

import numpy as np
import pytest
from test_near_copies import brute

from blockframe.llm import common, jaccard_join


@pytest.fixture(scope="module")
def passages():
    """60 documents that share half of their words with others, and three near copies of one of them."""
    dice = random.Random(3)
    shared = [[f"p{k}x{i}" for i in range(60)] for k in range(3)]
    texts = [[*shared[i % 3], *(f"d{i}w{j}" for j in range(40 + i))] for i in range(60)]
    for k in range(3):
        copy = list(texts[7])
        copy[dice.randrange(60, 100)] = f"new{k}"
        texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", (jaccard_join.VECTOR_BLOCK, 5))
def test_sets_of_those_that_may_link(spark, passages, block, monkeypatch):
    """Without a table of common shingles all meet; bands and blocks of large cells lose no link."""
    monkeypatch.setattr(jaccard_join, "MAX_COMMON", 0)
    monkeypatch.setattr(jaccard_join, "VECTOR_BLOCK", block)
    made, run = [], jaccard_join.checkpointed

    def seen(df):
        out = run(df)
        if out.columns == ["doc", "component", "n", "data"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "checkpointed", seen)
    docs = spark.createDataFrame(passages, "doc_id long, text string").repartition(4)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, percent=80, size=5).collect()}
    assert got == brute(passages, 5, 80) and {i for i, (_, c) in got.items() if i != c} == {60, 61, 62}
    assert len(made) == 1 and made[0] < 10


def test_fine_vectors_lose_no_link():
    rng = np.random.default_rng(2)
    for percent in (50, 80, 90):
        sets = []
        for n in (1, 2, 30, 127, 129, 300, 1100):
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            sets += [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k // 2, dtype=np.uint64)])) for k in (0, n // 20, n // 8, n // 3)]
        sets += [np.arange(400, dtype=np.uint64), np.arange(380, dtype=np.uint64)]  # all in one coordinate
        vectors = jaccard_join.fine_vectors(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
        root = list(range(len(sets)))
        for i, j in jaccard_join.may_link(np.array([len(s) for s in sets]), vectors, percent):
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if jaccard_join.linked(len(np.intersect1d(a, b)), len(a), len(b), percent):
                    assert root[i] == root[j]
        assert percent < 80 or len(set(root)) >= 7


def test_sizes_part_the_documents_of_a_signature():
    sign, doc, size = np.full(5, 9, np.uint64), np.array([5, 4, 3, 2, 1]), np.array([100, 120, 1000, 90, 900])
    star, least, low, high, pairs = jaccard_join.stars(sign, doc, size, size, 80)
    assert (least.tolist(), low.tolist(), high.tolist(), pairs.tolist()) == ([2, 1], [90, 900], [120, 1000], [[1, 3], [2, 4], [2, 5]])
    assert star.tolist() == [9, 9] and len(jaccard_join.stars(*(x[:0] for x in (sign, doc, size, size)), 80)[0]) == 0


def test_few_texts_meet_the_ids(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("if(id = 7, null, id) AS `doc.id`", "id AS _bits_held").withColumnRenamed("doc.id", "doc_id")
    some, others = common.may_be_in(rows, "doc_id", spark.range(0, 5000, 500).toDF("lost"))
    assert {r.doc_id for r in some.collect()} >= set(range(0, 5000, 500)) and some.count() < 30
    assert some.count() + others.count() == 5000 and others.columns == rows.columns
