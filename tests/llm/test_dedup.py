"""Dedup operators against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockframe.llm import components, exact_dedup, jaccard_join, repeats, substring_dedup, suffix_sort

SCHEMA = "doc_id long, text string"


def words_brute(rows, size=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - size + 1):
            k = tuple(w[j : j + size])
            gone[j : j + size] |= k in seen
            seen.add(k)
        out[i] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def bytes_brute(rows, size=400):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[j : j + size] for j in range(len(b) - size + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - size + 1):
            if count[b[j : j + size]] > 1:
                gone[j : j + size] = True
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def links_brute(rows, percent=90):
    sets = {}
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for i, t in rows:
        w = (t or "").encode().translate(lower).split()
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_repeated_words(docs, corpus):
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.repeated_words(docs).collect()}
    assert got == words_brute(corpus)


def test_repeated_bytes(docs, corpus):
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_sort.repeated_bytes(docs).collect()}
    assert got == bytes_brute(corpus)


def test_repeated_bytes_window_by_window(docs, corpus, monkeypatch):
    """Names with many different items take the path without contexts."""
    monkeypatch.setattr(repeats, "WIDE", 1)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_sort.repeated_bytes(docs).collect()}
    assert got == bytes_brute(corpus)


@pytest.mark.parametrize("hot", (0, 1, 3))
def test_hot_names(docs, corpus, hot, monkeypatch):
    """Names with many different items in a task are compared window by window, everywhere."""
    monkeypatch.setattr(repeats, "HOT", hot)
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.repeated_words(docs).collect()}
    assert got == words_brute(corpus)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_sort.repeated_bytes(docs).collect()}
    assert got == bytes_brute(corpus)


def test_many_flushes(docs, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "FLUSH", 10)
    monkeypatch.setattr("blockframe.llm.segments.CHUNK_BYTES", 1)
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.repeated_words(docs).collect()}
    assert got == words_brute(corpus)


@pytest.mark.parametrize("run", (substring_dedup.repeated_words, suffix_sort.repeated_bytes))
def test_null_ids_repeated_rows_and_nothing(spark, run):
    text = " ".join(f"word{i}" for i in range(120))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], SCHEMA)
    got = sorted((r.id is None, r.id or 0, r.n_removed) for r in run(rows).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 0), (False, 3, 0), (True, 0, 0)]  # equal rows are one document
    other = spark.createDataFrame([(1, text), (1, text + " more"), (0, None)], SCHEMA)  # one id, two texts
    assert sum(r.n_removed > 0 for r in run(other).collect()) == (1 if run is substring_dedup.repeated_words else 2)
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_shallow_sort():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 60))) for _ in range(300)] + [b"ab" * 200 + bytes([c]) for c in range(40)] + [b"", b"", b"same" * 30, b"same" * 30]
    for shallow in (0, 8, 32, 1000):
        order = suffix_sort.deep_shallow_sort(strings, shallow)
        assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)


def test_match_group():
    rng = np.random.default_rng(4)
    base = bytes(rng.integers(97, 123, 200))
    texts, before = [], []
    for _ in range(12):
        a, b = rng.integers(60, 100), rng.integers(0, 40)
        t = bytearray(base[a : 200 - b])
        for _ in range(rng.integers(0, 3)):
            t[rng.integers(0, len(t))] = 33
        texts.append(bytes(t))
        before.append(100 - a)
    size = 50
    count = np.array([min(len(t) - size, b) + 1 for t, b in zip(texts, before, strict=True)])
    got = suffix_sort.match_group(texts, np.array(before), count, size)
    for i, t in enumerate(texts):
        want = {j for j in range(count[i]) if any(o != i and 0 <= (k := j + before[o] - before[i]) < count[o] and u[k : k + size] == t[j : j + size] for o, u in enumerate(texts))}
        assert {j for a, b in got[i] for j in range(max(0, a), min(b, count[i]))} == want


def test_exact_groups(docs, corpus):
    groups = defaultdict(list)
    for i, t in corpus:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    for everything in (True, False):
        rows = exact_dedup.exact_groups(docs, digest_all=everything).collect()
        assert {r.id: (r.keep_id, r.group_size, r.kept) for r in rows} == want
        for r in rows:
            text = next(k for k, g in groups.items() if r.id in g)
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest() or not everything and r.text_sha256 is None and r.group_size == 1


def test_exact_groups_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "A"), (1, "a"), (None, "b"), (None, "b"), (2, "É"), (3, "é")], SCHEMA)
    got = sorted((str(r.id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_groups(rows, digest_all=True).collect())
    assert got == sorted([("None", "1", 3, False), ("1", "1", 3, True), ("1", "1", 3, True), ("None", "None", 2, True), ("None", "None", 2, True), ("2", "2", 1, True), ("3", "3", 1, True)])
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_jaccard_join(docs, corpus):
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == links_brute(corpus)


def test_jaccard_join_in_blocks(docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == links_brute(corpus)


def test_jaccard_join_odd_rows(spark):
    rows = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (4, "A b C d"), (None, "a b c d"), (1, None), (2, " "), (3, "a b")], SCHEMA)
    got = sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in jaccard_join.near_duplicates(rows).collect())
    assert got == sorted([("5", 2, "4"), ("5", 2, "4"), ("4", 2, "4"), ("None", 2, "None"), ("1", 0, "1"), ("2", 0, "2"), ("3", 1, "3")])
    assert jaccard_join.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_lose_no_link():
    rng = np.random.default_rng(0)
    for n in [*range(1, 40), 100, 333, 1000]:
        for _ in range(20):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            most = int(2 * n * 10 / 9 // 19)
            out, new = rng.integers(0, most + 1, 2)
            b = np.concatenate([a[min(out, n - 1) :], rng.integers(0, 1 << 63, new, dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            sign, whose = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            if jaccard_join.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                assert set(sign[whose == 0].tolist()) & set(sign[whose == 1].tolist()), (n, len(a), len(b))


def test_count_tree_bounds():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 400))) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: len(s) - len(s) // 30], rng.choice(pool, 1)])) for s in sets]
    vectors, sizes = jaccard_join.count_vectors(sets), np.array([len(s) for s in sets])
    tree = jaccard_join.CountTree(vectors, sizes)
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if jaccard_join.linked(len(np.intersect1d(s, t)), len(s), len(t))}
        assert want <= set(tree.search(vectors[i], sizes[i]).tolist())


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(5, 5)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


def test_stages_keep_columns(docs, corpus):
    spark = docs.sparkSession
    kept = exact_dedup.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == exact_dedup.exact_groups(docs).where("kept").count()
    kept = jaccard_join.one_of_each(spark, docs, "")
    want = {i for i, (_, c) in links_brute(corpus).items() if i == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select(F.col("doc_id")).collect()} == want
