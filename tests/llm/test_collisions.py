"""Strings that fingerprints modulo 2^64 can't tell apart."""

import numpy as np
import pytest
from test_dedup import SCHEMA, bytes_brute, links_brute, words_brute

from blockframe.llm import jaccard_join, poly, substring_dedup, suffix_sort, token_files


def thue_morse(n, letters="ab"):
    out = np.zeros(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, 1 - out])
    return "".join(letters[i] for i in out), "".join(letters[1 - i] for i in out)


@pytest.mark.parametrize("n", (1024, 4096))
def test_prints(n):
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse(n))
    both, at = np.concatenate([a, b]), np.array([0, n])
    assert len(set(poly.Rolling(both).of(at, at + n).tolist())) == 1  # else this test shows nothing
    assert len(set(poly.Prints(both).of(at, at + n).tolist())) == 2
    words = poly.mix(both.astype(np.uint64))
    assert len(set(poly.Prints(words).of(at, at + n).tolist())) == 2


def test_prints_depend_on_content_alone():
    rng = np.random.default_rng(0)
    for values in (rng.integers(0, 256, 5000).astype(np.uint8), rng.integers(0, 1 << 63, 5000).astype(np.uint64)):
        line = np.concatenate([values[100:900], values, values[100:900]])
        got = poly.Prints(line).of(np.array([0, 900, 5800]), np.array([800, 1700, 6600]))
        assert len(set(got.tolist())) == 1
        every = poly.Prints(values).of(np.arange(4000), np.arange(4000) + 1000)
        assert len(set(every.tolist())) == 4000


def _texts(n):
    a, b = thue_morse(n)
    rng = np.random.default_rng(n)
    prose = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 10**9, k))
    own = [" ".join([prose(9), x, prose(10)]) for x in (a, b)]
    same = prose(9), prose(10)
    return list(enumerate([a, b, *own, f"{same[0]} {a} {same[1]}", f"{same[0]} {b} {same[1]}", f"{a} {prose(5)} {a}", f"{b} {b}", " ".join([a, b] * 12), " ".join([b, a] * 12), thue_morse(n, "ba")[0] + "c"]))


@pytest.mark.parametrize("n", (1024, 4096))
def test_operators(spark, n):
    rows = _texts(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.repeated_words(docs).collect()} == words_brute(rows)
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_sort.repeated_bytes(docs).collect()} == bytes_brute(rows)
    assert {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()} == links_brute(rows)


@pytest.mark.parametrize("n", (1024, 4096))
def test_token_ids(n):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, texts = Tokenizer.from_file(path), [t for _, t in _texts(n)]
    ids, at = token_files.encoder(path).texts([t.encode() for t in texts])
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == own.encode(t, add_special_tokens=False).ids
