"""The queries against their contracts done plainly, on the smallest tables; mixing against a plain version; every stage on odd tables."""

import hashlib
import math
import os
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_dedup import bytes_brute, links_brute, words_brute

import corpus_pipeline
from blockframe.llm import mixing
from blockframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def rows(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def sha(data):
    return hashlib.sha256(data).hexdigest()


@needs_tables
def test_op1(spark, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, SF).collect()}
    assert got == {i: (n, gone, sha(kept.encode())) for i, (n, gone, kept) in words_brute(rows).items()}


@needs_tables
def test_op3(spark, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op3_suffix_dedup"](spark, SF).collect()}
    assert got == {i: (n, gone, spans, sha(kept)) for i, (n, gone, spans, kept) in bytes_brute(rows).items()}


@needs_tables
def test_op4(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_jaccard_join"](spark, SF).collect()}
    assert got == links_brute(rows)


@needs_tables
def test_op6(spark, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_token_files"](spark, SF).collect()} == want


# -- mixing -----------------------------------------------------------------------------------------------------


def plain_quotas(sizes, want, block, taken):
    """Seats one by one to the highest quotient, until what they take reaches want; the nearer of that and one seat less."""
    counts = [math.ceil(n / block) for n in sizes]
    quota, before = [0] * len(sizes), None
    while taken(quota) < want and any(q < 2 * c for q, c in zip(quota, counts, strict=True)):
        before = list(quota)
        best = max((k for k in range(len(sizes)) if quota[k] < 2 * counts[k]), key=lambda k: (sizes[k] / (2 * quota[k] + 1), -k))
        quota[best] += 1
    return quota if before is None or abs(taken(quota) - want) <= abs(taken(before) - want) else before


def mix_brute(rows, each):
    """rows: id, source, size and the two hashes that deal and order rows. id, taken for each row."""
    sources = sorted({s for _, s, *_ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, s, n, *_ in rows if s == source) for source in sources]
    want, out = mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sources))]), {}
    for source, target in zip(sources, want, strict=True):
        own = [r for r in rows if r[1] == source]
        n_shards = math.ceil(len(own) / each)
        shards = defaultdict(list)
        for i, _, n, deal, order in own:
            shards[deal % n_shards if n_shards > 1 else 0].append((order, i, n))
        lines, picks, keys = [], [], sorted(shards)
        for k in keys:
            words = [i for _, i, n in sorted(shards[k]) for _ in range(n)]
            lines.append([words[a : a + mixing.BLOCK] for a in range(0, len(words), mixing.BLOCK)])
            step, shift = mixing._lots(mixing.SEED, source, k, len(lines[-1]))
            picks.append(sorted(range(len(lines[-1])), key=lambda b, step=step, shift=shift, n=len(lines[-1]): (b * step + shift) % n))

        def chosen(quota, lines=lines, picks=picks):
            for line, pick, q in zip(lines, picks, quota, strict=True):
                for turn in range(q):
                    yield line[pick[turn % len(line)]]

        quota = plain_quotas([sum(map(len, line)) for line in lines], target, mixing.BLOCK, lambda q, chosen=chosen: sum(map(len, chosen(q))))
        for i, *_ in own:
            out[i] = 0
        for block in chosen(quota):
            for i in block:
                out[i] += 1
    return out


@pytest.mark.parametrize("each", (7, 1000))
def test_mix_against_a_plain_version(spark, monkeypatch, each):
    monkeypatch.setattr(mixing, "SHARD_ROWS", each)
    dice = random.Random(each)
    docs = spark.createDataFrame([(i, "w " * dice.randrange(0, 150), dice.choice(["a", "a", "a", "b", "é", None])) for i in range(90)], "doc_id long, text string, source string")
    hashed = docs.select("doc_id", "source", (F.length("text") / 2).cast("long"), F.xxhash64(F.lit(mixing.SEED), "doc_id"), F.xxhash64(F.lit(mixing.SEED + 1), "doc_id"))
    want = mix_brute([tuple(r) for r in hashed.collect()], each)
    assert {r.id: r.taken for r in mixing.mix(docs).collect()} == want


# -- stages -----------------------------------------------------------------------------------------------------

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _lang_pred string, _lost_id long, component long, _copy int, Keep string, ids string, n int"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, name, stage):
    """Nulls in every column, empty and very long texts, ties, repeated rows, no rows, columns of names used inside."""
    last = name == corpus_pipeline.STAGES[-1][0]
    empty = spark.createDataFrame([], SCHEMA)
    got = stage(spark, empty, SF)
    assert got.count() == 0 and (last or got.columns == empty.columns)
    long = "the quick house and the garden " * 40_000
    texts = ["the house and the garden of the king", "das haus und der garten des königs", "", " ", None, "...", "A.", long, "the house and the garden of the king", "THE house and the garden of the KING"]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", None][i % 2], i, i / 2, f"p{i}", -i, i, i, f"k{i}", "x", i) for i, t in enumerate(texts)]
    rows += [rows[0], rows[1], (None, "null id text of its own", "en", "a", *rows[0][4:]), (50, "one row of nulls", *[None] * 11)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = stage(spark, docs, SF).collect()
    if last:
        assert len(got) == len(rows) and all((r.ids is None) == (r.round_trip is None) for r in got)
        assert {r.doc_id for r in got if r.ids is None} == {4}
        return
    assert stage(spark, docs, SF).columns == docs.columns
    given = {tuple(r) for r in rows}
    assert {tuple(r) for r in got} <= given  # columns come through unchanged
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in got)
    if name == "language_id":
        assert ids == [-1, 0, 0, 1, 1, 6, 7, 8, 9, 50]
    elif name == "exact_dedup":
        assert ids == [-1, 1, 1, 3, 4, 5, 6, 7, 9, 50]  # 2 and 4 are empty both; equal rows of one id stay together
    elif name == "jaccard_join":
        assert ids == [-1, 0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 50]
    else:
        assert set(ids) >= {2, 3, 4} and len(got) >= 3
