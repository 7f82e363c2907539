"""Sizes at which a cap would show: many languages, many rules, long hosts, many sources."""

import time

import numpy as np
import pytest

from blockframe.llm import langid, mixing, url_filter


def test_two_hundred_languages(spark):
    rng = np.random.default_rng(0)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:03}": ["".join(rng.choice(list(letters), 6)) for _ in range(12)] for i in range(200)}
    prose = lambda lang: " ".join(rng.choice(words[lang], 20))
    rows = [(i * 1000 + j, prose(lang), lang) for i, lang in enumerate(words) for j in range(8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert model.langs == sorted(words) and model.cells.shape[0] == 7
    langs, scores = langid.classify(model, [prose(lang) for lang in words] + ["", None])
    assert langs == [*words, "und", "und"] and min(scores[:-2]) > 0.5


def test_every_gram_of_the_sample_counts(spark):
    """No n-gram is dropped for being rare, and the filter grows with them."""
    rng = np.random.default_rng(1)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(400))
    rows = [(i, text(), "xx") for i in range(40)] + [(100, "ein kurzer satz", "yy")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    grams = np.unique(langid._grams([t for _, t, lang in rows if lang == "xx"])[0])
    assert len(grams) > 30_000 and model.cells.shape[1] >= 4 * len(grams)
    assert ((langid.masks(model, grams)[0] & 1) == 1).mean() > 0.99  # all but those that are far more frequent in yy


def test_more_rules_than_a_cascade_takes(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "CASCADE_RULES", 50)
    rules = [("block", f"h{i}.org", f"/p{i % 7}") for i in range(90)] + [("allow", f"a.h{i}.org", "/p1/x") for i in range(0, 90, 3)] + [("block", f"h{i}.org", f"/p{i % 7}") for i in range(9)]
    urls = [f"http://{'a.' * (i % 3)}h{i % 95}.org/p{i % 8}/x{i}" for i in range(400)] + [None, "", "http://h1.org/p1", "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    from test_rest import judge

    want = {i: judge(u, rules) for i, u in enumerate(urls)}
    frame = spark.createDataFrame([*rules, ("block", None, "/"), (None, "x", "y")], "action string, host string, path string")
    assert {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, frame).collect()} == want


@pytest.mark.parametrize("labels", (2_000, 20_000))
def test_long_hosts(spark, labels):
    host = "a." * labels
    pages = spark.createDataFrame([(1, f"http://{host}com/en/x"), (2, f"http://{host}example.net/de/8" + "/y" * 9000), (3, "http://" + "." * labels + "/en/")], "page_id long, url string")
    began = time.time()
    got = {r.id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.RULES).collect()}
    assert got == {1: ("com/en/", "block"), 2: ("example.net/de/8", "block"), 3: (None, "allow")} and time.time() - began < 60


def test_many_sources(spark, monkeypatch):
    """More sources than shards may be planned; a hot one still has its share of them."""
    monkeypatch.setattr(mixing, "MAX_SHARDS", 50)
    monkeypatch.setattr(mixing, "SHARD_ROWS", 10)
    docs = spark.range(12_000).selectExpr("id AS doc_id", "repeat('w ', 100) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 1000)) AS source")
    got = mixing.mix(docs).toPandas()
    assert len(got) == 12_000 and (got.taken >= 0).all() and (got.taken <= 2 * got["size"]).all()
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(sums.taken - sums.target) <= mixing.BLOCK).all()


def test_hundred_thousand_targets():
    sizes = list(range(1, 100_001))
    began = time.time()
    out = mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))])
    assert sum(out) == pytest.approx(1.5 * sum(sizes)) and time.time() - began < 30
