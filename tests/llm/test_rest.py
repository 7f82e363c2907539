"""URL filters, mixing, top-k search, the pipeline."""

import os
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from blockframe.llm import mixing, topk, url_filter
from blockframe.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


URLS = [
    None, "", "no scheme/en/", "http://", "https://A.EXAMPLE.com/en/7x", "http://com/en/", "http://xcom/en/", "x://example.com/en/8?u=/en/7", "http://example.net/de/81#a", "ftp://q.example.net/de/7", "http://org?/es/",
    "http://a.b.org/es/1://c.com/en/", "http://É.org/es/\nnew", "http://example.com./en/", "http://..com/en/", "http://a.net/de/" + "z" * 5000, "http://example.com/en", "HTTP://example.COM/EN/",
]


def test_url_rules(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, keys string")
    more = [("block", f"h{i}.org", f"/p{i}/") for i in range(60)] + [("allow", "b.org", "")]
    for rules in (url_filter.RULES, url_filter.RULES + more, []):
        got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
        assert got == {i: judge(u, rules) for i, u, _, _ in rows}
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.RULES).count() == 0


def test_cascade_is_exact(spark):
    listed = spark.range(300).selectExpr("concat('k', id) AS key")
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    made = url_filter.build_cascade(listed, universe)
    assert len(made.levels) > 1
    assert universe.where(made.contains(universe.key)).count() == 300
    assert universe.where(made.contains(universe.key)).join(listed, "key", "left_anti").count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([10, 1000], [3, 1]) == pytest.approx([20, 1495])
    assert mixing.targets([0, 50], [1, 1]) == pytest.approx([0, 75]) and mixing.targets([], []) == []


def test_sainte_lague():
    rng = np.random.default_rng(0)
    for _ in range(50):
        votes = rng.integers(1, 1000, rng.integers(1, 9)).tolist()
        seats = int(rng.integers(0, 60))
        got = [0] * len(votes)
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
            got[best] += 1
        assert sum(made := mixing.sainte_lague(votes, seats, [10**9] * len(votes))) == seats
        assert all(abs(votes[i] / (2 * a + 1) - votes[i] / (2 * b + 1)) < 1e-9 or a == b for i, (a, b) in enumerate(zip(made, got, strict=True)))
    assert mixing.sainte_lague([5, 5], 10, [2, 3]) == [2, 3] and mixing.sainte_lague([0, 0], 4, [0, 0]) == [0, 0]


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 900))), [None, "a", "b", "é"][i % 4], "z") for i in range(400)] + [(500, None, "a", "z"), (501, "w " * 40_000, "b", "z"), (None, "w w", "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
        assert r.source_size == sum(len((t or "").split()) for _, t, s, _ in rows if s == r.source)
    want = dict(zip(["a", "b", "é", None], mixing.targets([size[s] for s in ["a", "b", "é", None]], [3, 1, 2, 3]), strict=True))
    assert target == pytest.approx(want)
    for s in want:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_stage(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 * 50), "ab"[i % 2], i) for i in range(200)], "doc_id long, text string, source string, _id int")
    got = mixing.mixed(spark, docs, "")
    assert got.columns == docs.columns
    n = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    plan = {r.id: (r["size"], r.taken) for r in mixing.mix(docs).collect()}
    for i, (size, taken) in plan.items():
        assert n.get(i, 0) in ({1} if not size else {taken // size, -(-taken // size)})


def top_brute(rows, asked, k):
    ints = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in asked:
        if q in ints:
            best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("few", (False, True))
def test_top_k(spark, few, monkeypatch):
    monkeypatch.setattr(topk, "PASS_BYTES", 100_000 if few else topk.PASS_BYTES)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4))]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(300, None), (301, [1.0, None, 2.0, 3.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (None, [1.0] * 4), (304, []), (306, [1.0, 2.0]), (308, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 2 = 0"), 5).collect())
    assert got == top_brute(rows, [i for i, _ in rows if i is not None and i % 2 == 0], 5)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = lambda df: sorted(tuple("" if v is None or v != v else str(v) for v in row) for row in df[columns].itertuples(index=False))
    assert as_rows(got) == as_rows(want)


@needs_tables
def test_pipeline(spark):
    """run() against its stages done plainly, from the same language model, mix and tokenizer."""
    from test_near_copies import brute

    from blockframe.llm import langid, pieces

    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = [d for d in docs if d["text"] is not None and any(c.isalpha() for c in d["text"])]
    last = {}
    for d in docs:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"])
        last[key] = max(last.get(key, -1), d["doc_id"])
    docs = [d for d in docs if d["doc_id"] in set(last.values())]
    links = brute([(d["doc_id"], d["text"]) for d in docs], 5, 80)
    docs = [d for d in docs if links[d["doc_id"]][1] == d["doc_id"]]
    plan = {r.id: r for r in mixing.mix(spark.createDataFrame(docs, spark.read.parquet(f"{SF}/documents.parquet").schema)).collect()}
    own = pieces.vocabulary(pieces.model_path())
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id].append(r)
    assert set(got) <= {d["doc_id"] for d in docs} and langid.UNDETERMINED not in got
    total = 0
    for d in docs:
        r = plan[d["doc_id"]]
        assert len(got[d["doc_id"]]) in {r.taken // r["size"], -(-r.taken // r["size"])}
        total += len(got[d["doc_id"]]) * r["size"]
        for row in got[d["doc_id"]]:
            assert row.round_trip and row.ids == own.encode([d["text"].encode()])[0].tolist()
    assert abs(total / sum(r.taken for r in plan.values()) - 1) < 0.2


def test_stages():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mix_sources", "sentencepiece"]
    assert all(any(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11))
