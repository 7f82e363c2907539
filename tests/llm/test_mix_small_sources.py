"""A source gets its target whatever the other sources' sizes and its documents' lengths."""

import pytest

from blockframe.llm import mixing


@pytest.mark.parametrize("words", (30, 10, 1))
def test_small_source_beside_a_hot_one(spark, words, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    rows = [(i, "w " * words, "a") for i in range(500)] + [(1000 + i, "w " * 7, "b") for i in range(8000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert all(0 <= r.taken <= 2 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= mixing.BLOCK, source


def test_quotas():
    lots = [mixing._lots(7, "s", k, 2) for k in range(300)]
    sizes = [65 + k % 60 for k in range(300)]
    for part in (0.1, 0.5, 0.9, 1.0, 1.7, 2.0):
        got, taken = mixing.quotas(sizes, part * sum(sizes), 64, 2, lots), 0
        for n, q, (step, shift) in zip(sizes, got, lots, strict=True):
            assert 0 <= q <= 4
            taken += sum(q // 2 * x + (x if (b * step + shift) % 2 < q % 2 else 0) for b, x in enumerate((64, n - 64)))
        assert abs(taken - part * sum(sizes)) <= 32
    assert mixing.quotas([0, 0], 0.0, 64, 2, [(1, 0)] * 2) == [0, 0]
