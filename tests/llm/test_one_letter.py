"""Texts with a single letter have a language."""

from blockframe.llm import langid


def test_one_letter(spark):
    rows = [(i, "the house and the garden of the king", "en") for i in range(20)] + [(100 + i, "das haus und der garten des königs", "de") for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["A.", "a", " z 7", "é", "ab", "1 2", "", None, "..."]
    langs, scores = langid.classify(model, texts)
    assert all(x in ("de", "en") for x in langs[:5]) and langs[5:] == [langid.UNDETERMINED] * 4
    assert all(0 <= s <= 1 for s in scores) and scores[5:] == [0.0] * 4
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.speaks(spark, docs, "").collect()}
    assert kept == {*range(5)} | {r[0] for r in rows}
