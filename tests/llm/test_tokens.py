"""Piece encoding, token files, language ID."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockframe.llm import langid, pieces, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "  two  spaces ", "line\n\nline\t.", "don't 's it's 12ab,c's l'été", "é×÷ ×. naïve", "\u3000\u00a0 x\x85y\x1cz", "日本語 text", "\U0001f600!", "a" * 300, '"' * 90 + "b c" * 50, "<|endoftext|> in a text", "\u2581 mark", "tail \r\n"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(pieces.model_path())


def brute(vocabulary, text):
    """Best score over all ways to cut a text: straightforward dynamic programming over pieces in a dictionary."""
    data = text.replace(" ", "\u2581")
    known = {p.decode(): s for p, s, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True) if k == pieces.NORMAL}
    best = [0.0] + [-np.inf] * len(data)
    for end in range(1, len(data) + 1):
        for start in range(max(0, end - 20), end):
            part = data[start:end]
            score = known.get(part, vocabulary.unknown if len(part) == 1 else -np.inf)
            best[end] = max(best[end], best[start] + score)
    return best[-1]


def score(vocabulary, ids):
    kinds = vocabulary.kinds[ids]
    text = vocabulary.decode(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace")
    unknown = sum(1 for c in text if c.encode() not in vocabulary._normal and c != " ")
    return vocabulary.scores[ids[kinds == pieces.NORMAL]].sum() + unknown * vocabulary.unknown


def test_best_path(vocabulary, corpus):
    for text in [t[:400] for _, t in corpus if t][::4] + ["Plain prose, with marks; and Numbers 1234.", "unbelievableness  twice", "ééé 日本 x"]:
        ids, _ = vocabulary.encode([text.encode()])
        assert np.isclose(score(vocabulary, ids), brute(vocabulary, " " + text), rtol=1e-12)


def _varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(*fields):
    """Protocol buffer fields (number, value): integers, floats, bytes."""
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += _varint(number << 3) + _varint(value)
        elif isinstance(value, float):
            out += _varint(number << 3 | 5) + np.float32(value).tobytes()
        else:
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


@pytest.fixture(scope="module")
def unigram_file(vocabulary, tmp_path_factory):
    """The same pieces and log scores as a Unigram model file."""
    own = [(1, _message((1, p), (2, float(s)), (3, int(k)))) for p, s, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True)]
    spec = [(2, _message((3, pieces.UNIGRAM), (35, 1))), (3, _message((1, b"identity"), (3, int(vocabulary.dummy_prefix)), (4, 0), (5, 1)))]
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(_message(*own, *spec))
    return str(path)


def test_scores_are_logarithms(vocabulary):
    shares = np.exp(vocabulary.scores[vocabulary.kinds == pieces.NORMAL])
    assert abs(shares.sum() - 1) < 1e-3 and shares.max() < 0.2


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Vocabulary.load(pieces.model_path())


def test_the_library_finds_the_same_pieces(vocabulary, unigram_file, corpus):
    """sentencepiece, with the same file: equal ids, or for ties in its single precision an equal score."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=unigram_file)
    own = pieces.Vocabulary.load(unigram_file).check()
    assert (own.scores == vocabulary.scores).all()
    texts = [t for t in ODD if "\u2581" not in t] + [t for _, t in corpus if t] + ["Plain prose, with marks; and Numbers 1234.", "unbelievableness  twice", "Über die Brücke, señor; où êtes-vous?"]
    same = 0
    for t in texts:
        got, want = own.encode([t.encode()])[0].tolist(), library.encode(t)
        assert own.decode(np.array(got, np.int64), np.array([0, len(got)]))[0].decode() == t == library.decode(got)
        same += got == want
        if got != want:
            assert abs(score(own, np.array(got)) - score(own, np.array(want))) < 1e-4 * len(want)
    assert same >= 0.95 * len(texts)


def test_encode_pieces_odd_tables(spark):
    path = pieces.model_path()
    assert pieces.encode_pieces(spark.createDataFrame([], "text string, doc_id long"), path).count() == 0
    long = "word " * 300_000 + "x" * 5000
    rows = [(None, 1), ("", 2), ("a", 3), ("a", 3), (long, None)]
    got = pieces.encode_pieces(spark.createDataFrame(rows, "text string, doc_id long"), path).collect()
    assert sorted((r.doc_id or 0, None if r.ids is None else len(r.ids) > 0, r.round_trip) for r in got) == [(0, True, True), (1, None, None), (2, False, True), (3, True, True), (3, True, True)]


def test_long_segments_equal_short_ones(vocabulary, monkeypatch):
    texts = [t.encode() for t in ODD if "\u2581" not in t]
    want = [vocabulary.encode_segments([t])[0] for t in texts if t]
    monkeypatch.setattr(pieces, "SIDE_BY_SIDE", 0)
    assert [list(a) for a in want] == [list(vocabulary.encode_segments([t])[0]) for t in texts if t]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_pieces_round_trip(texts):
    own = pieces.vocabulary(pieces.model_path())
    texts = [t.replace("\u2581", "_").encode("utf-8", "ignore") for t in texts]
    ids, at = own.encode(texts)
    assert own.decode(ids, at) == texts


def test_trie():
    words = {bytes([a, b, c])[:n]: 100 * a + 10 * b + c for n in (1, 2, 3) for a in range(5) for b in range(0, 250, 7) for c in range(3)}
    trie = pieces.DoubleArray(words)
    for word, n in words.items():
        state = 0
        for b in word:
            assert trie.check[trie.base[state] + b] == state + 1
            state = trie.base[state] + b
        assert trie.value[state] == n
    assert trie.check[trie.base[0] + 200] != 1


def test_encode_pieces(spark, docs, corpus):
    rows = {r.doc_id: r for r in pieces.encode_pieces(docs.withColumn("ids", docs.id), pieces.model_path()).collect()}
    own = pieces.vocabulary(pieces.model_path())
    assert len(rows) == len(corpus)
    for i, t in corpus:
        if t is None:
            assert rows[i].ids is None and rows[i].round_trip is None
        else:
            assert rows[i].ids == own.encode([t.encode()])[0].tolist() and rows[i].round_trip
    marked = spark.createDataFrame([("a \u2581 b",), ("",)], "text string")
    assert [r.round_trip for r in pieces.encode_pieces(marked, pieces.model_path()).collect()] == [False, True]


# -- token files ------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=500), st.booleans(), st.integers(1, 64))
def test_pack(ids, bits, block):
    ids = np.array(ids, np.uint32)
    data = token_files.pack(ids, bits=bits, block=block)
    assert (token_files.unpack(data) == ids).all()
    assert (token_files.unpack(data, 5, 100) == ids[5:100]).all()


def test_segments_give_the_library_s_ids(corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, texts = Tokenizer.from_file(path), ODD + [t or "" for _, t in corpus]
    ids, at = token_files.encoder(path).texts([t.encode() for t in texts])
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == own.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZé×÷Äñ'.,;-|<5 \n\t\u00a0\u0085\u3000日s"), max_size=40))
def test_segments_of_anything(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, _ = token_files.encoder(path).texts([text.encode()])
    assert ids.tolist() == _library(path, Tokenizer).encode(text, add_special_tokens=False).ids


_KEPT = {}


def _library(path, kind):
    return _KEPT.setdefault(path, kind.from_file(path))


@pytest.mark.parametrize("bits", (False, True))
def test_files(spark, docs, corpus, tmp_path, bits, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_IDS", 500)
    path = public_tokenizers.path("byte_bpe_50k.json")
    cuts = token_files.shard_cuts(docs, shards=3)
    token_files.write_ids(token_files.encode_texts(docs.withColumn("shard", docs.id), path, cuts=cuts), str(tmp_path / "ids"), cuts, bits=bits)
    assert len(cuts) == 2 and spark.read.parquet(str(tmp_path / "ids")).select("shard").distinct().count() == 3
    got = {r.doc_id: r for r in token_files.read_ids(spark, str(tmp_path / "ids")).collect()}
    start = 0
    for i, t in sorted(corpus):
        ids = np.append(token_files.encoder(path).texts([(t or "").encode()])[0], 0).astype("<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files_of_nothing_and_null_ids(spark, tmp_path):
    path, schema = public_tokenizers.path("byte_bpe_50k.json"), "doc_id long, text string"
    token_files.write_ids(token_files.encode_texts(spark.createDataFrame([], schema), path), str(tmp_path / "a"), [])
    assert token_files.read_ids(spark, str(tmp_path / "a")).count() == 0
    token_files.write_ids(token_files.encode_texts(spark.createDataFrame([(7, "x"), (None, "abc"), (7, "x")], schema), path), str(tmp_path / "b"), [])
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_ids(spark, str(tmp_path / "b")).collect())
    assert [g[1] for g in got] == [None, 7, 7] and got[1][0] == got[0][2]


# -- language ID ------------------------------------------------------------------------------------------------

SYLLABLES = {"xx": "ka lo mi tu re".split(), "yy": "schu ber ein gro lich".split(), "zz": "éa où çe ment eau".split()}


def _prose(lang, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(n))


def test_language_id(spark):
    rows = [(i, _prose(lang, 30, i), lang, "s") for i, lang in enumerate(list(SYLLABLES) * 40)]
    labelled = spark.createDataFrame(rows + [(900, "text without label", None, "s"), (901, None, "xx", "s")], "doc_id long, text string, lang string, score string")
    model = langid.fit(labelled)
    assert model.langs == ["xx", "yy", "zz"] and (model.false_rate < 0.05).all()
    fresh = [(i, _prose(lang, 20, 1000 + i), lang, "s") for i, lang in enumerate(list(SYLLABLES) * 20)] + [(98, None, "-", "s"), (99, "12 ²³ !?", "-", "s"), (100, "", "-", "s")]
    got = langid.predict(spark.createDataFrame(fresh, "doc_id long, text string, want string, lang_pred string"), model).collect()
    assert len(got) == len(fresh)
    for r in got:
        assert r.lang_pred == (r.want if r.want != "-" else "und") and 0 <= r.score <= 1


def test_language_id_on_held_out_rows(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    got = langid.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_language_id_without_labels(spark):
    model = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), model).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def test_masks_have_no_false_negatives():
    grams = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 5000).astype(np.uint64))
    cells = np.zeros((1, 1 << 18), np.uint32)
    for slots in langid._slots(grams, 1 << 18):
        cells[0, slots] |= np.uint32(2)
    model = langid.Model(["a", "b"], cells, np.zeros(2))
    assert (langid.masks(model, grams) == 2).all()


def test_language_id_against_plain_sets(spark):
    """The filters' answer is that of sets of n-grams, but for their false positives."""
    rows = [(i, _prose(lang, 25, i), lang) for i, lang in enumerate(list(SYLLABLES) * 30)] + [(500, "a", "yy"), (501, "", "xx"), (502, "kaka", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: {} for lang in SYLLABLES}
    for _, t, lang in rows:
        if lang:
            for g in langid._grams([t])[0].tolist():
                counts[lang][g] = counts[lang].get(g, 0) + 1
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    own = {lang: {g for g, x in c.items() if x >= langid.PART * max(o.get(g, 0) for o in share.values())} for lang, c in share.items()}
    texts = [_prose(lang, k, 77 + k) for lang in SYLLABLES for k in range(1, 40)] + ["ka", "z", "kalo schu", "1 a"]
    langs, scores = langid.classify(model, texts)
    for t, lang, got in zip(texts, langs, scores, strict=True):
        grams = langid._grams([t])[0].tolist()
        want = {k: sum(g in own[k] for g in grams) / len(grams) for k in sorted(own)}
        top = max(want.values())
        assert want[lang] >= top - 0.1 and abs(got - top) < 0.12, t
