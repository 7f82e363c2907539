"""Language identification with language-bitmask n-gram filters: a bit-sliced Bloom filter whose cells hold one bit per language, in as many words as the languages need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from blockframe.llm.common import checkpointed, handing_back, table, unused

#: Bytes of an n-gram. Texts are lower-cased, anything but letters becomes one space.
GRAM = 4
#: Labelled rows of each language that the model is fitted on, about; chosen by a hash of the id.
SAMPLE_ROWS = 4_000
#: Cells of the filter for each n-gram of the language that has most (rounded up to a power of two, of at least LEAST_CELLS), and hashes of an n-gram.
CELLS_EACH, LEAST_CELLS, HASHES = 6, 1 << 12, 3
#: An n-gram belongs to a language if its share there is at least this part of its largest share in any language.
PART = 0.25
#: Languages that one word of a cell tells apart.
WORD_BITS = 32
#: Characters, and texts, that a task handles at once.
CHUNK, CHUNK_TEXTS = 1 << 20, 1 << 12
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
UNDETERMINED = "und"


@dataclass
class Model:
    langs: list[str]
    cells: np.ndarray  # uint32, words by cells: bit i of word w is the cell's bit in the filter of langs[32 w + i]
    false_rate: np.ndarray  # of each language's filter


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all texts one after the other, and where each text's begin (one more entry at the end). A gram never crosses texts; a text with a letter has one at least."""
    codes = []
    for text in texts:
        codes.append(" ".join(_words(text)).encode("utf-8", "replace"))
    codes = [(b" %b " % c).ljust(GRAM) if c else b"" for c in codes]
    sizes = np.array([len(c) for c in codes], np.int64)
    flat = np.frombuffer(b"".join(codes) + b"\0" * GRAM, np.uint8)
    n = len(flat) - GRAM
    grams = np.zeros(n, np.uint64)
    for i in range(GRAM):
        grams |= flat[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - GRAM + 1, 0)
    keep = np.ones(n, bool)
    for back in range(1, GRAM):
        at = ends - back
        keep[at[sizes >= back]] = False
    return grams[keep], np.concatenate([[0], np.cumsum(counts)])


def _words(text: str) -> list[str]:
    lowered = text.lower()
    if lowered.isascii():
        return lowered.encode().translate(_ASCII).decode().split()
    out = []
    for word in _RUN.findall(lowered):
        out += [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()
    return out


_RUN = re.compile(r"[^\W\d_]+")  # holds a few numerals that are no letters
_ASCII = bytes(b if 97 <= b <= 122 else 32 for b in range(256))


def _slots(grams: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    shift = np.uint64(64 - cells.bit_length() + 1)
    for m in MULTIPLIERS[:HASHES]:
        x = grams * np.uint64(m)
        x ^= x >> np.uint64(29)
        yield ((x * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64)


def masks(model: Model, grams: np.ndarray) -> np.ndarray:
    """For each n-gram the bits of all languages whose filter holds it, words by n-grams: one AND over the cells answers for all at once."""
    out = np.full((len(model.cells), len(grams)), 0xFFFFFFFF, np.uint32)
    for slots in _slots(grams, model.cells.shape[1]):
        out &= model.cells[:, slots]
    return out


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score (0 to 1) of each text. A language's hits, less those its false positive rate accounts for, divided by the n-grams, is its share; the
    largest share decides (ties: the first language) and is the score. Texts without letters are `und` with score 0."""
    grams, starts = _grams([t or "" for t in texts])
    found = masks(model, grams)
    total = np.diff(starts)
    share = np.zeros((len(texts), max(1, len(model.langs))))
    full = np.flatnonzero(total)
    for i in range(len(model.langs)):
        if len(full):
            hits = np.add.reduceat((found[i // WORD_BITS] >> np.uint32(i % WORD_BITS)) & np.uint32(1), starts[full]).astype(float)
            rate = model.false_rate[i]
            share[full, i] = (hits / total[full] - rate) / (1 - rate)
    best = share.argmax(axis=1)
    score = np.clip(share[np.arange(len(texts)), best], 0, 1)
    known = (total > 0) & bool(model.langs)
    return [model.langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], [float(s) if k else 0.0 for s, k in zip(score, known, strict=True)]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from text and lang of rows whose text and lang are not null, about sample_rows of each language (all, if fewer). No language and no n-gram of these rows is left out.

    The driver receives a row for each language, and the filter: its size follows the n-grams of the language that has most of them in the sample.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = checkpointed(rows.groupBy(F.col(lang_col).alias("label")).agg(F.count("*").alias("rows")))  # one row a language
    langs = sorted(r.label for r in sizes.select("label").collect())
    if not langs:
        return Model([], np.zeros((1, LEAST_CELLS), np.uint32), np.zeros(0))
    dice = F.pmod(F.xxhash64(F.lit(11), id_col, F.xxhash64(text_col)), F.lit(1 << 24)) / float(1 << 24)
    drawn = rows.join(F.broadcast(sizes), F.col(lang_col) == F.col("label")).where(dice < sample_rows / F.col("rows"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(own)):
                at = np.flatnonzero(own == lang)
                for part in _chunks([texts[i] for i in at]):
                    grams, n = np.unique(_grams(part)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = checkpointed(drawn.select(F.col("label").alias("lang"), F.col(text_col).alias("text")).mapInArrow(handing_back(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counted.join(F.broadcast(totals), "lang").select("lang", "gram", "n", (F.col("n") / F.col("total")).alias("share"))
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    own = checkpointed(shares.join(most, "gram").where(F.col("share") >= PART * F.col("most")).select("lang", "gram"))
    largest = own.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    size = max(LEAST_CELLS, 1 << (CELLS_EACH * largest - 1).bit_length())
    number = {lang: i for i, lang in enumerate(langs)}

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            grams = batch.column(1).to_numpy().astype(np.uint64)
            for at in _slots(grams, size):
                yield pa.RecordBatch.from_arrays([pa.array((of // WORD_BITS).astype(np.int32)), pa.array(at), pa.array(1 << (of % WORD_BITS))], ["word", "cell", "bits"])

    cells, rate = np.zeros((-(-len(langs) // WORD_BITS), size), np.uint32), np.zeros(len(langs))
    filled = own.mapInArrow(handing_back(slots), "word int, cell long, bits long").groupBy("word", "cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    cells[filled["word"].to_numpy(), filled["cell"].to_numpy()] = filled["bits"].to_numpy().astype(np.uint32)
    for i in range(len(langs)):
        rate[i] = (((cells[i // WORD_BITS] >> np.uint32(i % WORD_BITS)) & np.uint32(1)).mean()) ** HASHES
    return Model(langs, cells, rate)


def _chunks(texts: list, most: int = CHUNK) -> Iterator[list]:
    part, size = [], 0
    for t in texts:
        if part and (size + len(t or "") > most or len(part) >= CHUNK_TEXTS):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns lang and score (columns of these names are replaced); null, empty and letterless texts are `und`, score 0. Rows are judged each by their text alone; nothing is shuffled."""
    names = [c for c in docs.columns if c not in (lang, score)]
    kept = docs.select(*names)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, scores = [], []
            for part in _chunks(batch.column(at).to_pylist()):
                a, b = classify(sent.value, part)
                pred += a
                scores += b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(scores, pa.float64())], [*names, lang, score])

    return kept.mapInArrow(handing_back(label), StructType([*kept.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Null, empty and letterless texts are `und` with score 0; any text with a letter gets a learned language, if there is one."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


ORACLE_SQL: dict[str, str] = {}


def speaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs whose language could be told; null and letterless texts (`und`) go, and all others stay with all their columns. The model learns as in the query; where no row is labelled nothing can be told, and all rows stay."""
    model = fit(docs.where(~held_out()))
    if not model.langs:
        return docs
    lang, score = unused(docs, "_lang_pred"), unused(docs, "_score")
    marked = predict(docs, model, lang=lang, score=score)
    return marked.where(F.col(lang) != UNDETERMINED).select(*[marked[c] for c in docs.columns])
