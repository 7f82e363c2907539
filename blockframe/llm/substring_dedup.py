"""Substring dedup: words of passages that occurred before, found by recompression symbols."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe.llm.common import table
from blockframe.llm.poly import Prints
from blockframe.llm.recompression import anchors, word_bounds
from blockframe.llm.repeats import Units, find_spans, keyed, removed

#: Words of a window.
WINDOW = 20


class Words(Units):
    size, earlier = WINDOW, True

    def __init__(self, texts: list[bytes]):
        flat = np.frombuffer(b"\n".join(texts), np.uint8)
        start, end = word_bounds(flat)
        self.values = Prints(flat).of(start, end)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.bounds = np.concatenate([[0], np.searchsorted(start, ends)])

    def anchors(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return anchors(self.values, self.doc, starts, self.size)


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text, n_words, n_removed, kept (the words that stay, joined by one space).

    Removed is each word covered by a window of WINDOW words of one document whose words also begin earlier: in a document with a smaller id, or
    before in the same one. Windows are judged on the input. Null and empty texts have no words; rows with a null id lose nothing and count for no other row. Rows
    that share id and text count as one document and get the same result; of rows that share only the id, the one with the smaller text hash is earlier. Other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    spans = find_spans(rows, Words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lost, kept = [], [], []
            for text, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                n.append(len(words))
                if own:
                    gone = removed(len(words), own)
                    lost.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone)]
                else:
                    lost.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "text", "n_words", "n_removed", "kept"])

    joined = rows.join(spans, ["doc", "key"], "left").select(F.col("doc").alias("id"), "text", "spans")
    return joined.mapInArrow(cut, "id long, text string, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeated_words(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


ORACLE_SQL: dict[str, str] = {}
