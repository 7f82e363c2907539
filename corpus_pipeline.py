"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing, tokenization."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from blockframe.llm.common import shared_folder, table
from blockframe.llm.exact_dedup import drop_copies
from blockframe.llm.jaccard_join import without_near_copies
from blockframe.llm.langid import speaks
from blockframe.llm.mixing import mixed
from blockframe.llm.pieces import tokenized

#: (name, function of (spark, docs, sf_dir)); each stage's result is written and read again as the next one's docs.
STAGES = [("language_id", speaks), ("exact_dedup", drop_copies), ("jaccard_join", without_near_copies), ("mix_sources", mixed), ("sentencepiece", tokenized)]

#: Language ID, links over hashed parts and tokenization are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with what each one keeps written as Parquet below the shared checkpoint folder."""
    shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
