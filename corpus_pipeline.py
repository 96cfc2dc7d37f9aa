"""Corpus pipeline: toxic documents, exact and near copies and leaked test items go; what is left is tokenised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polylogue.llm.byte_bpe import tokenised
from polylogue.llm.chunk_dedup import drop_exact_copies
from polylogue.llm.decontaminate import drop_contaminated
from polylogue.llm.jaccard_join import keep_one_of_each
from polylogue.llm.toxicity import drop_toxic
from polylogue.session import scratch_path

STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("tokenisation", tokenised),
]

#: Classifier, alignment and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
