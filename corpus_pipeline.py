"""A training corpus from documents, stage by stage.

Each stage reads what the one before it wrote, works on all of it, and but for the last gives
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailrank.llm import byte_bpe, mixing, quality, repeats, simhash
from mailrank.session import fresh_path

STAGES = [
    ("quality rules", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("suffix-array dedup", repeats.stage),
    ("source mixing", mixing.stage),
    ("byte-level bpe", byte_bpe.stage),
]

# Fingerprints and byte pairs have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
