"""A training-data pipeline over documents: each stage's rows are written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import common, langid, mixing, packing, pii, simhash

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language_id", langid.stage),
    ("simhash_near_dedup", simhash.stage),
    ("pii_pseudonyms", pii.stage),
    ("source_mixing", mixing.stage),
    ("packing", packing.stage),
]
#: SQL can't express the fingerprints' components, the samples or the packing; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs, f"pipeline-{name}")
    return docs
