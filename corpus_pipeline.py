"""The corpus pipeline: documents in, packed token sequences out.

Each stage's result is written to the shared folder and read again as the next one's input, so
a lost executor costs a re-read, not the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shortlist.llm import stages
from shortlist.session import materialize

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("simhash_near_dedup", stages.near_dedup),
    ("benchmark_decontamination", stages.decontamination),
    ("packing", stages.pack),
]

#: Fingerprints, alignment and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
