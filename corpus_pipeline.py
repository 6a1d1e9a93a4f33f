"""From raw documents to token ids: quality, near-duplicates, secrets, mixing, BPE.

Each stage's result is written as Parquet in the shared folder and read again as the next one's documents, so a lost
executor costs no more than a part of a stage; it is deleted when the next one's is written. Files are read in any order; that of the mix is in ``slot`` and ``offset``
of the last stage's rows, by which ``run`` sorts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm.shared import drop, written
from sluice.llm.stages import bpe_stage, dedup_stage, mixing_stage, quality_stage, secrets_stage

STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the fitted classifier nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop(before)
    return docs.orderBy("slot", "offset")
