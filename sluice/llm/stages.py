"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all documents it is given.

All but the last return the columns of the documents, whatever these are called: while a stage works, columns have names
of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, minhash, mixing, quality, secret_scan


def _apart(docs: DataFrame, work: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """What ``work`` makes of the documents under neutral column names (by original name in its second argument)."""
    own = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return work(docs.toDF(*own.values()), own).select(*own.values()).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are more likely of a lower grade than good. Fitted on the rated ones among ``docs``."""
    rated = quality.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.grade_of_labels())
    model = quality.fit(*rated, quality.GRADES)

    def work(d: DataFrame, own: dict[str, str]) -> DataFrame:
        return quality.score(d, model, id_col=own["doc_id"], text_col=own["text"], keep=d.columns).filter(F.col("tail_probability") >= quality.SELECT)

    return _apart(docs, work)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return _apart(docs, lambda d, own: minhash.one_of_each(d, id_col=own["doc_id"], text_col=own["text"]))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each secret; ``n_chars`` is that of the new text."""

    def work(d: DataFrame, own: dict[str, str]) -> DataFrame:
        found = secret_scan.scanned(d, id_col=own["doc_id"], text_col=own["text"])
        found = found.withColumn(own["text"], F.when(F.col(own["text"]).isNotNull(), secret_scan.redacted(F.col(own["text"]), F.col("spans"))))
        if n := own.get("n_chars"):
            found = found.withColumn(n, F.when(F.size("spans") > 0, F.length(own["text"]).cast(d.schema[n].dataType)).otherwise(F.col(n)))
        return found

    return _apart(docs, work)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mix: their files, and the rows in these, follow it."""
    return _apart(docs, lambda d, own: mixing.in_order(d, mixing.DOCUMENT_WEIGHTS, id_col=own["doc_id"], source_col=own["source"]))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and its ``slot`` and ``offset``: the order of the mix, whatever order files are read in.
    The places are those of the stage before, as they follow from ids and sources alone."""
    d = docs.select("doc_id", "source", F.col("text").cast("string").alias("text"))
    longest = d.agg(F.max(F.length("text"))).first()[0] or 0
    placed = mixing.mixed(d, mixing.DOCUMENT_WEIGHTS, keep=("text",))
    return bpe.encode(placed, bpe.read_vocabulary(), longest=longest, keep=("slot", "offset")).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "slot", "offset")
