"""Registries from and to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.engine import Percolator


def save(engine: Percolator, path: str, fmt: str = "parquet") -> None:
    engine.filters().coalesce(1).write.mode("overwrite").format(fmt).save(path)


def load(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> Percolator:
    engine = Percolator(spark, **options)
    engine.load(spark.read.format(fmt).load(path))
    return engine


def json_documents(spark: SparkSession, path: str, doc: str = "doc") -> DataFrame:
    """Lines of JSON as VARIANT documents; lines that are no JSON have a null one."""
    from pyspark.sql import functions as F

    return spark.read.text(path).select(F.try_parse_json("value").alias(doc))
