"""Streams of rows against a registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from sluice.engine import Percolator


def percolate_stream(engine: Percolator, rows: DataFrame, keys: list[str], **options) -> DataFrame:
    """Hits of a stream as a stream, without state: every filter is an expression on the row."""
    return engine.percolate(rows, keys, **{**options, "mode": "expression"})


def percolate_batches(engine: Percolator, rows: DataFrame, keys: list[str], sink: Callable[[DataFrame, int], None], **options) -> DataStreamWriter:
    """A writer that gives ``sink`` the hits of each micro-batch. Filters registered meanwhile count from the next batch
    on, and large registries are joined."""
    return rows.writeStream.foreachBatch(lambda batch, n: sink(engine.percolate(batch, keys, **options), n))
