"""What the operators of this subpackage share: the shared folder, written tables, running Python over Arrow batches."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import sluice

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sluice)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset (tests), a temporary folder becomes it,
    in local mode only: on a cluster a folder of one machine is of no use to the others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="sluice-"))
    return f"{base}/sluice-{uuid.uuid4().hex}"


_LOCAL: dict[str, str] = {}
#: Folders written and not deleted yet, and the sessions that they are of.
_WRITTEN: dict[str, str] = {}


def forget(spark: SparkSession) -> None:
    """Deletes the tables that this session's operators have written so far and still hold. Results that were not yet
    written elsewhere are lost with them."""
    own = spark._jsparkSession.sessionUUID()
    for folder in [f for f, s in _WRITTEN.items() if s == own]:
        _delete(spark, folder)


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` has returned and that nothing will read any more."""
    for df in tables:
        if df is not None and (folder := getattr(df, "_sluice_folder", None)) in _WRITTEN:
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    _WRITTEN.pop(folder, None)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    _WRITTEN[folder] = spark._jsparkSession.sessionUUID()
    path = f"{folder}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sluice_folder = folder
    return out


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of 8 MB at most, rather than 64 MB or 10,000 texts: an executor and its workers hold
    several at a time. The setting stays for the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df.mapInArrow(run, schema)


def over_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, cut: int = 1 << 21) -> DataFrame:
    """``f`` over pieces of Arrow batches. A piece holds about ``cut`` bytes, or one row if that is larger, which bounds
    what ``f`` allocates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, cut):
                out = f(piece)
                if out is not None and out.num_rows:
                    yield out

    return arrow(df, run, schema)


def pieces(batch: pa.RecordBatch, cut: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of rows whose strings and binaries come to about ``cut`` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    size = np.full(n, 64, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + cut, side="right")))
        yield batch.slice(at, to - at)
        at = to


def grouped(batches: Iterator[pa.RecordBatch], by: tuple[int, ...]) -> Iterator[list[pa.Array]]:
    """The columns of each run of rows that agree in the columns ``by``, numbers without nulls; rows come sorted by these."""
    import numpy as np

    def whole(parts: list[pa.RecordBatch]) -> list[pa.Array]:
        return [c.chunk(0) if c.num_chunks else c.combine_chunks() for c in pa.Table.from_batches(parts).combine_chunks().columns]

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy() for i in by])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if held and any(held[-1].column(i)[held[-1].num_rows - 1] != b.column(i)[0] for i in by):
            new = np.concatenate([[0], new])
        at = 0
        for e in new.tolist():
            yield whole([*held, b.slice(at, e - at)] if e > at else held)
            held, at = [], e
        held.append(b.slice(at))
    if held:
        yield whole(held)


def cached(key, make: Callable):
    """``make()``, once in a Python worker, which keeps the latest alone, as workers outlive the stages they work for.
    Kept under ``sys``, as functions that travel by value have fresh globals."""
    store = sys.__dict__.setdefault("_sluice_cache", {})
    if key not in store:
        if store:
            store.clear()
            _give_back()
        store[key] = make()
    return store[key]


def _give_back() -> None:
    """Has the C library return freed memory to the system, where it can."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
