from pathlib import Path

import pyarrow as pa

from sluice.llm.shared import cached, drop, forget, grouped, pieces, written


def test_written_and_forgotten(spark):
    df = written(spark.createDataFrame([(1, "a"), (2, None)], "a int, b string"))
    assert sorted(map(tuple, df.collect())) == [(1, "a"), (2, None)]
    at = lambda x: Path(x.inputFiles()[0].removeprefix("file://")).parent
    folder, others = at(df), at(written(spark.newSession().createDataFrame([(1,)], "a int")))
    gone = written(df.select("a"))
    there = at(gone)
    assert folder.exists() and others.exists() and there.exists()
    drop(gone, None, df.select("a"))
    assert folder.exists() and not there.exists()
    forget(spark)
    assert not folder.exists() and others.exists()


def test_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 5000, 10, 20, 9000)] + [None]), pa.array(range(6))], names=["t", "n"])
    got = list(pieces(batch, 1000))
    assert [p.column(1).to_pylist() for p in got] == [[0], [1], [2, 3], [4], [5]]
    assert list(pieces(batch.slice(0, 0), 10)) == []


def test_cached_keeps_the_latest():
    made = []
    for k in (1, 1, 2, 2, 1):
        cached(("test", k), lambda: made.append(k))
    assert made == [1, 2, 1]


def test_grouped():
    rows = [(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 2, "d"), (2, 2, "e"), (2, 2, "f"), (3, 0, "g")]
    for cuts in ([], [2], [1, 2, 3], [4, 4, 5], [0, 7]):
        edges = [0, *cuts, len(rows)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:b]], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["x", "y", "z"]) for a, b in zip(edges, edges[1:])]
        assert [c[2].to_pylist() for c in grouped(iter(batches), (0, 1))] == [["a", "b"], ["c"], ["d", "e", "f"], ["g"]]
    assert list(grouped(iter([]), (0,))) == []
