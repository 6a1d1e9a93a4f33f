"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """A written table of edges (a, b) with a > b, as given ones are. Large: a node's larger neighbours move to the smallest of it and its neighbours. Small:
    a node and its smaller neighbours do. The minima are written, so that the join has a shuffle on either side of which
    Spark splits the partition of a node with very many neighbours."""
    around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = written(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
    met = around.join(least, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    out = written(out.filter("a <> b").distinct(), "large" if large else "small")
    drop(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node that can be reached) for every node of the edges ``a, b`` (long).

    Edges with a null end and loops are left out; repeated edges don't matter. No edges: no rows. What a round has written
    goes when the next one is done; the last stays.
    """
    now = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = written(now, "edges"), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        large = _star(now, True)
        drop(now)
        now = _star(large, False)
        drop(large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
