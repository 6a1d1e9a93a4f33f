"""Near-duplicate embeddings: Euclidean p-stable hashing of normalised vectors, then exact cosines.

On unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c). A table's bucket is the tuple of K values
floor((a.x + b) / WIDTH), a normal and b uniform. K grows with the logarithm of the number of vectors, so that a vector
meets about COMPANY unrelated ones in a bucket at any size; the number of tables follows from K and the recall wanted at
the very threshold. Equal vectors are one class with a count. Buckets are dealt in blocks: all pairs of a bucket's blocks
are compared by matrix products, a pair counts in the first table that its two vectors share, and what leaves a block is a
sum for each vector and a spanning forest of its links, never the pairs.

What is dealt first is a sketch of each vector, the signs of SKETCH more projections: a row goes on if its sketch is near
another's in the block, nearer than a pair at the threshold is but for one in ten million. The vectors of these rows alone
are dealt to the blocks and compared exactly. They travel without their buckets: which table a linked pair shares first is
found from the vectors again, for linked ones alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import arrow, drop, grouped, written

WIDTH, COMPANY, BLOCK = 2.0, 512, 2048
#: Rows of a block that are compared at a time, and what rounding can take from a cosine in single precision.
ROWS, ROUNDING = 256, 1e-4
#: Bits of a sketch, two words of 64; and standard deviations by which those of a pair may differ more than expected.
SKETCH, SIGMAS = 128, 6
#: Probability that a pair at the threshold meets in some table; nearer pairs meet more surely.
RECALL = 0.9999


def meet(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two points at this distance in the same cell."""
    t = width / distance
    normal = 0.5 * (1 + math.erf(-t / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Projections of a table, and tables, for n vectors."""
    k = max(1, math.ceil(math.log(max(2, n / COMPANY)) / -math.log(meet(math.sqrt(2)))))
    hit = meet(math.sqrt(2 - 2 * cosine)) ** k
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - hit)))


def unit(rows: np.ndarray) -> np.ndarray:
    """Scaled to length 1 in double precision; scaled by the largest component first, against overflow."""
    rows = rows.astype(np.float64)
    x = rows / np.abs(rows).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray, k: int, tables: int, seed: int, first: int = 0) -> np.ndarray:
    """The bucket of each unit vector in each table from ``first`` on up to ``tables``, as a 64-bit hash of its K cells."""
    out = np.empty((len(x), tables - first), np.int64)
    for t in range(first, tables):
        r = np.random.RandomState([seed, x.shape[1], t])
        a, b = r.normal(size=(x.shape[1], k)), r.uniform(0, WIDTH, k)
        cell = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64)
        h = np.full(len(x), t + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(k):
            h = (h ^ cell[:, j]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        out[:, t - first] = h.view(np.int64)
    return out


def sketches(x: np.ndarray, seed: int) -> np.ndarray:
    """Two words of signs for each unit vector."""
    signs = x @ np.random.RandomState([seed, x.shape[1], 1 << 20]).normal(size=(x.shape[1], SKETCH)) > 0
    return np.packbits(signs, axis=1).view(np.int64)


def near_bits(cosine: float) -> int:
    """Bits in which the sketches of a pair at this cosine or above differ at most."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(SKETCH * p + SIGMAS * math.sqrt(SKETCH * p * (1 - p)))


def with_company(sketch: np.ndarray, part: np.ndarray, most: int, across: bool) -> np.ndarray:
    """Which rows of a block, or of two, have a sketch near another's."""
    words, n = sketch.view(np.uint64), len(sketch)
    out = np.zeros(n, bool)
    for at in range(0, n, ROWS):
        one, rest = words[at : at + ROWS], words[at:]
        apart = np.bitwise_count(one[:, None, 0] ^ rest[None, :, 0]).astype(np.uint8) + np.bitwise_count(one[:, None, 1] ^ rest[None, :, 1])
        near = apart <= most
        near[:, : len(one)] &= ~np.tri(len(one), dtype=bool)
        if across:
            near &= part[at : at + ROWS][:, None] != part[at:][None, :]
        out[at : at + ROWS] |= near.any(axis=1)
        out[at:] |= near.any(axis=0)
    return out


class Forest:
    """The smallest node that each node of a block is linked with, over links that come in parts."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            if (a == b).all():
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (low := self.root[self.root]).tolist() != self.root.tolist():
                self.root = low


def block(table: int, count: np.ndarray, part: np.ndarray, x: np.ndarray, k: int, seed: int, cosine: float, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of one block, or of two that are compared with each other (``across``): links of each row that count in
    this table, and each row's root. Cosines that single precision does not decide are taken in double precision."""
    n = len(x)
    links, trees, fine = np.zeros(n, np.int64), Forest(n), x.astype(np.float32)
    known, coded = np.zeros((table, n), np.int64), np.zeros((table, n), bool)
    for at in range(0, n, ROWS):
        near = fine[at : at + ROWS] @ fine[at:].T
        i, j = np.nonzero(near >= cosine - ROUNDING)
        i, j = i + at, j + at
        keep = i < j
        if across:
            keep &= part[i] != part[j]
        i, j = i[keep], j[keep]
        unsure = np.flatnonzero(near[i - at, j - at] < cosine + ROUNDING)
        ok = np.ones(len(i), bool)
        ok[unsure] = np.einsum("ij,ij->i", x[i[unsure]], x[j[unsure]]) >= cosine
        i, j = i[ok], j[ok]
        for t in range(table):  # pairs that share an earlier table go; near ones do so soon
            if not len(i):
                break
            new = np.unique(np.concatenate([i, j]))
            new = new[~coded[t, new]]
            if len(new):
                known[t, new], coded[t, new] = codes(x[new], k, t + 1, seed, t)[:, 0], True
            apart = known[t, i] != known[t, j]
            i, j = i[apart], j[apart]
        if not len(i):
            continue
        links += np.bincount(i, weights=count[j], minlength=n).astype(np.int64) + np.bincount(j, weights=count[i], minlength=n).astype(np.int64)
        trees.link(i, j)
    return links, trees.root


def near(vectors: DataFrame, *, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 8) -> DataFrame:
    """For each row ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable by links, its own
    included) and ``kept`` (its id is that). Floats travel as floats; all arithmetic is in doubles.

    Vectors that are null, empty, all zero or hold null or non-finite components link with nothing, and vectors of
    different sizes not with each other. Repeated rows are rows of their own: they link. A null id takes part; it is not
    smaller than any other (a component of null ids alone has null and is not kept). Other columns are not read.
    """
    kind = vectors.schema[vector_col].dataType
    kind = "array<float>" if kind.simpleString() == "array<float>" else "array<double>"
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"))
    fit = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = d.filter(fit).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = written(classes.withColumn("uid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    k, tables = plan(n, cosine)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(size)])
            found, bits = np.empty((b.num_rows, tables), np.int64), np.empty((b.num_rows, 2), np.int64)
            for m in np.unique(size):
                rows = np.flatnonzero(size == m)
                x = unit(flat[(at[rows][:, None] + np.arange(m))])
                found[rows], bits[rows] = codes(x, k, tables, seed), sketches(x, seed)
            cols = [b.column(0), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), tables).cast(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["uid", "s0", "s1", "codes"])

    coded = arrow(classes.select("uid", "v"), hashed, "uid long, s0 long, s1 long, codes array<long>")
    keys = written(coded.select("uid", "s0", "s1", F.posexplode("codes").alias("t", "code")), "keys")
    sizes = keys.groupBy("t", "code").agg(F.count("*").alias("m")).filter("m > 1").select("t", "code", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    sizes = written(sizes, "sizes")  # so that the join has a shuffle on either side, and Spark can split a hot bucket's
    dealt = keys.join(sizes, ["t", "code"]).withColumn("part", F.pmod(F.xxhash64("uid"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block_of = ["t", "code", "x", "y"]
    dealt = dealt.select(*block_of[:2], F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "uid", "part", "s0", "s1")
    most = near_bits(cosine)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in grouped(batches, (0, 1, 2, 3)):
            near = with_company(np.stack([c[6].to_numpy(), c[7].to_numpy()], axis=1), c[5].to_numpy(), most, c[2][0] != c[3][0])
            if near.any():
                yield pa.RecordBatch.from_arrays([x.filter(pa.array(near)) for x in c[:6]], names=[*block_of, "uid", "part"])

    dealt = arrow(dealt.repartition(*block_of).sortWithinPartitions(*block_of), sketched, "t int, code long, x int, y int, uid long, part int")
    wanted = written(dealt, "wanted")
    dealt = wanted.join(classes.select("uid", "n", "v"), "uid").select(*block_of, "uid", "part", "n", "v")
    dealt = dealt.repartition(*block_of).sortWithinPartitions(*block_of, "uid")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in grouped(batches, (0, 1, 2, 3)):
            uid, part, count = (x.to_numpy() for x in c[4:7])
            size = np.diff(c[7].offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(size)])
            flat = c[7].flatten().to_numpy()
            for m in np.unique(size):
                of = np.flatnonzero(size == m)
                links, root = block(int(c[0][0].as_py()), count[of], part[of], unit(flat[at[of][:, None] + np.arange(m)]), k, seed, cosine, c[2][0] != c[3][0])
                some = np.flatnonzero(links)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(uid[of][some]), pa.array(links[some]), pa.array(uid[of][root[some]])], names=["uid", "links", "root"])

    found = written(arrow(dealt, compared, "uid long, links long, root long"), "links")
    joined = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    known = classes.join(found.groupBy("uid").agg(F.sum("links").alias("links")), "uid", "left").join(joined.withColumnRenamed("node", "uid"), "uid", "left")
    known = known.select("v", "rep", F.coalesce("component", "uid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    each = written(known, "known")
    lowest = written(each.groupBy("component").agg(F.min("rep").alias("component_id")), "lowest")
    known = written(each.join(lowest, "component").select("v", "n_links", "component_id"), "classes")
    drop(classes, keys, sizes, wanted, found, joined, each, lowest)
    # by a hash first: sorting by that is cheap
    out = d.withColumn("fit", fit).withColumn("h", F.xxhash64("v")).join(known.withColumn("fit", F.lit(True)).withColumn("h", F.xxhash64("v")), ["h", "v", "fit"], "left")
    own = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95
),
reach(a, b) as (select vec_id, vec_id from embeddings union select reach.a, links.b from reach join links on reach.b = links.a),
c as (select a, min(b) as component_id from reach group by a)
select e.vec_id, (select count(*) from links where links.a = e.vec_id) as n_links, c.component_id, c.component_id = e.vec_id as kept
from embeddings e join c on c.a = e.vec_id
"""
