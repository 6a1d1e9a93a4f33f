"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in an order by a hash of their ids, are cut into blocks of equal size. With weight share w a source's
block j is released at slot floor(j / w) and due at ceil((j + 1) / w); in every slot the earliest deadline among released
blocks wins (ties: the block released first, then the source that sorts first), which keeps each source within one block
of its share at every slot. Weights are exact: a float is the decimal that it prints as. In lowest terms they are whole
numbers, and the schedule repeats after their sum, the period; every block finds its slot from one period by arithmetic.
When a source runs out, a new phase begins with the weights of the others. All rows of all sources are placed, once each.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow

#: Rows of a block.
BLOCK_ROWS = 64
#: Sources at most; more are an error. The driver holds a number for each source of each phase, and a phase ends with a
#: source.
MOST_SOURCES = 2000
#: Rows of a source that are ranked in one piece, roughly.
RANGE_ROWS = 1 << 20
#: Rows of a table that is broadcast at most; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1 << 16


def turns(weights: list[int]) -> Iterator[int]:
    """The source of each slot of one period. The memory it takes is that of a block for each source."""
    total = sum(weights)
    waiting = [(0, i, 0) for i, w in enumerate(weights) if w]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[i]), release, i, j))
        due, _, i, j = heapq.heappop(ready)
        assert slot < due, "a block is late"
        yield i
        if j + 1 < weights[i]:
            heapq.heappush(waiting, ((j + 1) * total // weights[i], i, j + 1))


@dataclass(frozen=True)
class Phase:
    """From a slot on, until a source runs out: each source's blocks done before and its blocks in a period, by number of
    the source; slots of the period, and of those that are used."""

    start: int
    done: dict[int, int]
    share: dict[int, int]
    length: int
    used: int

    def slots(self) -> Iterator[tuple[int, int, int]]:
        """(source, its block in the period, slot of the period), as far as used."""
        order, count = list(self.share), dict.fromkeys(self.share, 0)
        for slot, i in zip(range(self.used), turns(list(self.share.values())), strict=False):
            s = order[i]
            yield s, count[s], slot
            count[s] += 1


def phases(blocks: list[int], weights: list[int]) -> list[Phase]:
    """The phases that place all blocks of all sources, which are numbered. ``weights``: positive whole numbers. A phase
    costs a simulation of its slots or of one period, whichever are fewer."""
    left = {s: n for s, n in enumerate(blocks) if n}
    done, start, out = dict.fromkeys(left, 0), 0, []
    while left:
        common = math.gcd(*(weights[s] for s in left))
        share = {s: weights[s] // common for s in left}
        length = sum(share.values())
        # the source that runs out first does so in this period, with this block of the period
        period = min((n - 1) // share[s] for s, n in left.items())
        goal = {s: (n - 1) % share[s] for s, n in left.items() if (n - 1) // share[s] == period}
        order, count = list(share), dict.fromkeys(share, 0)
        for slot, i in enumerate(turns(list(share.values()))):
            s = order[i]
            count[s] += 1
            if goal.get(s) == count[s] - 1:
                break
        out.append(Phase(start, {s: done[s] for s in share}, share, length, length if period else slot + 1))
        start += period * length + slot + 1
        for s, k in share.items():
            done[s] += period * k + count[s]
            left[s] -= period * k + count[s]
            if not left[s]:
                del left[s]
    return out


def exact(weights: dict) -> dict:
    """Positive weights as whole numbers in the same proportion, in lowest terms."""
    try:
        parts = {s: Fraction(repr(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    except (ValueError, OverflowError):
        raise ValueError("weights must be positive numbers") from None
    if any(w <= 0 for w in parts.values()):
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in parts.values()))
    common = math.gcd(*(int(w * scale) for w in parts.values()))
    return {s: int(w * scale) // common for s, w in parts.items()}


def slot_table(spark: SparkSession, plan: list[Phase]) -> DataFrame:
    """``phase, number, j, slot_in``: the used slots of each phase's period. Tables of more than BROADCAST_ROWS are made by
    a task for each phase, which holds a batch of them at a time."""
    schema = "phase int, number int, j long, slot_in long"
    if sum(p.used for p in plan) <= BROADCAST_ROWS:
        return F.broadcast(spark.createDataFrame([(n, *x) for n, p in enumerate(plan) for x in p.slots()], schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, share, length, used in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = Phase(0, {}, dict(json.loads(share)), length, used).slots()
                while rows := [x for x, _ in zip(found, range(1 << 16), strict=False)]:
                    s, j, slot = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(s), pa.int32()), pa.array(s, pa.int32()), pa.array(j, pa.int64()), pa.array(slot, pa.int64())], names=["phase", "number", "j", "slot_in"])

    rows = spark.createDataFrame([(n, json.dumps(list(p.share.items())), p.length, p.used) for n, p in enumerate(plan)], "phase int, share string, length long, used long")
    return arrow(rows.repartition(len(plan), "phase"), run, schema)


def _place(id_col: Column) -> Column:
    """A number in [0, 1) by a hash of the id: the order of a source's rows. Rows with equal ids are ordered by hash alone,
    as equal ones."""
    return (F.pmod(F.xxhash64(F.lit(3), id_col), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")


def mixed(rows: DataFrame, weights: dict | None = None, *, default: float = 1.0, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, keep: tuple[str, ...] = (), most_sources: int = MOST_SOURCES) -> DataFrame:
    """``source, block`` (within the source), ``slot`` (of the whole mix) and ``offset`` (within the block) of each row;
    order by (slot, offset) for the mix. ``weights``: by source; ``default`` for the others.

    A null source is a source of its own; null ids are ordinary ids. Repeated rows keep their number and get adjoining
    offsets, in no fixed order among themselves. A source's last block may hold fewer rows. Other columns than
    ``keep``, whose names differ from those used here, are not read. More than ``most_sources`` sources are an error.
    Ranks come from counts of hash ranges of about RANGE_ROWS rows, so that no task holds a source; what reaches the driver
    is a count for each source and for each range. The schedule is simulated there, a step for each slot of a phase or of
    its period, whichever are fewer, without being kept; its tables are broadcast up to BROADCAST_ROWS and joined by a
    shuffle beyond.
    """
    spark = rows.sparkSession
    d = rows.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), *keep).withColumn("place", _place(F.col("id")))
    counts = {r.source: r["count"] for r in d.groupBy("source").count().limit(most_sources + 1).collect()}
    if len(counts) > most_sources:
        raise ValueError(f"more than {most_sources} sources to mix")
    order = sorted(counts, key=lambda s: (s is not None, s))
    share = exact({s: (weights or {}).get(s, default) for s in order}) if order else {}
    plan = phases([-(-counts[s] // block_rows) for s in order], list(share.values()))
    # ranges: rows of a source whose places lie between k / ranges and (k + 1) / ranges
    total = max(1, sum(counts.values()))
    wanted = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_ROWS)
    sources = spark.createDataFrame([(s, k, max(1, round(wanted * counts[s] / total))) for k, s in enumerate(order)], "source string, number int, ranges int")
    d = d.join(F.broadcast(sources), d["source"].eqNullSafe(sources["source"])).select(d["id"], d["source"], "number", *keep, "place", "ranges")
    d = d.withColumn("range", F.floor(F.col("place") * F.col("ranges")).cast("int"))
    held, before = {}, []
    for r in sorted(d.groupBy("number", "range").agg(F.count("*").alias("n")).collect()):
        before.append((r.number, r.range, held.get(r.number, 0)))
        held[r.number] = held.get(r.number, 0) + r.n
    small = lambda made: (lambda x: F.broadcast(x) if len(made) <= BROADCAST_ROWS else x)
    starts = small(before)(spark.createDataFrame(before, "number int, range int, before long"))
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("number", "range").orderBy("place", "id")) - 1)
    ranked = ranked.join(starts, ["number", "range"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("id", "source", "number", *keep, F.floor(F.col("rank") / block_rows).alias("block"), (F.col("rank") % block_rows).cast("int").alias("offset"))
    # of each source: the phases' first blocks; and their numbers, starts, periods and blocks in a period
    own = {k: [(n, p) for n, p in enumerate(plan) if k in p.share] for k in range(len(order))}
    table = [(k, [p.done[k] for _, p in mine], [(n, p.start, p.length, p.share[k]) for n, p in mine]) for k, mine in own.items()]
    table = small([x for mine in own.values() for x in mine])(spark.createDataFrame(table, "number int, first array<long>, phases array<struct<phase:int,start:long,length:long,k:long>>"))
    at = F.size(F.filter("first", lambda x: x <= F.col("block")))
    out = ranked.join(table, "number").withColumn("at", at)
    out = out.withColumn("p", F.element_at("phases", F.col("at"))).withColumn("done", F.col("block") - F.element_at("first", F.col("at"))).drop("first", "phases")
    out = out.withColumn("phase", F.col("p.phase")).withColumn("j", F.col("done") % F.col("p.k")).join(slot_table(spark, plan), ["phase", "number", "j"])
    slot = F.col("p.start") + F.floor(F.col("done") / F.col("p.k")) * F.col("p.length") + F.col("slot_in")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "block", slot.cast("long").alias("slot"), "offset", *keep)


def in_order(rows: DataFrame, weights: dict | None = None, *, id_col: str = "doc_id", source_col: str = "source", **more) -> DataFrame:
    """The rows with all their columns, sorted in the order of the mix. Rows with a null id stay as well."""
    place = mixed(rows, weights, id_col=id_col, source_col=source_col, **more)
    # rows with equal id and source adjoin: the first of their places serves for all
    first = place.groupBy(id_col, source_col).agg(F.min(F.struct("slot", "offset")).alias("mix_place_")).select(F.col(id_col).alias("mix_id_"), F.col(source_col).alias("mix_source_"), "mix_place_")
    met = rows.join(first, F.col(id_col).cast("long").eqNullSafe(F.col("mix_id_")) & F.col(source_col).cast("string").eqNullSafe(F.col("mix_source_")))
    return met.orderBy("mix_place_").select(*[rows[c] for c in rows.columns])


#: Target weights of the document sources: the largest source counts four times, two others twice.
DOCUMENT_WEIGHTS = {"src0": 4, "src1": 2, "src2": 2}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), DOCUMENT_WEIGHTS)
