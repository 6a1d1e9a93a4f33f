"""Document fingerprints: a quartile bucket digest of hashed byte triplets, and a bounded difference of two digests.

Every window of five bytes gives six triplets; each is hashed to one of 128 buckets. A bucket's count is written as two
bits, the quartile of the row's bucket counts that it falls in. Before these come a byte for the length, on a logarithmic
scale, and two for where the first and second quartiles lie against the third. The difference adds up distances of
quartiles (opposite ends count double), lengths and quartile positions; likeness is 1 less its share of the largest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow, pieces
from .textbatch import buffers

BUCKETS = 128
#: Positions of each triplet's bytes in a window.
TRIPLETS = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4)]
#: Bytes: length, first and second quartile against the third, then four buckets a byte.
SIZE = 3 + BUCKETS // 4
#: Most that the buckets, and the length with the quartiles, can differ by; likeness is 0 at half the first.
MOST_BUCKETS = 6 * BUCKETS
#: Bytes of a part, more or less, and what a row counts beside its text; cells at most, and values sampled for each.
PART_BYTES, ROW_BYTES, MOST_CELLS, SAMPLE = 128 << 20, 64, 1 << 15, 32
FAR = (1 << 63) - 1


def _tables() -> list[list[bytes]]:
    """For each triplet and byte of it, a permutation of 0..255."""
    r = np.random.RandomState(20)
    return [[bytes(r.permutation(256).astype(np.uint8)) for _ in t] for t in TRIPLETS]


TABLES = _tables()


def digests(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of SIZE bytes for each text. Texts of fewer than five bytes have no triplets, only a length."""
    rows = len(offs) - 1
    length = np.diff(offs)
    count = np.zeros((rows, BUCKETS), np.int64)
    n = len(data) - 4
    if n > 0:
        row = np.repeat(np.arange(rows, dtype=np.int64), length)
        within = row[:n] == row[4:]
        base = np.where(within, row[:n], rows) * BUCKETS
        raw = data.tobytes()
        for tables, at in zip(TABLES, TRIPLETS, strict=True):
            h = np.zeros(n, np.uint8)
            for table, k in zip(tables, at, strict=True):
                h ^= np.frombuffer(raw.translate(table), np.uint8)[k : k + n]
            count += np.bincount(base + (h & np.uint8(BUCKETS - 1)), minlength=(rows + 1) * BUCKETS)[: rows * BUCKETS].reshape(rows, BUCKETS)
    order = np.sort(count, axis=1)
    q = order[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (count[:, :, None] > q[:, None, :]).sum(axis=2).astype(np.uint8).reshape(rows, BUCKETS // 4, 4)
    out = np.empty((rows, SIZE), np.uint8)
    out[:, 0] = np.minimum(255, np.floor(np.log2(length + 1.0) * 8))
    third = np.maximum(q[:, 2], 1)
    out[:, 1] = q[:, 0] * 255 // third
    out[:, 2] = q[:, 1] * 255 // third
    out[:, 3:] = code[:, :, 0] | code[:, :, 1] << 2 | code[:, :, 2] << 4 | code[:, :, 3] << 6
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 to 1 for each pair of digests; 1 for equal ones."""
    unpack = lambda x: np.stack([x[:, 3:] >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(x), BUCKETS).astype(np.int64)
    apart = np.abs(unpack(a) - unpack(b))
    head = np.abs(a[:, :3].astype(np.int64) - b[:, :3].astype(np.int64))
    total = np.where(apart == 3, 6, apart).sum(axis=1) + np.minimum(head[:, 0], 64) + np.minimum(head[:, 1:].sum(axis=1) // 8, 32)
    return 1 - np.minimum(total, MOST_BUCKETS // 2) / (MOST_BUCKETS // 2)


def hexed(d: np.ndarray) -> list[str]:
    return [bytes(x).hex() for x in d]


def of_texts(texts: list[str]) -> np.ndarray:
    return digests(*buffers(pa.array(texts, pa.large_string())))


def edited(text: str, after: str) -> str:
    """The text with the second half of its code points replaced by as many of the other's first."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


@dataclass(frozen=True)
class Ranges:
    """Ranges of a long column: the lower bounds of cells, in order; the range of each cell (0 has the smallest values);
    and the largest value of each range that has any."""

    bounds: list[int]
    of: list[int]
    heads: dict[int, int]

    def column(self, key: str) -> Column:
        """The range of a row: its cell is found by halving, in a step for each bit of the number of cells."""
        bits = max(1, len(self.bounds).bit_length())
        bounds = _constant([*self.bounds, *[FAR] * ((1 << bits) - 1 - len(self.bounds))], "bigint")
        step = lambda at, n: F.when((F.col(key) < F.lit(FAR)) & (F.element_at(bounds, at + n) > F.col(key)), at).otherwise(at + n)
        cell = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(bits))]), F.lit(0), step)
        return F.element_at(_constant(self.of, "int"), F.least(cell, F.lit(len(self.bounds))) + 1)


def _constant(values: list[int], kind: str) -> Column:
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)")


def ranges(docs: DataFrame, key: str, size: Column, least_parts: int, part_bytes: int = PART_BYTES) -> Ranges:
    """Ranges of a long column whose rows' sizes add up to about as much each: at least ``least_parts`` of them, so far as
    there are values, and about ``part_bytes`` each at most, unless one value or one of MOST_CELLS cells has more. Cells are
    bounded by quantiles of a hash sample of values, so values that lie far apart don't matter. What reaches the driver is
    the sample, SAMPLE values for each cell, and a row for each cell."""
    known = docs.filter(F.col(key).isNotNull())
    n, total = known.agg(F.count("*"), F.sum(size)).first()
    if not n:
        return Ranges([], [0], {})
    parts = max(least_parts, -(-total // part_bytes))
    cells = min(MOST_CELLS, 8 * parts)
    share = min(1.0, SAMPLE * cells / n)
    place = F.pmod(F.xxhash64(key, F.lit(13)), F.lit(1 << 40))
    sample = sorted(r[0] for r in known.filter(place < int((1 << 40) * share)).select(key).collect())
    bounds = sorted({sample[len(sample) * k // cells] for k in range(1, cells)}) if sample else []
    found = known.groupBy(Ranges(bounds, list(range(len(bounds) + 1)), {}).column(key).alias("cell")).agg(F.sum(size).alias("size"), F.max(key).alias("top")).collect()
    each = {r.cell: r for r in found}
    goal, at, have, of, heads = max(1, total / parts), 0, 0, [], {}
    for c in range(len(bounds) + 1):
        own = each[c].size if c in each else 0
        if have and have + own > goal:
            at, have = at + 1, 0
        of.append(at)
        have += own
        if c in each:
            heads[at] = each[c].top
    return Ranges(bounds, of, heads)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_texts: bool = True) -> DataFrame:
    """Fingerprints of each whole text, of its edited text (see ``edited``; with the next row by falling id, after the
    last the first) and their likeness, and that to the next row's fingerprint.

    Null texts count as empty. Rows with equal ids stand in the order of their texts. A row with a null id has no next:
    its second half goes and ``near_next`` is null. A single row is its own next. Other columns are not read. One shuffle
    of the texts, by ranges of ids of about as many bytes each; a range also gets the one row that follows its last. Rows
    with one id are in one part, which streams them.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = ranges(d, "id", F.octet_length("text").cast("long") + ROW_BYTES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    heads = sorted(found.heads)
    count = max(found.of) + 1
    #: The range whose last row is followed by the head of this one.
    copy_to = {heads[k]: heads[(k + 1) % len(heads)] for k in range(len(heads))}
    d = d.withColumn("range", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(found.column("id")))
    known = _constant([found.heads.get(k, 0) for k in range(count)], "bigint")
    target = _constant([copy_to.get(k, 0) for k in range(count)], "int")
    leads = (F.col("range") >= 0) & (F.col("id") == F.element_at(known, F.col("range") + 1))
    places = F.when(leads, F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")), F.struct(F.element_at(target, F.col("range") + 1).alias("range"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra"))))
    dealt = d.withColumn("place", F.explode(places)).select(F.col("place.range").alias("range"), F.col("place.extra").alias("extra"), "id", "text")
    # a part for each range; rows without an id have no neighbours: they are dealt by their text
    part = F.when(F.col("range") < 0, F.pmod(F.xxhash64("text"), F.lit(count)).cast("int")).otherwise(F.col("range"))
    dealt = dealt.repartitionById(count, part)
    dealt = dealt.sortWithinPartitions("range", "extra", F.desc("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for p in pieces(batch, 1 << 20):
                rows = list(zip(*(c.to_pylist() for c in p.columns), strict=True))
                if last is not None:
                    rows.insert(0, last)
                last = rows.pop()
                if rows:
                    yield from described(rows, last)
        if last is not None:
            yield from described([last], None)

    def described(rows: list, after: tuple | None) -> Iterator[pa.RecordBatch]:
        both = [*rows, after] if after is not None else rows
        own = of_texts([r[3] for r in both])
        keep = [i for i, r in enumerate(rows) if not r[1]]
        if not keep:
            return
        follows = [i + 1 < len(both) and both[i][0] >= 0 and both[i + 1][0] == both[i][0] for i in keep]
        changed = [edited(rows[i][3], both[i + 1][3] if f else "") for i, f in zip(keep, follows, strict=True)]
        new = of_texts(changed)
        mine = own[keep]
        nxt = own[[i + 1 if f else i for i, f in zip(keep, follows, strict=True)]]
        near = likeness(mine, nxt)
        cols = [
            pa.array([rows[i][2] for i in keep], pa.int64()),
            pa.array([len(rows[i][3]) for i in keep], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(hexed(mine)),
            pa.array(hexed(new)),
            pa.array(likeness(mine, new)),
            pa.array([float(x) if f else None for x, f in zip(near, follows, strict=True)], pa.float64()),
        ]
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        if keep_texts:
            cols.append(pa.array(changed))
            names.append("edited_text")
        yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow(dealt, run, schema + (", edited_text string" if keep_texts else "")).withColumnRenamed("id", id_col)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_texts=False)
