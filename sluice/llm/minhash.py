"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. Document frequencies of hashed shingles, in a table of fixed size; the weight of a shingle in a text is
   (1 + ln tf) * idf. Shingles of fewer than RARE of all documents weigh the same; the more common ones, boilerplate,
   weigh less. Documents made of common shingles for the most part, copies within a large group, don't count for these, so
   a group's size does not change how alike its members are.
2. For each text HASHES weighted samples (for hash k and each shingle r, c, b are drawn by its hash; t = floor(ln w / r + b);
   the shingle with the smallest ln c - r (t + 1 - b) is the sample, together with its t) and a digest of its weighted set.
   Texts with equal digests are one class from here on.
3. A band is a fixed choice of ROWS hashes; classes that agree in a band share a bucket. Each bucket's leader, the member
   with the most company in all its buckets, is compared with the bucket: a row for each member.
4. Links, verified on the texts, make components. Where a bucket still holds several, its members get DETAIL more samples,
   a byte of each, and are compared in blocks: pairs of different components that agree in at least AGREE_DETAIL of these
   are verified as well, each found in the first bucket that its two members share.
No bucket is capped, and pairs of a bucket never become rows before the samples have ruled most of them out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import arrow, cached, drop, grouped, over_batches, pieces, written
from .textbatch import buffers, mix, shingles, span_hashes, spans, word_table

WORDS, SIMILAR = 5, 0.8
HASHES, ROWS, BANDS = 64, 6, 40
#: Places of the document-frequency table, and the share of documents below which a shingle is rare. What else hashes to
#: a place adds about (shingles of a text) / FEATURES to a share, far below RARE for texts of usual length.
FEATURES, RARE = 1 << 18, 0.05
#: The share of common shingles from which on a document is a copy rather than one that has boilerplate.
COPY = 0.5
#: Samples that a verified pair agrees in at least: 2.5 standard deviations below what SIMILAR lets expect.
AGREE = math.ceil(HASHES * SIMILAR - 2.5 * math.sqrt(HASHES * SIMILAR * (1 - SIMILAR)))
#: Further samples of the classes whose buckets hold several components, and those that a verified pair agrees in at
#: least: 3 standard deviations below what SIMILAR lets expect.
DETAIL = 256
AGREE_DETAIL = math.ceil(DETAIL * SIMILAR - 3 * math.sqrt(DETAIL * SIMILAR * (1 - SIMILAR)))
#: Rows of the tables that r, c and b are drawn from, by a hash of the shingle for each sample; and of those for DETAIL.
DRAWS, DRAWS_DETAIL = 1 << 14, 1 << 12
#: Places of a part of the document-frequency table, and classes of a block.
PART, BLOCK = 1 << 12, 256
_ID = np.uint64((1 << 48) - 1)


def shingle_counts(col: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, 48-bit shingle hashes (rising within a row) and how often each stands there."""
    data, offs = buffers(pc.utf8_lower(col))
    starts, ends, first = spans(word_table()[data], offs)
    own, row = shingles(span_hashes(data, starts, ends), first, k)
    every, count = np.unique((row.astype(np.uint64) << np.uint64(48)) | (own >> np.uint64(16)), return_counts=True)
    return (every >> np.uint64(48)).astype(np.int64), every & _ID, count


def weights(ids: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(count)) * idf[(ids & np.uint64(FEATURES - 1)).astype(np.int64)]


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """1 for rare places, down to ln 2 / ln(1 + 1 / RARE) for those that all documents have."""
    return np.minimum(1.0, np.log1p(max(1, n) / np.maximum(df, 1)) / math.log(1 + 1 / RARE))


def _draws(seed: int, hashes: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, draws, 4): 1 / r, b, r, ln c + r (b - 1); and an odd multiplier for each hash."""
    g = np.random.RandomState(seed)
    r = g.gamma(2, 1, (hashes, draws))
    c = g.gamma(2, 1, (hashes, draws))
    b = g.uniform(0, 1, (hashes, draws))
    table = np.stack([1 / r, b, r, np.log(c) + r * (b - 1)], axis=2).astype(np.float32)
    odd = g.randint(1, 1 << 62, hashes, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return table, odd


def samples(row: np.ndarray, ids: np.ndarray, w: np.ndarray, hashes: int = HASHES, draws: int = DRAWS, seed: int = 1) -> np.ndarray:
    """A row of ``hashes`` 32-bit samples for each row that has shingles."""
    table, odd = cached(("icws", seed, hashes, draws), lambda: _draws(seed, hashes, draws))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    out = np.empty((len(first), hashes), np.uint32)
    scrambled, log_w = mix(ids), np.log(w).astype(np.float32)
    shift = np.uint64(64 - (draws - 1).bit_length())
    for k in range(hashes):
        h = scrambled * odd[k]
        d = np.take(table[k], (h >> shift).astype(np.int64), axis=0)
        t = np.floor(log_w * d[:, 0] + d[:, 1])
        rank = (d[:, 3] - d[:, 2] * t).view(np.int32)
        rank = np.where(rank < 0, ~rank, rank | np.int32(-0x80000000)).view(np.uint32).astype(np.uint64)
        own = (h ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(0xFFFFFFFF)
        out[:, k] = np.minimum.reduceat(rank << np.uint64(32) | own, first) & np.uint64(0xFFFFFFFF)
    return out


def _bands() -> np.ndarray:
    g = np.random.RandomState(2)
    return np.stack([g.permutation(HASHES)[:ROWS] for _ in range(BANDS)])


def buckets(sample: np.ndarray) -> np.ndarray:
    """A 64-bit bucket of each row in each band."""
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sample), BANDS)).copy()
    for j in range(ROWS):
        h = mix((h ^ sample[:, _bands()[:, j]].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93))
    return h.view(np.int64)


def frequencies(texts: DataFrame) -> np.ndarray:
    """How many rows of ``text`` have a shingle at each of FEATURES places, and the number of rows last; 2 MB on the
    driver whatever the input. What most places have, from shingles that happen to share them, is taken off: long texts
    fill all places, which does not make their shingles common.

    Places of more than RARE of all rows are counted once more, without the rows that have COPY of their shingles at such
    places: what the members of a large group share would else weigh less than their differences. A second pass, if there
    are such places."""
    total = _above(_counted(texts, None))
    common = total[:FEATURES] > RARE * total[FEATURES]
    if common.any():
        total[:FEATURES][common] = _counted(texts, common)[:FEATURES][common]
    return total


def _above(total: np.ndarray) -> np.ndarray:
    total[:FEATURES] = np.maximum(total[:FEATURES] - int(np.median(total[:FEATURES])), 0)
    return total


def _counted(texts: DataFrame, common: np.ndarray | None) -> np.ndarray:
    packed = None if common is None else np.packbits(common).tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = None if packed is None else np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        total = np.zeros(FEATURES + PART, np.int64)
        for batch in batches:
            for p in pieces(batch, 1 << 20):
                row, ids, _ = shingle_counts(p.column(0))
                at = np.unique(row.astype(np.uint64) * np.uint64(FEATURES) + (ids & np.uint64(FEATURES - 1)))
                if often is not None:
                    one, hit = (at // np.uint64(FEATURES)).astype(np.int64), often[(at & np.uint64(FEATURES - 1)).astype(np.int64)]
                    copy = np.bincount(one, weights=hit, minlength=p.num_rows) >= COPY * np.bincount(one, minlength=p.num_rows)
                    at = at[hit & ~copy[one]]
                total[:FEATURES] += np.bincount((at & np.uint64(FEATURES - 1)).astype(np.int64), minlength=FEATURES)
                total[FEATURES] += p.num_rows
        yield from parts(total)

    def parts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = [k for k in range(len(total) // PART) if total[k * PART : (k + 1) * PART].any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[k * PART : (k + 1) * PART].tobytes() for k in some], pa.binary())], names=["part", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(raw.as_buffer(), np.int64)
                have[k] = have[k] + more if k in have else more.copy()
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([x.tobytes() for x in have.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    total = np.zeros(FEATURES + PART, np.int64)
    for r in arrow(arrow(texts, count, schema).repartition("part"), merge, schema).collect():
        total[r.part * PART : (r.part + 1) * PART] += np.frombuffer(bytes(r.counts), np.int64)
    return total[: FEATURES + 1]


def sampled(docs: DataFrame, idf) -> DataFrame:
    """``id, h, digest, bands, samples`` of ``id, text, h``; digest, of the weighted set or of a text without words, is
    null for null texts; bands and samples are empty where there are no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(1)
        row, ids, count = shingle_counts(text)
        n = batch.num_rows
        digest = np.zeros((n, 2), np.uint64)
        own = mix(ids + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        np.add.at(digest[:, 0], row, own)
        np.add.at(digest[:, 1], row, mix(own ^ np.uint64(0x5851F42D4C957F2D)))
        some = np.unique(row)
        found = samples(row, ids, weights(ids, count, idf.value)) if len(row) else np.zeros((0, HASHES), np.uint32)
        without = np.setdiff1d(np.arange(n), some)
        if len(without):
            data, offs = buffers(text)
            digest[without, 0] = span_hashes(data, offs[:-1], offs[1:])[without] if len(data) else 0
            digest[without, 1] = np.diff(offs)[without].astype(np.uint64)
        null = text.is_null().to_numpy(zero_copy_only=False)
        each = np.zeros(n, np.int64)
        each[some] = 1
        lists = lambda x, m: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each * m)]), pa.int32()), pa.array(x.reshape(-1)))
        raw = digest.tobytes()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([None if null[i] else raw[16 * i : 16 * i + 16] + bytes([each[i]]) for i in range(n)], pa.binary()), lists(buckets(found), BANDS), lists(found.view(np.int32), HASHES)],
            names=["id", "h", "digest", "bands", "samples"],
        )

    return over_batches(docs.select("id", "text", "h"), run, "id long, h long, digest binary, bands array<long>, samples array<int>", 1 << 20)


def jaccard(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 0 where either has no words."""
    sets = []
    for col in (a, b):
        row, ids, count = shingle_counts(col)
        sets.append(((row.astype(np.uint64) << np.uint64(48)) | ids, weights(ids, count, idf), row))
    (ka, wa, ra), (kb, wb, rb) = sets
    n = len(a)
    both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    low = np.bincount(ra[ia], weights=np.minimum(wa[ia], wb[ib]), minlength=n)
    total = np.bincount(ra, weights=wa, minlength=n) + np.bincount(rb, weights=wb, minlength=n)
    return low / np.maximum(total - low, 1e-12)


def verified(pairs: DataFrame, texts: DataFrame, idf, similar: float) -> DataFrame:
    """Of pairs ``a, b`` those at least so similar, by the texts of ``uid, text``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = pa.array(jaccard(batch.column(2), batch.column(3), idf.value) >= similar)
        return pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    met = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b")
    return over_batches(met.select("a", "b", "text_a", "text_b"), run, "a long, b long", 1 << 20)


def promising(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of pairs ``a, b`` those that agree in at least AGREE samples."""
    met = pairs.join(known.select(F.col("uid").alias("a"), F.col("samples").alias("x")), "a").join(known.select(F.col("uid").alias("b"), F.col("samples").alias("y")), "b")
    agree = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return met.filter(agree >= AGREE).select("a", "b")


def detailed(texts: DataFrame, idf) -> DataFrame:
    """``uid, detail`` (a byte of each of DETAIL samples) of ``uid, text``; all texts have words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, ids, count = shingle_counts(batch.column(1))
        found = samples(row, ids, weights(ids, count, idf.value), DETAIL, DRAWS_DETAIL, 3).astype(np.uint8)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], names=["uid", "detail"])

    return over_batches(texts.select("uid", "text"), run, "uid long, detail binary", 1 << 20)


def across(members: DataFrame) -> DataFrame:
    """Pairs of different components that share a bucket and agree in at least AGREE_DETAIL samples, once each.
    ``members``: band, bucket, uid, component, samples, detail, n (members of the bucket)."""
    dealt = members.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("uid"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "uid", "component", "samples", "detail", "band")
    dealt = dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in grouped(batches, (0, 1, 2)):
            if len(c[0]) > 1:
                yield from compared(c)

    def compared(c: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        part, uid, comp = (c[i].to_numpy() for i in (3, 4, 5))
        found = c[6].flatten().to_numpy().reshape(len(uid), -1)
        detail = np.frombuffer(b"".join(x.as_buffer() for x in c[7]), np.uint8).reshape(len(uid), -1)
        band, places = c[8][0].as_py(), _bands()
        wanted = np.triu(comp[:, None] != comp[None, :])
        if c[1][0] != c[2][0]:
            wanted &= part[:, None] != part[None, :]
        i, j = np.nonzero(wanted)
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            ok = (detail[x] == detail[y]).sum(axis=1) >= AGREE_DETAIL
            x, y = x[ok], y[ok]
            shared = (found[x] == found[y])[:, places].all(axis=2)
            ok = shared.argmax(axis=1) == band
            if ok.any():
                x, y = uid[x[ok]], uid[y[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return arrow(dealt, run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """For each row ``class_id`` (smallest id of its class: rows connected by pairs at least ``similar``), ``kept`` (true
    for one row of each class, one with that id), ``text_hash`` (xxhash64 of the text).

    Texts of one to four words have one shingle, all their words. Texts without words are copies of equal texts alone.
    Null texts are classes of their own. A null id takes part but is never smaller than another; a class of null ids
    alone has class_id null. Repeated rows are copies: one is kept. Other columns are not read.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    total = frequencies(d.filter("text is not null").select("text"))
    idf = spark.sparkContext.broadcast(idf_of(total[:FEATURES], int(total[FEATURES])))
    own = written(sampled(d, idf).withColumn("row", F.monotonically_increasing_id()), "samples")

    order = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), F.col("row"))
    classes = own.filter("digest is not null").groupBy("digest").agg(F.min(order).alias("first"))
    classes = written(classes.select("digest", F.col("first.row").alias("uid"), F.col("first.id").alias("least_id")), "classes")
    known = own.filter("size(samples) > 0").join(classes.select(F.col("uid").alias("row")), "row", "left_semi").select(F.col("row").alias("uid"), "id", "h", "bands", "samples")
    known = written(known, "known")

    spread = known.select("uid", F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(spread.join(shared, "bucket"), "members")
    company = written(members.groupBy("uid").agg(F.sum("n").alias("company")), "company")
    lead = members.join(company, "uid").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("uid")).alias("minus"))).alias("best"))
    lead = written(lead.select("bucket", (-F.col("best.minus")).alias("leader")), "leaders")
    pairs = members.join(lead, "bucket").filter("uid <> leader").select(F.least("uid", "leader").alias("a"), F.greatest("uid", "leader").alias("b")).distinct()
    pairs = written(promising(pairs, known), "pairs")
    drop(lead)

    want = company.join(known.select("uid", "id", "h"), "uid").select("uid", "id", "h")
    texts = d.join(want.withColumnRenamed("id", "want"), [F.col("id").eqNullSafe(F.col("want")), d["h"] == want["h"]]).select("uid", "text")
    texts = written(texts.dropDuplicates(["uid"]), "texts")
    links = written(verified(pairs, texts, idf, similar), "links")
    joined = written(components(links), "components")
    drop(company)

    labelled = members.join(joined.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    labelled = written(labelled, "labelled")
    drop(members, joined)
    several = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    rest = written(labelled.join(several, "bucket"), "rest")
    detail = detailed(texts.join(rest.select("uid").distinct(), "uid"), idf)
    dealt = rest.join(known.select("uid", "samples"), "uid").join(detail, "uid")
    found = written(across(dealt), "more")
    more = written(verified(found.join(pairs, ["a", "b"], "left_anti"), texts, idf, similar), "more")
    drop(labelled, rest, found, pairs, known, texts)
    joined = written(components(links.union(more)), "components")
    drop(links, more)

    ends = classes.join(joined.withColumnRenamed("node", "uid"), "uid", "left").select("digest", "uid", "least_id", F.coalesce("component", "uid").alias("component"))
    first = written(ends.groupBy("component").agg(F.min(F.struct("least_id", "uid")).alias("first")), "first")
    found = written(ends.join(first, "component").select("digest", F.col("first.least_id").alias("class_id"), F.col("first.uid").alias("keep")), "ends")
    drop(classes, first, joined)
    out = own.select("id", "h", "digest", "row").join(found, "digest", "left")
    named = F.when(F.col("digest").isNull(), F.col("id")).when(F.col("class_id") < (1 << 63) - 1, F.col("class_id"))
    return out.select(F.col("id").alias(id_col), named.alias("class_id"), F.coalesce(F.col("keep") == F.col("row"), F.lit(True)).alias("kept"), F.col("h").alias("text_hash"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows with all their columns, one of each class of near-duplicates. Null texts all stay."""
    found = written(near_duplicates(docs, id_col=id_col, text_col=text_col, similar=similar), "found")
    count = found.groupBy(F.col(id_col).alias("id_"), F.col("text_hash").alias("h_")).agg(F.count("*").alias("n_"), F.sum(F.col("kept").cast("long")).alias("keep_"))
    count = count.filter("keep_ > 0").select("id_", "h_", (F.col("keep_") < F.col("n_")).alias("repeated_"))
    d = docs.withColumn("text_hash_", F.xxhash64(F.col(text_col).cast("string")))
    met = d.join(count, d[id_col].cast("long").eqNullSafe(F.col("id_")) & (d["text_hash_"] == F.col("h_")))
    whole = met.filter("not repeated_").select(*docs.columns)
    return whole.unionByName(met.filter("repeated_").dropDuplicates(["id_", "h_"]).select(*docs.columns))
