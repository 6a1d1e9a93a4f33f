"""Quality classifier: ordinal cumulative-link regression of graded ratings on hashed text.

One vector of weights is shared by all grades: P(grade <= k) = sigmoid(threshold[k] - w.x), thresholds in order. x holds a
1 for each hashed word and run of symbols that a text has, and for the levels of a few shares (capitals, symbols, repeated
words). An L1 penalty keeps the weights of words that only chance ties to a rating at exactly 0, so long texts are not
judged by the number of their words. Selection is by tail probability, P(grade >= k), and the expected grade.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, over_batches, written
from .textbatch import ascii_lower, buffers, set_bits, span_hashes, spans, word_table

#: Hashed features, a power of two, and the places of the levels of shares behind them.
FEATURES = 1 << 18
LEVELS, SHARES = 10, 4
#: Labelled rows that the classifier is fitted on at most, and features of all of these together; beyond, the rows with the
#: smallest hashes of their ids. A row that is taken has all its features.
MOST_LABELLED, MOST_FEATURES = 8000, 1 << 23


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all rows, each once in a row, and the offsets of the rows. Texts without words have their shares."""
    raw, offs = buffers(col)
    rows = len(offs) - 1
    data = ascii_lower()[raw]
    is_word = word_table()[raw]
    blank = (raw == 32) | (raw == 10) | (raw == 9) | (raw == 13)
    symbol = ~is_word & ~blank
    starts, ends, first = spans(is_word, offs)
    h = span_hashes(data, starts, ends)
    s_starts, s_ends, s_first = spans(symbol, offs)
    sh = span_hashes(data, s_starts, s_ends) ^ np.uint64(0x5BF03635)
    row = np.repeat(np.arange(rows), np.diff(first))
    s_row = np.repeat(np.arange(rows), np.diff(s_first))
    letters = set_bits((data >= 97) & (data <= 122), offs)
    upper = set_bits((raw >= 65) & (raw <= 90), offs)
    shown = np.maximum(1, np.diff(offs) - set_bits(blank, offs))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    n_words = np.diff(first)
    share = [
        upper / np.maximum(1, letters),
        set_bits(symbol, offs) / shown,
        np.bincount(row, weights=again, minlength=rows) / np.maximum(1, n_words),
        np.diff(s_first) / np.maximum(1, n_words + np.diff(s_first)),
    ]
    key = [(row.astype(np.uint64) << np.uint64(20)) | (h >> np.uint64(46)), (s_row.astype(np.uint64) << np.uint64(20)) | (sh >> np.uint64(46))]
    for k, x in enumerate(share):
        level = np.minimum(LEVELS - 1, np.floor(np.clip(x, 0, 1) * LEVELS)).astype(np.uint64) + np.uint64(FEATURES + LEVELS * k)
        key.append((np.arange(rows, dtype=np.uint64) << np.uint64(20)) | level)
    every = np.unique(np.concatenate(key))
    owner = (every >> np.uint64(20)).astype(np.int64)
    return (every & np.uint64((1 << 20) - 1)).astype(np.int64), np.searchsorted(owner, np.arange(rows + 1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Model:
    """Weights of features, and ordered thresholds, one fewer than there are grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1."""
        return _sigmoid(scores[:, None] - self.thresholds)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, *, l1: float = 2e-4, steps: int = 400, rate: float = 0.15) -> Model:
    """Proximal gradient with steps scaled by each feature's past gradients. It stops after ``steps``, as a rule before the
    optimum, with smaller weights; with many more it reaches it. No rows: weights 0, thresholds that give every grade the
    same probability."""
    size = FEATURES + LEVELS * SHARES
    prior = np.log(np.arange(1, n_grades) / (n_grades - np.arange(1, n_grades)))
    if not len(rows):
        return Model(np.zeros(size, np.float32), prior)
    used, column = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    n = len(rows)
    below = np.array([np.mean(grades <= k) for k in range(n_grades - 1)])
    theta = np.log(np.clip(below, 1e-3, 1 - 1e-3) / (1 - np.clip(below, 1e-3, 1 - 1e-3)))
    w, past, past_t = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(n_grades - 1, 1e-8)
    edge = np.concatenate([[-np.inf], np.zeros(n_grades - 1), [np.inf]])
    for _ in range(steps):
        s = np.add.reduceat(w[column], offs[:-1]) if len(column) else np.zeros(n)
        edge[1:-1] = theta
        up, low = _sigmoid(edge[grades + 1] - s), _sigmoid(edge[grades] - s)
        up, low = np.where(grades == n_grades - 1, 1.0, up), np.where(grades == 0, 0.0, low)
        p = np.maximum(up - low, 1e-9)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        back = (du - dl) / n  # of the negative log likelihood by the score
        g = np.bincount(column, weights=back[owner], minlength=len(used))
        gt = np.array([(dl[grades == k + 1].sum() - du[grades == k].sum()) / n for k in range(n_grades - 1)])
        past += g * g
        past_t += gt * gt
        step = rate / np.sqrt(past)
        w -= step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        theta = np.maximum.accumulate(theta - rate * gt / np.sqrt(past_t))
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, theta)


def labelled(docs: DataFrame, labels: DataFrame, grade: Column, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, most_features: int = MOST_FEATURES) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of at most ``most`` labelled rows, on the driver, with at most ``most_features`` features in all
    (one row at least). Rows without a grade or an id don't count; of several grades of an id the lowest does. Repeated ids
    are rows of their own within these bounds; ties of the hash go by id, then by number of features."""
    rated = labels.select(F.col(id_col).cast("long").alias("id"), grade.cast("int").alias("grade")).filter("id is not null and grade is not null")
    rated = rated.groupBy("id").agg(F.min("grade").alias("grade"))
    n = rated.count()
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40))
    rated = rated.withColumn("place", place).filter(F.col("place") < int((1 << 40) * min(1.0, 0.95 * most / max(1, n)))).orderBy("place", "id").limit(most)
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = found.join(F.broadcast(rated), "id")  # at most ``most`` rows of 20 bytes

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, offs = features(batch.column(1))
        raw = [index[a:b].astype(np.int32).tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(offs), pa.int64()), pa.array(raw, pa.binary())], names=["id", "grade", "place", "n", "features"])

    held = written(over_batches(found, run, "id long, grade int, place long, n long, features binary", 1 << 20), "labelled")
    table = held.orderBy("place", "id", "n", "features")
    sizes = np.cumsum([r.n for r in table.select("place", "id", "n").limit(most).collect()])
    rows = table.limit(max(1, int(np.searchsorted(sizes, most_features, side="right")))).collect()
    drop(held)
    rows.sort(key=lambda r: (r.id, bytes(r.features)))
    return [np.frombuffer(bytes(r.features), np.int32) for r in rows], np.array([r.grade for r in rows], np.int64)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``expected_grade`` and ``tail_probability`` (of the highest grade) of each whole text, beside the id or the columns
    in ``keep``. Null texts count as empty: they are scored by their shares. Rows are kept as they are. No shuffle."""
    columns = [c for c in (keep or [id_col]) if c != text_col]
    weights, thresholds = model.weights, model.thresholds
    index = np.flatnonzero(weights).astype(np.int32)
    value = weights[index]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dense = np.zeros(FEATURES + LEVELS * SHARES)
        dense[index] = value
        feats, offs = features(batch.column(batch.num_columns - 1))
        total = np.concatenate([[0.0], np.cumsum(dense[feats])])
        tails = Model(dense, thresholds).tails(total[offs[1:]] - total[offs[:-1]])
        cols = list(batch.columns) + [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])]
        return pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    d = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text_col).cast("string").alias("text_"))
    fields = [f"c{i} {d.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(columns))]
    out = over_batches(d, run, ", ".join([*fields, f"c{len(columns)} string", f"c{len(columns) + 1} double", f"c{len(columns) + 2} double"]), 1 << 20)
    names = [*columns, text_col, "expected_grade", "tail_probability"]
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n != text_col or keep and text_col in keep])


#: Grades of documents: 0 toxic, 1 of low quality, 2 good; selected are those more likely good than not.
GRADES, SELECT = 3, 0.5


def grade_of_labels() -> Column:
    return F.when(F.col("toxic") == 1, 0).when((F.col("quality") == 0) & F.col("toxic").isNotNull(), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def document_model(spark: SparkSession, sf_dir: str) -> Model:
    """Fitted on the documents that ``labels`` has ratings of."""
    return fit(*labelled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), grade_of_labels()), GRADES)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), document_model(spark, sf_dir))
    return out.withColumn("kept", F.col("tail_probability") >= SELECT)
