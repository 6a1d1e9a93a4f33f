import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sluice.llm.quality import FEATURES, GRADES, LEVELS, SHARES, Model, document_model, features, fit, grade_of_labels, labelled, score


def loss(rows, grades, model):
    s = np.array([model.weights[r].sum() for r in rows])
    below = np.concatenate([np.zeros((len(s), 1)), 1 - model.tails(s), np.ones((len(s), 1))], axis=1)
    i = np.arange(len(s))
    return -np.log(below[i, grades + 1] - below[i, grades]).mean()


def test_features_are_a_texts_own():
    t = ["The the CAT ### sat", "", "a", "x " * 300, "été !! !!", None]
    index, offs = features(pa.array(t))
    for k, x in enumerate(t):
        alone, _ = features(pa.array([x]))
        assert index[offs[k] : offs[k + 1]].tolist() == alone.tolist() == sorted(set(alone.tolist()))
        assert sum(i >= FEATURES for i in alone) == SHARES
    assert set(features(pa.array(["cat dog"]))[0]) & set(features(pa.array(["DOG"]))[0])


def test_fit_finds_the_planted_order():
    r = random.Random(1)
    rows, grades = [], []
    for _ in range(600):
        g = r.randrange(3)
        noise = r.sample(range(100, 2000), 20)
        rows.append(np.unique([*noise, *([7] if g == 0 else []), *([8] if g == 1 else [])]))
        grades.append(g)
    grades = np.array(grades)
    m = fit(rows, grades, 3)
    assert m.weights[7] < -1 and m.weights[7] < m.weights[8] < 0 and m.thresholds[0] < m.thresholds[1]
    assert np.count_nonzero(m.weights) < 1000
    assert loss(rows, grades, m) < 0.5 < loss(rows, grades, Model(np.zeros(FEATURES + LEVELS * SHARES), np.array([-0.7, 0.7])))


def slow_fit(rows, grades, n_grades, l1, steps=30_000, rate=0.5):
    """The same penalised likelihood by plain proximal gradient descent with short steps, on a dense matrix."""
    x = np.zeros((len(rows), max(r.max() for r in rows) + 1))
    for k, r in enumerate(rows):
        x[k, r] = 1
    rate /= max(1, (x * x).sum(axis=1).mean())
    sig = lambda z: 1 / (1 + np.exp(-z))
    w, theta = np.zeros(x.shape[1]), np.linspace(-1, 1, n_grades - 1)
    for _ in range(steps):
        s = x @ w
        edges = np.concatenate([[-60.0], theta, [60.0]])
        up, low = sig(edges[grades + 1] - s), sig(edges[grades] - s)
        w = w + rate * x.T @ (up + low - 1) / len(rows)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        g = [(up * (1 - up) / (up - low))[grades == k].sum() - (low * (1 - low) / (up - low))[grades == k + 1].sum() for k in range(n_grades - 1)]
        theta = np.maximum.accumulate(theta + rate * np.array(g) / len(rows))
    return w, theta


def test_fit_is_slow_fit():
    """With enough steps the objective is as low, and the probabilities are those of the slow solution; the usual number
    of steps stops before, with smaller weights and the same order."""
    r = random.Random(4)
    rows, grades = [], []
    for _ in range(300):
        g = r.randrange(3)
        rows.append(np.unique([*r.sample(range(3, 40), 6), *([g] if r.random() < 0.7 else [])]))
        grades.append(g)
    grades = np.array(grades)
    for l1 in (2e-4, 5e-3):
        w, theta = slow_fit(rows, grades, 3, l1)
        padded = np.zeros(FEATURES + LEVELS * SHARES)
        padded[: len(w)] = w
        slow, m, early = Model(padded, theta), fit(rows, grades, 3, l1=l1, steps=20_000), fit(rows, grades, 3, l1=l1)
        cost = lambda z: loss(rows, grades, z) + l1 * np.abs(z.weights).sum()
        assert cost(m) <= cost(slow) + 2e-4
        s = lambda z: np.array([z.weights[x].sum() for x in rows])
        assert np.abs(m.tails(s(m)) - slow.tails(s(slow))).max() < 0.02
        assert cost(early) < cost(slow) + 0.1 and np.corrcoef(s(early), s(slow))[0, 1] > 0.98


def test_scores_are_slow_scores(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("good bad fine x !! THE".split()) for _ in range(r.randint(1, 40))) for _ in range(60)] + ["", None, "word%d " * 10]
    rows = [features(pa.array([t]))[0] for t in texts]
    m = fit(rows, np.array([k % 3 for k in range(len(rows))]), 3)
    got = {x.doc_id: x for x in score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    for k, x in enumerate(rows):
        p = [1 / (1 + math.exp(t - sum(float(m.weights[i]) for i in x))) for t in m.thresholds]
        assert abs(got[k].tail_probability - p[-1]) < 1e-9 and abs(got[k].expected_grade - sum(p)) < 1e-9


def test_bounds_of_the_labelled_sample(spark):
    """Repeated ids and very long texts: the bounds hold, and a row that is taken has all its features."""
    long = " ".join(f"w{i}" for i in range(400_000))
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(2000)] + [(7, long), (7, long)], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    rows, grades = labelled(docs, labels, grade_of_labels(), most=100)
    assert len(rows) == len(grades) == 100
    every = features(pa.array([long]))[0]
    rows, _ = labelled(docs.filter("doc_id = 7"), labels, grade_of_labels())
    assert [x.tolist() for x in rows] == [every.tolist()] * 2 and len(every) > 100_000
    rows, _ = labelled(docs, labels, grade_of_labels(), most_features=1000)
    assert 1 <= len(rows) < 1000 and sum(map(len, rows)) <= 1000
    m = fit(*labelled(docs, labels, grade_of_labels(), most=50), GRADES)
    p = {x.tail_probability for x in score(docs.filter("doc_id = 7"), m).collect()}
    assert len(p) == 1 and 0 < p.pop() < 1


def test_frame(spark):
    docs = spark.createDataFrame([(1, "good words here", "a"), (1, "good words here", "a"), (2, None, "b"), (None, "bad", "c"), (3, "", "d")], "doc_id long, text string, tail string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, 0), (None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows, grades = labelled(docs, labels, grade_of_labels())
    assert grades.tolist() == [0, 0, 1]  # the lowest of an id's grades, for each of its rows
    m = fit(rows, grades, GRADES)
    got = score(docs, m, keep=docs.columns)
    assert got.columns == ["doc_id", "tail", "text", "expected_grade", "tail_probability"]
    assert got.count() == 5 and got.filter("expected_grade < 0 or expected_grade > 2 or tail_probability is null").count() == 0
    empty = fit(*labelled(docs, labels.limit(0), grade_of_labels()), GRADES)
    assert np.allclose(empty.tails(np.zeros(1)), [[2 / 3, 1 / 3]])
    assert score(docs.limit(0), empty).count() == 0


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = fit(*labelled(docs.filter("doc_id % 4 <> 0"), labels, grade_of_labels()), GRADES)
    got = score(docs.filter("doc_id % 4 = 0"), m).join(labels, "doc_id").select(grade_of_labels().alias("g"), F.col("tail_probability") >= 0.5).toPandas()
    got.columns = ["g", "kept"]
    assert got[got.g == 2].kept.mean() > 0.99 and got[got.g < 2].kept.mean() < 0.06
    assert document_model(spark, "/root/testdata/sf0.001").thresholds.shape == (2,)


def test_columns_may_be_called_anything(spark):
    rows = [(1, "good words", 1, 2, 3, 4), (2, None, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c0 int, text_ int, features int, grade int")
    m = fit([], np.zeros(0, int), GRADES)
    got = score(docs, m, keep=docs.columns)
    assert got.columns == ["doc_id", "c0", "text_", "features", "grade", "text", "expected_grade", "tail_probability"]
    assert sorted(tuple(r)[1:5] for r in got.collect()) == [(1, 2, 3, 4)] * 2
    labels = spark.createDataFrame([(1, 1, 0, 9), (2, 0, 0, 9)], "doc_id long, quality int, toxic int, place int")
    rows, grades = labelled(docs.withColumnRenamed("c0", "place").withColumnRenamed("text_", "n"), labels, grade_of_labels())
    assert grades.tolist() == [2, 1] and len(rows) == 2
