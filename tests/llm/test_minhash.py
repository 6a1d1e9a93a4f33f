import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import minhash
from sluice.llm.minhash import FEATURES, HASHES, RARE, frequencies, idf_of, jaccard, near_duplicates, samples, shingle_counts, weights


def slow_sets(texts, k=5):
    """Shingles as tuples of words, with counts."""
    out = []
    for t in texts:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        out.append(Counter([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []))
    return out


def slow_similar(texts):
    """Weighted Jaccard of all pairs, with the document frequencies of the shingles themselves."""
    sets = slow_sets(texts)
    df = Counter(s for x in sets for s in x)
    n = sum(t is not None for t in texts)
    weigh = [{s: (1 + math.log(c)) * min(1, math.log1p(n / df[s]) / math.log(1 + 1 / RARE)) for s, c in x.items()} for x in sets]

    def sim(a, b):
        low = sum(min(w, weigh[b].get(s, 0)) for s, w in weigh[a].items())
        total = sum(weigh[a].values()) + sum(weigh[b].values()) - low
        return low / total if total else 0.0

    return sim


def corpus(seed=1, groups=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijé") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    common = words(30)
    texts = []
    for _ in range(groups):
        base = words(r.randint(30, 300))
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            x = list(base)
            for _ in range(int(r.choice([0, 0.005, 0.01, 0.02, 0.04, 0.1]) * len(x)) + r.randint(0, 1)):
                x[r.randrange(len(x))] = r.choice(vocabulary)
            texts.append(r.choice([" ", "\n", ", "]).join(x))
        texts.append(" ".join(common + words(40)))
    hot = words(200)
    for _ in range(80):
        x = list(hot)
        for _ in range(r.randint(0, 6)):
            x[r.randrange(len(x))] = r.choice(vocabulary)
        texts.append(" ".join(x))
    return texts + [texts[0], texts[0].upper(), "one two", "One  TWO!", "one two three", "", "", "!!", "!!", "?!"]


def test_similarity_is_slow_similarity():
    t = corpus()
    sim = slow_similar(t)
    row, ids, _ = shingle_counts(pa.array(t))
    df = np.bincount(np.unique(row * FEATURES + (ids % np.uint64(FEATURES)).astype(np.int64)) % FEATURES, minlength=FEATURES)
    r = random.Random(2)
    pairs = [(a, b) for a in range(0, len(t)) for b in (a + 1, a + 2, r.randrange(len(t))) if b < len(t)]
    got = jaccard(pa.array([t[a] for a, _ in pairs]), pa.array([t[b] for _, b in pairs]), idf_of(df, len(t)))
    want = np.array([sim(a, b) for a, b in pairs])
    assert np.abs(got - want).max() < 0.01  # places of the frequency table are shared


def test_samples_agree_as_often_as_similar():
    r = np.random.RandomState(3)
    gaps = []
    for _ in range(40):
        n = 400
        ids = np.sort(r.randint(0, 1 << 47, n)).astype(np.uint64)
        a, b = r.uniform(0.2, 3, n), r.uniform(0.2, 3, n)
        b = np.where(r.uniform(size=n) < r.uniform(), a, b)
        x, y = (samples(np.zeros(n, np.int64), ids, w)[0] for w in (a, b))
        gaps.append((x == y).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.025 and np.std(gaps) < 1.5 * 0.5 / math.sqrt(HASHES)


def classes_of(n, link):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in link:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("block", [256, 8])
def test_classes(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    t = corpus()
    r = random.Random(4)
    ids = r.sample(range(10**6), len(t))
    df = spark.createDataFrame([(i, x, "s") for i, x in zip(ids, t, strict=True)], "doc_id long, text string, digest string").repartition(5)
    total = frequencies(df.select("text"))
    assert total[FEATURES] == len(t)
    idf = idf_of(total[:FEATURES], len(t))
    sim = [[0.0] * len(t) for _ in t]
    for a in range(len(t)):
        col = jaccard(pa.array([t[a]] * len(t)), pa.array(t), idf)
        sim[a] = col.tolist()
    sets = slow_sets(t)
    link = [(a, b) for a in range(len(t)) for b in range(a + 1, len(t)) if sim[a][b] >= 0.8 or not sets[a] and not sets[b] and t[a] == t[b]]
    want = classes_of(len(t), link)
    least = {}
    for i, c in zip(ids, want, strict=True):
        least[c] = min(i, least.get(c, i))
    got = {x.doc_id: x for x in near_duplicates(df).collect()}
    wrong = [i for i, c in zip(ids, want, strict=True) if got[i].class_id != least[c]]
    assert not wrong
    assert all(x.kept == (x.doc_id == x.class_id) for x in got.values())


def test_odd_rows(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "A b c d e f"), (7, None), (8, None), (None, None), (None, "x y"), (None, "x y")], "doc_id long, text string")
    got = near_duplicates(df).collect()
    assert sorted((x.doc_id or 0, x.class_id or 0, x.kept) for x in got) == [(0, 0, False), (0, 0, True), (0, 0, True), (0, 3, False), (3, 3, False), (3, 3, True), (7, 7, True), (8, 8, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_large_group_is_held_to_the_same(spark):
    """Members of a third of all rows, each pair a plain 0.82 to 0.88 alike, and the same of a small share."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))

    def member(base, at):
        x = list(base)
        for k in at:
            x[k] = word()
        return " ".join(x)

    def group(n):
        base = [word() for _ in range(340)]
        return [member(base, r.sample(range(5, 335, 6), 3)) for _ in range(n)]

    large, small = group(60), group(3)
    t = large + small + [" ".join(word() for _ in range(60)) for _ in range(117)]
    sets = [set(x) for x in slow_sets(t)]
    plain = [len(sets[0] & sets[i]) / len(sets[0] | sets[i]) for i in range(1, 60)]
    assert 0.8 <= min(plain) and sum(0.82 <= x <= 0.88 for x in plain) > 40
    sim = slow_similar(t)
    assert sum(sim(0, i) < 0.8 for i in range(1, 60)) > 40  # idf alone tells them apart
    got = {x.doc_id: x.class_id for x in near_duplicates(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)).collect()}
    assert {got[i] for i in range(60)} == {0} and {got[i] for i in range(60, 63)} == {60}
    assert all(got[i] == i for i in range(63, len(t)))


def test_recall_by_similarity(spark):
    """Of the whole sf0.01 table's pairs at 0.8 or more, by brute force, none is missed, nor are others linked."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    total = frequencies(docs.select("text"))
    row, ids, count = shingle_counts(pa.array([t for _, t in rows]))
    w = weights(ids, count, idf_of(total[:FEATURES], int(total[FEATURES])))
    first = np.searchsorted(row, np.arange(len(rows) + 1))
    sets = [dict(zip(ids[a:b].tolist(), w[a:b].tolist(), strict=True)) for a, b in zip(first, first[1:], strict=False)]
    where = {}
    for k, x in enumerate(sets):
        for s in x:
            where.setdefault(s, []).append(k)
    near = Counter((a, b) for own in where.values() for i, a in enumerate(own) for b in own[i + 1 :])
    bins, link = Counter(), []
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    for (a, b), n in near.items():
        if n * 2 < min(len(sets[a]), len(sets[b])):
            continue
        low = sum(min(v, sets[b][s]) for s, v in sets[a].items() if s in sets[b])
        sim = low / (sum(sets[a].values()) + sum(sets[b].values()) - low)
        if sim >= 0.8:
            link.append((a, b))
            bins[round(sim * 20) / 20, got[rows[a][0]] == got[rows[b][0]]] += 1
    assert sum(n for (_, ok), n in bins.items() if ok) > 100 and not any(n for (_, ok), n in bins.items() if not ok), bins
    for k, c in enumerate(classes_of(len(rows), link)):
        if sets[k]:
            assert got[rows[k][0]] == rows[c][0]


def test_very_long_texts(spark):
    """Texts of many thousand shingles fill all places of the frequency table: their shingles still weigh what
    rare ones do, and near copies are found."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(5000)]
    t = [" ".join(r.choice(vocabulary) for _ in range(30_000)) for _ in range(8)]
    words = t[0].split()
    for k in r.sample(range(len(words)), 300):
        words[k] = "other"
    t += [" ".join(words), " ".join(words[:15_000]), " ".join(r.choice(vocabulary) for _ in range(400_000))]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)
    total = frequencies(df.select("text"))
    assert np.median(idf_of(total[:FEATURES], int(total[FEATURES]))) == idf_of(np.ones(1), int(total[FEATURES]))[0]
    got = {x.doc_id: x.class_id for x in near_duplicates(df).collect()}
    assert got == {**{i: i for i in range(len(t))}, 8: 0}


def test_ties_of_the_least_id(spark):
    """Equal ids with different near copies: one row of the class is kept."""
    base = "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3
    words = " ".join(f"v{i}" for i in range(60))
    rows = [(1, words), (1, words + " x"), (1, words), (2, words), (3, base), (3, base)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.class_id) for x in got) == [(1, 1)] * 3 + [(2, 1), (3, 3), (3, 3)]
    assert sum(x.kept for x in got if x.class_id == 1) == 1 == sum(x.kept for x in got if x.class_id == 3)
