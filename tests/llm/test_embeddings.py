import math
import random

import numpy as np
from pyspark.sql import functions as F

from sluice.llm.components import components
from sluice.llm.embeddings import Forest, block, codes, meet, near, near_bits, plan, sketches, unit, with_company


def slow_components(nodes, edges):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(5, 5), (None, 3), (3, None), (0, 1)]
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == slow_components({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plan():
    assert abs(meet(1e-6) - 1) < 1e-5 and meet(0.3) > meet(0.4) > meet(1.4) > 0
    for n in (0, 1, 1000, 10**6, 10**10):
        k, t = plan(n, 0.95)
        assert 1 - (1 - meet(math.sqrt(0.1)) ** k) ** t >= 0.9999


def test_near(spark):
    r = np.random.RandomState(3)
    rows = []
    for g in range(40):
        base = r.normal(size=16)
        for _ in range(r.randint(1, 12)):
            rows.append((base + r.normal(size=16) * r.choice([0, 0.1, 0.2, 0.3])) * r.choice([1, 7]))
    hot = r.normal(size=16)
    rows += [hot] * 30 + [hot + r.normal(size=16) * 0.05 for _ in range(600)]
    rows = [list(map(float, x)) for x in rows]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15]
    full = list(enumerate(rows + odd + [[1.0, 2.0], [2.0, 4.0]]))
    ids = list(range(0, 5 * len(full), 5))
    r.shuffle(ids)
    data = [(ids[i], x, 1) for i, x in full]
    ok = [(i, x) for i, x, _ in data if x and all(y is not None and math.isfinite(y) for y in x) and any(x)]
    want, edges = {i: 0 for i, _, _ in data}, []
    for m in (2, 16):
        own = [(i, x) for i, x in ok if len(x) == m]
        u = np.array([x for _, x in own])
        u = u / np.linalg.norm(u, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.95, 1)), strict=True):
            edges.append((own[a][0], own[b][0]))
            want[own[a][0]] += 1
            want[own[b][0]] += 1
    comp = slow_components(set(want), edges)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n int").repartition(5)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near(df).collect()}
    assert got == {i: (want[i], comp[i], comp[i] == i) for i in want}
    assert near(df.limit(0)).count() == 0
    floats = df.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    links = {x.vec_id: x.n_links for x in near(floats).collect()}
    assert sum(links[i] != want[i] for i in want) <= 2  # rounding of the input moves few pairs over the threshold
    twice = near(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((x.vec_id or 0, x.n_links, x.component_id, x.kept) for x in twice) == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]


def test_block_counts_a_pair_once():
    """Over the tables, each link that some table has counts in the first; blocks of one part and of two."""
    r = np.random.RandomState(4)
    base = r.normal(size=(30, 24))
    x = unit(np.repeat(base, 20, axis=0) + r.normal(size=(600, 24)) * 0.18)
    k, tables, n = 3, 6, len(x)
    code = codes(x, k, tables, 8)
    assert (codes(x, k, tables, 8, 4) == code[:, 4:]).all()
    count, part = r.randint(1, 4, n), r.randint(0, 2, n)
    close = np.triu(x @ x.T >= 0.9, 1)
    for across in (False, True):
        got = np.zeros(n, np.int64)
        want = np.zeros(n, np.int64)
        for t in range(tables):
            for c in np.unique(code[:, t]):
                of = np.flatnonzero(code[:, t] == c)
                links, root = block(t, count[of], part[of], x[of], k, 8, 0.9, across)
                got[of] += links
                assert (root[links == 0] == np.flatnonzero(links == 0)).all()
        for i, j in zip(*np.nonzero(close), strict=True):
            if (code[i] == code[j]).any() and not (across and part[i] == part[j]):
                want[i] += count[j]
                want[j] += count[i]
        assert (got == want).all() and want.sum() > 1000


def test_forest():
    r = random.Random(2)
    for _ in range(20):
        edges = [(r.randrange(60), r.randrange(60)) for _ in range(r.randint(0, 70))]
        f = Forest(60)
        for at in range(0, len(edges), 7):
            i, j = zip(*edges[at : at + 7], strict=True)
            f.link(np.array(i), np.array(j))
        assert dict(enumerate(f.root.tolist())) == slow_components(range(60), edges)


def test_sketches_of_near_pairs():
    """Pairs at the threshold stay in reach, unrelated ones hardly do; rows with company are those of all pairs."""
    r = np.random.RandomState(9)
    x = unit(r.normal(size=(4000, 48)))
    side = unit(r.normal(size=(4000, 48)))
    side = unit(side - (side * x).sum(axis=1)[:, None] * x)
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * side
    bits = lambda a, b: np.array([bin(int(p)).count("1") for p in (sketches(a, 8).view(np.uint64) ^ sketches(b, 8).view(np.uint64)).reshape(-1)]).reshape(-1, 2).sum(axis=1)
    assert bits(x, y).max() <= near_bits(0.95) < bits(x, side).min() + 20 and (bits(x, side) <= near_bits(0.95)).mean() < 0.01
    part = r.randint(0, 2, 700)
    some = sketches(unit(np.repeat(r.normal(size=(500, 48)), 2, axis=0)[:700] + r.normal(size=(700, 48)) * r.choice([0.1, 3], (700, 1))), 8)
    for across in (False, True):
        want = np.zeros(700, bool)
        for i in range(700):
            for j in range(700):
                if i != j and not (across and part[i] == part[j]) and sum(bin(int(p)).count("1") for p in some[i].view(np.uint64) ^ some[j].view(np.uint64)) <= 34:
                    want[i] = True
        assert (with_company(some, part, 34, across) == want).all() and 0 < want.sum() < 700


def test_zeros_of_either_sign(spark):
    for kind in ("double", "float"):
        df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [1.0, -0.0])], f"vec_id long, embedding array<{kind}>")
        assert sorted((x.vec_id, x.n_links, x.component_id) for x in near(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
