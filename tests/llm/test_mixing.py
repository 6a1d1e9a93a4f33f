import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from sluice.llm import mixing
from sluice.llm.mixing import exact, in_order, mixed, phases, turns


@pytest.mark.parametrize("seed", range(30))
def test_period_deviates_by_less_than_one_block(seed):
    r = random.Random(seed)
    w = [r.randint(1, 40) for _ in range(r.randint(1, 12))]
    total, slots = sum(w), [[] for _ in w]
    for slot, i in enumerate(turns(w)):
        slots[i].append(slot)
    assert sorted(x for s in slots for x in s) == list(range(total))
    for wi, s in zip(w, slots, strict=True):
        for t in range(total + 1):
            assert abs(sum(x < t for x in s) - Fraction(wi * t, total)) < 1
        for j, x in enumerate(s):
            assert j * total // wi <= x < -(-(j + 1) * total // wi)


def slow_mix(blocks, weights):
    """Slot by slot: earliest deadline first among the released blocks of the sources that are left."""
    out, left, slot = [], dict(blocks), 0
    while any(left.values()):
        active = sorted((s for s in left if left[s]), key=lambda s: (s is not None, s))
        total, done, t = sum(weights[s] for s in active), dict.fromkeys(active, 0), 0
        while all(left[s] for s in active):
            ready = [s for s in active if done[s] * total // weights[s] <= t]
            s = min(ready, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), done[s] * total // weights[s], active.index(s)))
            out.append((slot, s, blocks[s] - left[s]))
            done[s] += 1
            left[s] -= 1
            t += 1
            slot += 1
    return out


def placed(plan, blocks):
    out = []
    for n, p in enumerate(plan):
        for s, j, slot in p.slots():
            upto = plan[n + 1].done.get(s, blocks[s]) if n + 1 < len(plan) else blocks[s]
            b, at = p.done[s] + j, p.start + slot
            while b < upto:
                out.append((at, s, b))
                b, at = b + p.share[s], at + p.length
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_phases_are_the_slow_schedule(seed):
    r = random.Random(seed)
    blocks = [r.choice([r.randint(0, 60), r.randint(0, 400)]) for _ in range(r.randint(1, 7))]
    weights = [r.choice([r.randint(1, 9), r.randint(1, 900)]) for _ in blocks]
    assert placed(phases(blocks, weights), blocks) == slow_mix(dict(enumerate(blocks)), dict(enumerate(weights)))


@pytest.mark.parametrize("weights", [[0.5, 0.3, 0.2], [10000, 1], [0.7, 0.2, 0.1], [1, 1e-9], [0.123456789, 0.3, 0.1 + 0.2], [Fraction(1, 3), Fraction(1, 7), 2]])
def test_exact_weights_over_many_blocks(weights):
    """Less than one block from the target at every slot, however the weights are written."""
    share = exact(dict(enumerate(weights)))
    given = [Fraction(repr(w)) if isinstance(w, float) else Fraction(w) for w in weights]
    assert [Fraction(x, sum(share.values())) for x in share.values()] == [w / sum(given) for w in given]
    (plan, *_) = phases([100_000] * len(weights), list(share.values()))
    once = list(plan.slots())
    n, done, slot, total = 100_000, [0] * len(weights), 0, sum(share.values())
    while slot < n:
        for s, _, _ in once:
            done[s] += 1
            slot += 1
            assert all(abs(done[i] * total - share[i] * slot) < total for i in range(len(weights)))
            if slot >= n or min(100_000 - x for x in done) == 0:
                return


def test_weights():
    assert exact({"a": 1, "b": 3}) == {"a": 1, "b": 3}
    assert exact({"a": 0.5, "b": 1.5}) == {"a": 1, "b": 3}
    for wrong in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            exact({"a": wrong, "b": 1})


def test_tables_that_are_not_broadcast(spark, monkeypatch):
    r = random.Random(4)
    df = spark.createDataFrame([(i, r.choice(["a", "a", "b", None])) for i in range(900)], "doc_id long, source string")
    weights = {"a": 0.123457, "b": 0.3}
    key = lambda x: (x.doc_id, x.source or "", x.block, x.offset, x.slot)
    want = sorted(map(key, mixed(df, weights, block_rows=8).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    assert sorted(map(key, mixed(df, weights, block_rows=8).collect())) == want
    with pytest.raises(ValueError, match="more than 2 sources"):
        mixed(df, weights, most_sources=2)


def test_frame(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", None]), i % 3) for i in range(3000)] + [(5, "a", 0)] * 3 + [(None, "a", 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot int").repartition(5)
    weights = {"a": 2, "b": 3}
    got = mixed(df, weights, block_rows=16).collect()
    assert Counter((x.doc_id, x.source) for x in got) == Counter((i, s) for i, s, _ in rows)
    by = defaultdict(list)
    for x in got:
        by[x.source].append((x.block, x.offset))
    for s, places in by.items():
        assert sorted(places) == [(k // 16, k % 16) for k in range(len(places))]
    blocks = {s: -(-len(p) // 16) for s, p in by.items()}
    assert sorted({(x.slot, x.source, x.block) for x in got}, key=lambda x: x[0]) == slow_mix(blocks, {"a": 2, "b": 3, "c": 1, None: 1})
    again = mixed(df.repartition(9), weights, block_rows=16).collect()
    key = lambda x: (x.doc_id or -1, x.source or "", x.block, x.offset, x.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixed(df.limit(0), weights).count() == 0
    out = in_order(df, weights, block_rows=16)
    assert out.columns == df.columns
    seen = {(x.doc_id, x.source): (x.slot, x.offset) for x in sorted(got, key=lambda x: (-x.slot, -x.offset))}
    order = [seen[x.doc_id, x.source] for x in out.collect()]
    assert len(order) == len(rows) and order == sorted(order)
