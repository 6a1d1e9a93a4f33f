"""Columns, joins and the plain evaluator agree."""

import json
import random

import pytest
from pyspark.sql import functions as F

from slow import tree
from sluice.engine import Percolator
from sluice.plans.language import Reader

SEED = b"0" * 32
R = random.Random(11)
POINTS = [[43.6, 3.9], "43.61, 3.89", "spfb09x0ud5s", {"lat": 43.6, "lon": "3.9"}, {"latLon": [43.5, 3.8]}, {"lat_lon": {"lat": 10, "lon": 179.9}}, {"latLon": "spfb"}, [1], "abc", 0, "", None, {"lat": 1}, 12, [43.6, 3.9, 1], {"latLon": "1, x"}]
SCALARS = ["a", "b", "10", "", "é", 0, 1, 10, 2.5, -3, 1e20, True, False, None]


def scalar():
    return R.choice(SCALARS)


def document():
    d = {}
    for name in ("a", "b", "c"):
        if R.random() < 0.7:
            d[name] = R.choice([scalar, scalar, lambda: [scalar() for _ in range(R.randint(0, 4))], lambda: {"x": scalar(), "y": [scalar()]}, lambda: [{"x": scalar(), "k": R.randint(0, 2)} for _ in range(R.randint(0, 3))]])()
    if R.random() < 0.8:
        d["p"] = R.choice([*POINTS, [R.uniform(-60, 60), R.uniform(-180, 180)], [43.6 + R.uniform(-0.1, 0.1), 3.9 + R.uniform(-0.1, 0.1)]])
    if R.random() < 0.2:
        d["a.x"] = scalar()
    return d


def atom(deep=True):
    f = R.choice(["a", "b", "c", "a.x", "b.y", "missing"])
    low = R.choice([-5, 0, 1, 2.5, 9])
    kinds = [
        lambda: {"equals": {f: scalar()}},
        lambda: {"in": {f: ["a", "b", "é"][: R.randint(1, 3)]}},
        lambda: {"range": {f: R.choice([{"gt": low}, {"gte": low, "lt": low + R.choice([1, 7])}, {"lte": low}, {"gt": low, "lte": low + 3}])}},
        lambda: {"regexp": {f: R.choice(["^a", "a$", "1", ".", {"value": "A|É", "flags": "i"}])}},
        lambda: {"exists": f},
        lambda: {"exists": f"{f}[{json.dumps(scalar())}]"},
        lambda: {"missing": f},
        lambda: {"missing": f"{f}[{json.dumps(scalar())}]"},
        lambda: {"match": {R.choice(["a", "b", "a.x"]): R.choice([scalar(), {"x": scalar()}, [scalar()], [scalar(), scalar()], [{"k": 1}], [{"k": 1}, {"k": 1}, {}], {"y": [scalar()]}, {}])}},
        lambda: {"geoBoundingBox": {"p": {"top": 43.65, "left": 3.85, "bottom": 43.55, "right": R.choice([3.95, "3.9"])}}},
        lambda: {"geoDistance": {"p": {"lat": 43.6, "lon": 3.9}, "distance": R.choice(["1km", "9 km", "3000mi"])}},
        lambda: {"geoDistanceRange": {"p": "43.6,3.9", "from": "2 km", "to": "8km"}},
        lambda: {"geoPolygon": {"p": {"points": [[43.5, 3.8], [43.7, 3.8], {"lat": 43.65, "lon": 4}, [43.6, 3.9]]}}},
        lambda: {"nothing": None},
    ]
    if deep:
        kinds.append(lambda: {"select": {"field": f, "index": R.choice([0, 1, -1, -2]), "query": R.choice([{"equals": {"value": scalar()}}, {"exists": "value.x"}, {"not": {"equals": {"value.k": 1}}}, {"or": [{"range": {"value": {"gt": 0}}}, {"equals": {"value": "a"}}]}])}})
    return R.choice(kinds)()


def filters(depth=2):
    if depth == 0 or R.random() < 0.4:
        return atom()
    some = [filters(depth - 1) for _ in range(R.randint(1, 3))]
    return R.choice([{"and": some}, {"or": some}, {"not": some[0]}, {"bool": {"must": some, "must_not": [atom()]}}, {"bool": {"should": some, "should_not": [atom(), atom()]}}])


@pytest.mark.parametrize("mode", ["expression", "join"])
def test_variants(spark, mode):
    R.seed(12)
    docs = [document() for _ in range(160)]
    engine = Percolator(spark, seed=SEED, regexp_engine="js", prune="sound", max_conditions=0)
    given = {}
    for f in [{}, *[filters() for _ in range(70 if mode == "expression" else 14)]]:
        given[engine.register(f)] = f
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, json string").select("id", F.parse_json("json").alias("doc")).repartition(4)
    got = {(r.id, r.filter_id) for r in engine.percolate(df, ["id"], doc="doc", mode=mode).collect()}
    wrong = []
    for key, f in given.items():
        t = Reader("js").read(f)
        for i, d in enumerate(docs):
            if tree(t, d) != ((i, key) in got):
                wrong.append((f, d, tree(t, d)))
    assert not wrong, (len(wrong), wrong[:3])


@pytest.mark.parametrize("mode", ["expression", "join", "auto"])
def test_typed_rows(spark, mode):
    R.seed(13)
    rows = [(i, R.choice(["x", "y", "z", None, ""]), R.choice([None, R.randint(-5, 20)]), R.choice([None, R.uniform(-5, 2000), float("nan")]), R.choice([None, True, False]), R.choice([None, ["a", "b"], ["c", None, "a", "a"], []]), R.choice([None, (R.uniform(-90, 90), R.uniform(-180, 180))]), R.choice([None, (None, 3), ("u", 1)])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, s string, n int, v double, b boolean, l array<string>, p struct<lat:double,lon:double>, o struct<t:string,`k.z`:int>").repartition(3)
    engine = Percolator(spark, seed=SEED, max_conditions=0)
    given = {}
    for i in range(45):
        low, lat, lon = R.uniform(-100, 1500), R.uniform(-80, 80), R.uniform(-180, 180)
        for f in (
            {"and": [{"equals": {"s": R.choice("xyzw")}}, {"range": {"v": {"gte": low, "lt": low + R.choice([1, 100, 600])}}}]},
            {"or": [{"range": {"n": {"gt": i - 10}}}, {"equals": {"n": i}}]},
            {"and": [{"exists": f'l["{R.choice("abcd")}"]'}, {"not": {"equals": {"n": i}}}]},
            {"geoDistance": {"p": [lat, lon], "distance": f"{R.choice([10, 900, 7000, 15000])} km"}},
            {"geoBoundingBox": {"p": {"top": lat + 9, "left": lon, "bottom": lat, "right": lon + 30}}},
            {"geoPolygon": {"p": {"points": [[lat, lon], [lat + 20, lon], [lat + 20, lon + 30], [lat + 5, lon + 10]]}}},
            {"and": [{"equals": {"o.t": "u"}}, {"regexp": {"s": f"^[x{'yz'[i % 2]}]"}}, {"missing": "b"}]},
            {"not": {"range": {"v": {"lte": low}}}},
            {"equals": {"b": i % 2 == 0}},
        ):
            given[engine.register(f)] = f
    got = [(r.id, r.filter_id) for r in engine.percolate(df, ["id"], mode=mode).collect()]
    assert len(got) == len(set(got))
    want = set()
    for i, s, n, v, b, items, p, o in rows:
        d = {"s": s, "n": n, "v": v, "b": b, "p": p and {"lat": p[0], "lon": p[1]}, "o": o and {"t": o[0], "k.z": o[1]}}
        d = {k: ({a: c for a, c in x.items() if c is not None} if isinstance(x, dict) else x) for k, x in d.items() if x is not None}
        if items is not None:
            d["l"] = items
        want |= {(i, key) for key, f in given.items() if tree(Reader().read(f), d)}
    assert set(got) == want


def test_stream(spark, tmp_path):
    from sluice.streaming.stream import percolate_batches, percolate_stream

    spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string").write.parquet(str(tmp_path / "in"))
    engine = Percolator(spark, seed=SEED)
    one, two = engine.register({"equals": {"s": "a"}}), engine.register({"not": {"equals": {"s": "a"}}})
    rows = spark.readStream.schema("id long, s string").parquet(str(tmp_path / "in"))
    q = percolate_stream(engine, rows, ["id"]).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.filter_id) for r in spark.table("hits").collect()} == {(1, one), (2, two)}
    seen = []
    q = percolate_batches(engine, rows, ["id"], lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.filter_id) for r in seen} == {(1, one), (2, two)}


@pytest.mark.parametrize("mode", ["expression", "join", "auto"])
def test_infinite_values(spark, mode):
    rows = [(0, float("inf")), (1, float("-inf")), (2, float("nan")), (3, None), (4, 7.0), (5, 1e300)]
    df = spark.createDataFrame(rows, "id long, v double")
    engine = Percolator(spark, seed=SEED)
    given = {}
    for i in range(45):
        for f in ({"gt": i}, {"lte": -i}, {"gte": i, "lt": i + 3}):
            given[engine.register({"range": {"v": f}})] = f
    ops = {"gt": lambda v, x: v > x, "gte": lambda v, x: v >= x, "lt": lambda v, x: v < x, "lte": lambda v, x: v <= x}
    got = sorted((r.id, r.filter_id) for r in engine.percolate(df, ["id"], mode=mode).collect())
    assert got == sorted((i, key) for i, v in rows if v is not None for key, f in given.items() if all(ops[k](v, x) for k, x in f.items()))


@pytest.mark.parametrize("mode", ["expression", "join", "auto"])
def test_rows_with_equal_keys_have_hits_of_their_own(spark, mode):
    """Whatever else is registered: an or whose terms both hold is met once a row, and another filter's hits stay."""
    df = spark.createDataFrame([(1, "a", 5.0), (1, "a", 5.0), (1, "b", 50.0), (None, "a", 5.0)], "id long, s string, v double")
    engine = Percolator(spark, seed=SEED)
    plain = [engine.register({"equals": {"s": f"{c}"}}) for c in ("a", *map(str, range(60)))][0]
    before = [(r.id, r.filter_id) for r in engine.percolate(df, ["id"], mode=mode).collect()]
    assert sorted(before, key=str) == sorted([(1, plain), (1, plain), (None, plain)], key=str)
    both = [engine.register({"or": [{"equals": {"s": "a"}}, {"range": {"v": {"gte": 0, "lt": 10 + k}}}, {"range": {"v": {"gt": 40}}}]}) for k in range(50)]
    after = [(r.id, r.filter_id) for r in engine.percolate(df, ["id"], mode=mode).collect()]
    assert sorted(x for x in map(str, after) if plain in x) == sorted(map(str, before))
    for f in both:
        assert sorted(str(i) for i, x in after if x == f) == ["1", "1", "1", "None"]


def test_one_pass_and_no_distinct(spark, tmp_path):
    """Thousands of filters of many kinds: one scan, no aggregate; as a stream, no state."""
    from sluice.streaming.stream import percolate_stream

    df = spark.createDataFrame([(i, f"word{i}", float(i)) for i in range(50)], "id long, s string, v double")
    df.write.parquet(str(tmp_path / "in"))
    engine = Percolator(spark, seed=SEED)
    for i in range(300):
        engine.register({"regexp": {"s": f"^word{i}$"}})
        engine.register({"or": [{"range": {"v": {"gt": i}}}, {"equals": {"s": f"word{i}"}}]})
        engine.register({"not": {"equals": {"s": f"word{i}"}}})
        engine.register({"regexp": {"s": f"w.*{i}|x"}})
    out = engine.percolate(spark.read.parquet(str(tmp_path / "in")), ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Aggregate" not in plan
    got = [(r.id, r.filter_id) for r in out.collect()]
    assert len(got) == len(set(got))
    rows = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream = percolate_stream(engine, rows, ["id"])
    assert "Deduplicate" not in (text := stream._jdf.queryExecution().analyzed().toString()) and "Distinct" not in text and "Aggregate" not in text
    assert sorted(got) == sorted((r.id, r.filter_id) for r in engine.percolate(df, ["id"], mode="expression").collect())


@pytest.mark.parametrize("broadcast", [200_000, 100])
def test_patterns_and_paths_are_found(spark, monkeypatch, broadcast):
    """Relations that are broadcast and such that are not; groups beside expressions."""
    from sluice.operators import percolate

    monkeypatch.setattr(percolate, "BROADCAST_ROWS", broadcast)
    R.seed(14)
    names = ["alpha", "beta", "gamma", "a.b", "deep"]
    docs = []
    for _ in range(80):
        d = {n: R.choice([1, "x", None, {"x": 1, "y.z": {"k": None}, "w": [1]}, [], {}]) for n in names if R.random() < 0.6}
        if R.random() < 0.5:
            d["a"] = {"b": R.choice([{"c": 1}, 2])}
        docs.append(d | {"text": R.choice(["", "the cat sat", "été cats", "abcabc", "1.5 (x)", "a+b", "cat\ncot"])})
    fields = [*names, *[f"{n}.{m}" for n in names for m in ("x", "y.z", "y.z.k", "y", "w", "none")], "a", "a.b.c", "it's", *[f"f{i}" for i in range(60)]]
    patterns = ["cat", "c[ao]t", r"1\.5", r"\(x\)", "^the cat", "abc+a", "a.?bca", "cats?", r"a\+b", "(abc){2}", "cat$", "abca?b", "bc{1}a", *[f"zzz{i}" for i in range(60)]]
    engine = Percolator(spark, seed=SEED, max_conditions=0)
    given = {engine.register(f): f for f in [{"exists": x} for x in fields] + [{"regexp": {"text": x}} for x in patterns] + [{"missing": "alpha"}, {"equals": {"gamma": 1}}]}
    given |= {engine.register(f): f for i in range(50) for f in ({"or": [{"exists": fields[i]}, {"equals": {"gamma": i}}]}, {"and": [{"exists": fields[i]}, {"range": {"gamma": {"lt": i}}}]})}
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, "[1]"), (-2, "null")], "id long, json string").select("id", F.parse_json("json").alias("doc"))
    got = sorted((r.id, r.filter_id) for r in engine.percolate(df, ["id"], doc="doc").collect() if r.id >= 0)
    assert got == sorted((i, key) for i, d in enumerate(docs) for key, f in given.items() if tree(Reader().read(f), d))
    assert got == sorted((r.id, r.filter_id) for r in engine.percolate(df, ["id"], doc="doc", mode="expression").collect() if r.id >= 0)


def test_required_is_in_every_match():
    """Of random patterns and strings: a match holds the string that is said to be required."""
    import re

    from sluice.operators.percolate import required

    R.seed(15)
    parts = ["abc", "b", "c+", "d*", "e?", "x{0,2}", "y{2}", ".", "[abc]", "[^a-]", r"\.", r"\d", "(ab)", "(ab)?", "(a|b)", "^", "$", r"\\", "é", "[]a]", r"[\]b]", r"\x41bc", r"\u0041", "a+?", "b{1,}?", "{x}"]
    seen = 0
    for _ in range(3000):
        p = "".join(R.choice(parts) for _ in range(R.randint(1, 6)))
        try:
            found = re.compile(p)
        except re.error:
            continue
        must = required(p, "")
        for _ in range(12):
            text = "".join(R.choice("abcdexy.1é\\") for _ in range(R.randint(1, 12)))
            if m := found.search(text):
                assert must in m[0], (p, text, must)
                seen += bool(must)
    assert seen > 1000 and required("abc", "i") == "" == required("abc|d", "") and required("xabcd+e", "") == "xabcd"


def test_open_ranges_read_their_own_hits(spark):
    """Ten thousand bounds that no row reaches: no candidate; ties, infinite and missing values."""
    engine = Percolator(spark, seed=SEED)
    for i in range(10_000):
        engine.register({"range": {"v": {"gt": 1000 + i}}})
    top = engine.register({"range": {"v": {"gte": 7}}})
    low = engine.register({"range": {"v": {"lt": 7}}})
    for i in range(60):
        engine.register({"range": {"v": {"lte": -1000 - i}}})
    df = spark.createDataFrame([(0, 7.0), (1, 6.5), (2, None), (3, float("nan")), (4, 900.0)], "id long, v double")
    assert sorted((r.id, r.filter_id) for r in engine.percolate(df, ["id"]).collect()) == sorted([(0, top), (1, low), (4, top)])
    every = engine.percolate(spark.createDataFrame([(1, float("inf"))], "id long, v double"), ["id"])
    assert every.count() == 10_001


def test_keys_with_dots_in_typed_rows(spark):
    df = spark.createDataFrame([(1, ((7,), 8), {"x": "1", "y.z": "2"}, {"u": {"v": "3"}}, "{\"k.l\": {\"m\": 1}}")], "id long, o struct<`k.z`:struct<a:int>,b:int>, m map<string,string>, n map<string,map<string,string>>, j string")
    df = df.withColumn("doc", F.parse_json("j"))
    engine = Percolator(spark, seed=SEED)
    hits = {"o.k.z.a": 7, "o.b": 8, "m.x": "1", "m.y.z": "2", "n.u.v": "3", "doc.k.l.m": 1}
    want = {engine.register({"equals": {k: v}}) for k, v in hits.items()}
    for k in ("o.k", "o.k.z.b", "m.y", "n.u.w", "n.v", "doc.k", "o.k.z.a.q", "doc.k.l.n"):
        engine.register({"exists": k})
    assert {r.filter_id for r in engine.percolate(df, ["id"]).collect()} == want


def test_filters_registered_between_calls_count(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    engine = Percolator(spark, seed=SEED)
    find = lambda: sorted((r.id, r.filter_id) for r in engine.percolate(df, ["id"]).collect())
    one = engine.register({"equals": {"s": "a"}})
    assert find() == find() == [(1, one)]
    other = engine.register({"equals": {"s": "a"}}, "named")
    two = engine.register({"not": {"equals": {"s": "a"}}})
    assert find() == [(1, one), (2, two)]
    engine.remove(one)
    assert find() == [(2, two)] and [r.filter_id for r in engine.percolate(df, ["id"], index="named").collect()] == [other]


def test_points_of_texts_are_parsed_once_a_row(spark):
    """However many filters ask for them, and geohashes of any length as by the driver's parser."""
    from sluice.functions.geo import convert_geopoint, point_of_string

    R.seed(17)
    texts = ["".join(R.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(R.randint(4, 30))) for _ in range(300)]
    texts += ["0000", "zzzz", "z" * 12, "0" * 12, "z" * 13, "aaaa", "spfb\n", "7ilo", "abc", "", "SPFB", "spfb ", "43.6, 3.9", "1,x", "1,2,3", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, p string").repartition(3)
    for r in df.select("p", point_of_string(F.col("p")).alias("found")).collect():
        want = convert_geopoint(r.p)
        assert (r.found is None) == (want is None), r.p
        assert want is None or max(abs(r.found.lat - want[0]), abs(r.found.lon - want[1])) < 1e-12, r.p
    engine = Percolator(spark, seed=SEED)
    given = {}
    for f in ({"geoDistance": {"p": [43.6, 3.9], "distance": "4000 km"}}, {"geoBoundingBox": {"p": {"top": 60, "left": -90, "bottom": -30, "right": 20}}}):
        given |= {engine.register(x): x for x in (f, {"not": f})}
    out = engine.percolate(df, ["id"])
    assert out._jdf.queryExecution().executedPlan().toString().count("RLIKE") == 1
    want = {(i, key) for i, t in enumerate(texts) for key, f in given.items() if tree(Reader().read(f), {} if t is None else {"p": t})}
    assert {(r.id, r.filter_id) for r in out.collect()} == want
    wide = df.select("id", F.struct(F.col("p").alias("latLon")).alias("p"))
    assert {(r.id, r.filter_id) for r in engine.percolate(wide, ["id"], mode="join").collect()} == {(i, key) for i, t in enumerate(texts) for key, f in given.items() if tree(Reader().read(f), {"p": {} if t is None else {"latLon": t}})}


def test_ranges_with_one_bound_alone_are_neither_joined_nor_tested(spark, tmp_path):
    """The same hits as by expressions: of typed rows, documents and a stream; ties, repeated keys, any ids."""
    from sluice.streaming.stream import percolate_stream

    inf = float("inf")
    rows = [(i // 2, v, n) for i, (v, n) in enumerate([(0.0, 1), (-0.0, 1), (7.0, None), (7.0, 3), (6.999999999999999, 7), (7.000000000000001, -7), (None, 9), (float("nan"), 7), (inf, 8), (-inf, 0), (5e-324, 2), (-5e-324, 2), (12.5, 12), (100.0, 100)])]
    df = spark.createDataFrame(rows, "id long, v double, n int").repartition(1)
    engine = Percolator(spark, seed=SEED)
    given = {}
    for i in range(45):
        for f in ({"v": {"gt": i}}, {"v": {"gte": i}}, {"v": {"lt": i}}, {"v": {"lte": -i}}, {"n": {"gte": i + 0.5}}, {"n": {"lt": i}}, {"gone": {"gt": i}}):
            given[engine.register({"range": f})] = f
    for f in ({"v": {"gt": inf}}, {"v": {"gte": inf}}, {"v": {"lt": -inf}}, {"v": {"lte": -inf}}, {"v": {"gt": -inf}}):
        given[engine.register({"range": f})] = f
    names = {x: f"{x},'\"\\{i}é" for i, x in enumerate(given)}
    ops = {"gt": lambda v, x: v > x, "gte": lambda v, x: v >= x, "lt": lambda v, x: v < x, "lte": lambda v, x: v <= x}
    want = sorted((i, names[x]) for i, v, n in rows for x, f in given.items() for name, b in f.items() for k, bound in b.items() if (value := {"v": v, "n": n}.get(name)) is not None and ops[k](value, bound))
    out = engine.percolate(df, ["id"], names=names)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and f"RoundRobinPartitioning({spark.conf.get('spark.sql.shuffle.partitions')})" in plan
    found = lambda out: sorted((r.id, r.filter_id) for r in out.collect())
    assert found(out) == want == found(engine.percolate(df, ["id"], names=names, mode="expression"))
    docs = df.filter("abs(v) < 1000").select("id", F.parse_json(F.to_json(F.struct("v", "n"))).alias("doc"))
    assert found(engine.percolate(docs, ["id"], doc="doc")) == found(engine.percolate(docs, ["id"], doc="doc", mode="expression")) != []
    df.write.parquet(str(tmp_path / "in"))
    stream = percolate_stream(engine, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["id"])
    q = stream.writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.id, names[r.filter_id]) for r in spark.table("runs").collect()) == want
    assert engine.percolate(df.filter("v = 12.5"), ["id"]).count() == 13 + 13 + 32 + 12 + 32 + 1
    none = Percolator(spark, seed=SEED)
    none.register({"range": {"v": {"gt": inf}}})
    assert none.percolate(df, ["id"], mode="join").count() == 0
