"""Validation, normal form, ids and the registry; no rows but in the last tests."""

import random

import pytest

from slow import tree
from sluice.engine import FilterError, Percolator
from sluice.functions.geo import convert_distance, convert_geopoint
from sluice.functions.regex import java_pattern
from sluice.plans.language import EVERYTHING, NOTHING, All, Any_, Reader, literal
from sluice.plans.normal import contradictory, normal

SEED = bytes(32)
box = {"top": 1, "left": 0, "bottom": 0, "right": 1}
point = {"lat": 1, "lon": 2}

REJECTED = [
    ({"equals": {}}, "equals", "equals", "expected object to have exactly 1 property, got 0"),
    ({"equals": {"a": 1, "b": 2}}, "equals", "equals", "expected object to have exactly 1 property, got 2"),
    ({"equals": {"a": [1]}}, "equals", "equals.a", "must either be a string, a number, a boolean, or null"),
    ({"equals": ["a"]}, "equals", "equals", "must be an object"),
    ({"a": 1, "b": 2}, "a,b", None, "Invalid filter syntax. Filters must have one keyword only"),
    ({"equal": {"a": 1}}, "equal", "equal", "unknown keyword"),
    ({"and": [{"foo": 1}]}, "foo", "and.foo", "unknown keyword"),
    ({"exists": ""}, "exists", "exists", "cannot test empty field name"),
    ({"exists": {}}, "exists", "exists", "expected object to have exactly 1 property, got 0"),
    ({"exists": {"other": "a"}}, "exists", "exists", 'the property "field" is missing'),
    ({"exists": {"field": ""}}, "exists", "exists.field", "cannot be empty"),
    ({"exists": {"field": 3}}, "exists", "exists.field", "must be a string"),
    ({"exists": "a[b]"}, "exists", "exists", 'contains an invalid array value ("b")'),
    ({"missing": "a['b']"}, "missing", "missing", "contains an invalid array value (\"'b'\")"),
    ({"ids": {}}, "ids", "ids", "expected object to have exactly 1 property, got 0"),
    ({"ids": {"x": []}}, "ids", "ids", 'the property "values" is missing'),
    ({"ids": {"values": "a"}}, "ids", "ids.values", "must be an array"),
    ({"ids": {"values": []}}, "ids", "ids.values", "cannot be empty"),
    ({"in": {"a": [1]}}, "in", "in.a", 'must hold only values of type "string"'),
    ({"in": {"a": []}}, "in", "in.a", "cannot be empty"),
    ({"range": {"a": {}}}, "range", "range.a", "must be a non-empty object"),
    ({"range": {"a": {"gt": "1"}}}, "range", "range.a.gt", "must be a number"),
    ({"range": {"a": {"gt": 1, "x": 2}}}, "range", "range.a", '"x" is not an allowed attribute (allowed: gt,gte,lt,lte)'),
    ({"range": {"a": {"gt": 1, "gte": 2}}}, "range", "range.a", "only 1 lower boundary allowed"),
    ({"range": {"a": {"lt": 1, "lte": 2}}}, "range", "range.a", "only 1 upper boundary allowed"),
    ({"range": {"a": {"gte": 5, "lte": 5}}}, "range", "range.a", "lower boundary must be strictly inferior to the upper one"),
    ({"regexp": {"a": 3}}, "regexp", "regexp.a", "must be either a string or a non-empty object"),
    ({"regexp": {"a": {"flags": "i"}}}, "regexp", "regexp.a", 'the property "value" is missing'),
    ({"regexp": {"a": {"value": "a", "flags": 3}}}, "regexp", "regexp.a.flags", "must be a string"),
    ({"match": {}}, "match", "match", "must be a non-empty object"),
    ({"select": {"field": "a", "index": 0}}, "select", "select", "expected object to have exactly 3 properties, got 2"),
    ({"select": {"field": "a", "index": 0.5, "query": {"exists": "b"}}}, "select", "select.index", "cannot have decimals, must be an integer"),
    ({"select": {"field": "a", "index": "0", "query": {"exists": "b"}}}, "select", "select.index", "must be an integer"),
    ({"select": {"field": "a", "index": 0, "query": {}}}, "select", "select.query", "must be a non-empty object"),
    ({"select": {"field": "a", "index": 0, "query": {"foo": 1}}}, "foo", "select.query.foo", "unknown keyword"),
    ({"geoBoundingBox": {"p": {"top": "x", "left": 0, "bottom": 0, "right": 1}}}, "geoBoundingBox", "geoBoundingBox.p", 'unrecognized geoBoundingBox format: {"top":"x","left":0,"bottom":0,"right":1}'),
    ({"geoBoundingBox": {"p": {"topLeft": [1, 2]}}}, "geoBoundingBox", "geoBoundingBox.p", "unrecognized geo-point format"),
    ({"geoDistance": {"p": point}}, "geoDistance", "geoDistance", "expected object to have exactly 2 properties, got 1"),
    ({"geoDistance": {"p": point, "distance": ""}}, "geoDistance", "geoDistance.distance", "cannot be empty"),
    ({"geoDistance": {"p": {"lat": "x"}, "distance": "1m"}}, "geoDistance", "geoDistance.p", "unrecognized point format"),
    ({"geoDistanceRange": {"p": point, "from": "2m", "to": "1m"}}, "geoDistanceRange", "geoDistanceRange", "inner radius must be smaller than outer radius"),
    ({"geoPolygon": {"p": {"points": [[0, 0], [1, 1]]}}}, "geoPolygon", "geoPolygon.p.points", "at least 3 points are required to build a polygon"),
    ({"geoPolygon": {"p": {"points": [[0, 0], [1, 1], [0]]}}}, "geoPolygon", "geoPolygon.p.points", 'unrecognized point format "[0]"'),
    ({"and": []}, "and", "and", "cannot be empty"),
    ({"or": {"a": 1}}, "or", "or", "must be an array"),
    ({"and": [{"equals": {"a": 1}}, {}]}, "and", "and", "can only contain non-empty objects"),
    ({"or": ["a"]}, "or", "or", "can only contain non-empty objects"),
    ({"not": {}}, "not", "not", "expected object to have exactly 1 property, got 0"),
    ({"bool": {}}, "bool", "bool", "must be a non-empty object"),
    ({"bool": {"foo": []}}, "bool", "bool", '"foo" is not an allowed attribute (allowed: must,must_not,should,should_not)'),
]


@pytest.mark.parametrize("given,keyword,path,message", REJECTED)
def test_rejected(given, keyword, path, message):
    with pytest.raises(FilterError) as e:
        Percolator(seed=SEED).validate(given)
    assert (e.value.keyword, e.value.path) == (keyword, path)
    assert str(e.value) == (f'"{path}": {message}' if path else message)


def test_trees():
    r = Reader()
    a, b = literal("equals", "f", "a"), literal("equals", "f", "b")
    assert r.read(None) == r.read({}) == EVERYTHING and r.read({"nothing": 3}) == NOTHING
    assert r.read({"in": {"f": ["a", "b"]}}) == Any_((a, b))
    assert r.read({"not": {"or": [{"equals": {"f": "a"}}, {"not": {"equals": {"f": "b"}}}]}}) == All((a.flipped(), b))
    assert r.read({"missing": "f"}) == literal("exists", "f", {"array": False, "value": None}).flipped()
    assert r.read({"exists": r"a\[b\].c"}).field == "a[b].c" and r.read({"exists": "a[3"}).field == "a[3"
    assert r.read({"exists": 'a.b["x[1]"]'}) == literal("exists", "a.b", {"array": True, "value": "x[1]"})
    corners = [{"topLeft": [1, 0], "bottomRight": {"lat": 0, "lon": 1}}, {"top_left": "1,0", "bottom_right": {"lat_lon": [0, 1]}}, box, {k: str(v) for k, v in box.items()}]
    assert len({r.read({"geoBoundingBox": {"p": c}}) for c in corners}) == 1


def test_points_and_distances():
    for p in ([43.6021299, 3.8989713], "43.6021299, 3.8989713", {"lat": "43.6021299", "lon": 3.8989713}, {"latLon": [43.6021299, 3.8989713]}, {"lat_lon": {"lat": 43.6021299, "lon": 3.8989713}}, {"latLon": "43.6021299,3.8989713x"}):
        assert convert_geopoint(p) == (43.6021299, 3.8989713)
    lat, lon = convert_geopoint("spfb09x0ud5s")
    assert abs(lat - 43.6021299) < 1e-5 and abs(lon - 3.8989713) < 1e-5
    for p in (None, 3, "abc", "ab", [1], [1, "x"], {"lat": 1}, {"latLon": None}, {"latLon": 3}, "1,2,3", True):
        assert convert_geopoint(p) is None
    assert {round(convert_distance(d), 6) for d in ("1km", "1000 m", "1 000 M", "1 Km", "1000", "100000cm")} == {1000.0}
    assert abs(convert_distance("3 258,55 Ft") - 993.20604) < 1e-6
    for d in ("", "km", "1 parsec", "1.2.3 m"):
        with pytest.raises(ValueError):
            convert_distance(d)


def test_flatten():
    from sluice.functions.flatten import flatten

    assert flatten({"a": {"b": 1, "c": {"d": [{"e": 1}]}}, "f": None}) == {"a": {"b": 1, "c": {"d": [{"e": 1}]}}, "a.b": 1, "a.c": {"d": [{"e": 1}]}, "a.c.d": [{"e": 1}], "f": None}


def test_patterns():
    assert java_pattern("a$") == r"(?d)a\z" and java_pattern("a$", "m") == "(?dm)a$"
    assert java_pattern("(?P<x>a)[$[]") == r"(?d)(?<x>a)[$\[]"
    for bad in ("(", "a**", "[a", "(?=a)", "(?<!a)", r"(a)\1", "\\"):
        with pytest.raises(ValueError):
            java_pattern(bad)
    assert java_pattern("(?=a)", engine="js") == "(?d)(?=a)"
    with pytest.raises(ValueError):
        java_pattern("a", "x")


def test_normal_form_holds_for_the_same_documents():
    r = random.Random(1)

    def some(depth):
        if not depth or r.random() < 0.3:
            return r.choice([{"equals": {r.choice("ab"): r.choice([1, 2, "x"])}}, {"range": {r.choice("ab"): {"gt": r.randint(0, 3)}}}, {"exists": r.choice("abc")}, {"missing": r.choice("abc")}, {"exists": "c[1]"}, {"nothing": 1}])
        parts = [some(depth - 1) for _ in range(r.randint(1, 3))]
        return r.choice([{"and": parts}, {"or": parts}, {"not": parts[0]}])

    for _ in range(300):
        t = Reader().read(some(3))
        found = normal(t, by_path=False)
        assert all(not (set(x) < set(y)) for x in found for y in found)
        for _ in range(12):
            d = {k: r.choice([0, 1, 2, 3.5, "x", [1], [2]]) for k in "abc" if r.random() < 0.7}
            assert tree(t, d) == any(tree(All(x), d) for x in found)


def test_contradictions():
    def never(*given, by_path=True):
        return contradictory(frozenset(Reader().read(g) for g in given), by_path)

    assert never({"equals": {"a": 1}}, {"equals": {"a": 2}}) and never({"equals": {"a": 1}}, {"not": {"equals": {"a": 1}}})
    assert never({"equals": {"a": 5}}, {"range": {"a": {"lt": 5}}}) and not never({"equals": {"a": 5}}, {"range": {"a": {"lte": 5}}})
    assert never({"equals": {"a": 1}}, {"missing": "a"}) and never({"range": {"a": {"gt": 1}}}, {"missing": "a"})
    assert never({"exists": "a"}, {"missing": 'a["x"]'}) and not never({"exists": "a"}, {"missing": 'a["x"]'}, by_path=False)
    assert not never({"equals": {"a": "1"}}, {"not": {"equals": {"a": 1}}})


def test_ids():
    p = Percolator(seed=SEED)
    same = [
        {"and": [{"equals": {"a": 1}}, {"equals": {"b": 2.0}}]},
        {"and": [{"equals": {"b": 2}}, {"and": [{"equals": {"a": 1}}]}]},
        {"not": {"or": [{"not": {"equals": {"a": 1}}}, {"not": {"equals": {"b": 2}}}]}},
        {"bool": {"must": [{"equals": {"a": 1}}, {"equals": {"b": 2}}]}},
    ]
    ids = {p.register(f) for f in same}
    assert len(ids) == 1 and p.get_filter_ids() == list(ids) and Percolator(seed=SEED).normalize(same[1]).id in ids
    assert p.normalize(same[0], "x").id not in ids and Percolator().normalize(same[0]).id not in ids


def test_options_and_registry():
    for bad in ({"regexp_engine": "pcre"}, {"seed": b"1"}, {"seed": "x" * 32}, {"max_conditions": -1}, {"max_conditions": 1.5}):
        with pytest.raises(ValueError):
            Percolator(**bad)
    p = Percolator(seed=SEED, max_conditions=3)
    with pytest.raises(FilterError, match="too complex"):
        p.normalize({"in": {"a": ["1", "2", "3", "4"]}})
    p.validate({"in": {"a": ["1", "2", "3", "4"]}})
    Percolator(seed=SEED, max_conditions=0).normalize({"in": {"a": [str(i) for i in range(300)]}})
    with pytest.raises(ValueError):
        p.store({"equals": {"a": 1}})
    with pytest.raises(ValueError):
        p.normalize({}, 3)
    one, two = p.register({"equals": {"a": 1}}, "i"), p.register({"equals": {"a": 2}}, "i")
    assert p.get_indexes() == ["(default)", "i"] and p.has_filter_id(one, "i") and not p.has_filter_id(one)
    p.remove(one, "i")
    p.remove("unknown", "i")
    p.remove(one, "unknown")
    assert p.get_filter_ids("i") == [two] and p.get_filter_ids("unknown") == []
    p.remove(two, "i")
    assert p.get_indexes() == ["(default)"]
    gone = p.register({})
    p.remove(gone)
    assert p.get_indexes() == ["(default)"] and p.get_filter_ids() == []


def test_documents(spark, tmp_path):
    from sluice.sources.registry import load, save

    p = Percolator(spark, seed=SEED)
    a = p.register({"and": [{"equals": {"x.y": "v"}}, {"range": {"n": {"gt": 1}}}]})
    b = p.register({"exists": "l[true]"}, "i")
    assert p.test({"x": {"y": "v"}, "n": 2}) == [a] and p.test({"x": {"y": "v"}, "n": 1}) == [] and p.test({}, "unknown") == []
    assert p.test({"l": [1, True]}, "i") == [b]
    save(p, str(tmp_path / "r"))
    q = load(spark, str(tmp_path / "r"), seed=SEED)
    assert (q.get_filter_ids(), q.get_filter_ids("i")) == ([a], [b])
    assert q.conditions().count() == 3


def test_flat_fields_of_any_depth(spark):
    import json

    from pyspark.sql import functions as F

    from sluice.functions.flatten import flat_fields, flatten

    deep = 1
    for i in range(21):
        deep = {f"k{i}": deep, 's"{': "{{}", "arr": [{"x": 1}], "long": "{\\" * 20_000}
    docs = [deep, {"a": {"b": 1, "c.d": {"e": None}}, "f": [1]}, {}, [1], None, "x", {"a{": "\\"}]
    df = spark.createDataFrame([(i, i, json.dumps(d)) for i, d in enumerate(docs)], "path long, value long, json string").select("path", "value", F.parse_json("json").alias("doc"))
    out = flat_fields(df, "doc", ["path", "value"])
    assert out.columns == ["path", "value", "path", "value"]
    got = {}
    for r in out.toDF("i", "j", "p", "v").select("i", "p", F.to_json("v").alias("v")).collect():
        got.setdefault(r.i, {})[r.p] = json.loads(r.v)
    assert got == {i: flatten(d) for i, d in enumerate(docs) if isinstance(d, dict) and d}
    with pytest.raises(Exception, match="more than 4 levels"):
        flat_fields(df, "doc", ["path"], depth=4).collect()
    assert flat_fields(df.limit(0), "doc", ["path"]).count() == 0
    plan = flat_fields(df, "doc", ["path"], depth=30)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Exchange" not in plan
