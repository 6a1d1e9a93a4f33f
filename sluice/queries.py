"""Queries for every operator of the filter language over the test tables, each with SQL that says the same."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.engine import Percolator, document_column

SEED = b"percolation of rows, fixed seed!"


@dataclass
class Case:
    """``frame``: the rows; ``view``: the same rows in SQL; ``filters``: by name the filter and its condition in SQL."""

    frame: Callable[[SparkSession, str], DataFrame]
    view: str
    key: str
    filters: dict[str, tuple[object, str]]
    doc: str | None = None
    mode: str = "auto"
    options: dict = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Percolator(spark, seed=SEED, **self.options)
        names: dict[str, str] = {}
        for name, (given, _) in self.filters.items():
            names[engine.register(given, name)] = name  # an index each, so that equal filters keep their names
        terms = [engine.indexes[n][i].terms for i, n in names.items()]
        from sluice.operators.percolate import percolate

        return percolate(self.frame(spark, sf_dir), self.doc, terms, list(names.values()), [self.key], engine.compiler, mode=self.mode, name="filter_name")

    def sql(self) -> str:
        return f"with rows as ({self.view})\n" + "\nunion all\n".join(f"select {self.key}, '{name}' as filter_name from rows where {where}" for name, (_, where) in self.filters.items())


def table(name: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet").select(*columns)


def derived(name: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet").selectExpr(*columns)


def documents_of(name: str, key: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """A VARIANT document of the columns beside the key."""

    def frame(spark: SparkSession, d: str) -> DataFrame:
        df = spark.read.parquet(f"{d}/{name}.parquet").selectExpr(key, *columns)
        return df.select(key, document_column(df, [c for c in df.columns if c != key]).alias("doc"))

    return frame


def both(name: str, key: str, *columns: tuple[str, str, str]) -> dict:
    """The same derived rows in Spark and in SQL: (name, Spark expression, SQL expression) of each column."""
    spark = [f"{s} as {n}" for n, s, _ in columns]
    return {"frame": derived(name, key, *spark), "view": f"select {key}, " + ", ".join(f"{q} as {n}" for n, _, q in columns) + f" from {name}", "key": key}


EVENTS = {"frame": table("events", "event_id", "event_type", "value", "user_id"), "view": "select event_id, event_type, value, user_id from events", "key": "event_id"}
ORDERS = {"frame": table("orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), "view": "select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders", "key": "o_orderkey"}
PARTS = {"frame": table("part", "p_partkey", "p_name", "p_type", "p_brand", "p_size"), "view": "select p_partkey, p_name, p_type, p_brand, p_size from part", "key": "p_partkey"}
#: Points spread over the globe, and near a few places.
POINTS = both(
    "events", "event_id",
    ("pos", "named_struct('lat', cast((event_id * 37 % 1700) / 10.0 - 85 as double), 'lon', cast((event_id * 91 % 3599) / 10.0 - 180 as double))", "{'lat': (event_id * 37 % 1700) / 10.0 - 85, 'lon': (event_id * 91 % 3599) / 10.0 - 180}"),
    ("home", "named_struct('lat', 43.6 + (event_id % 97 - 48) / 1000d, 'lon', 3.9 + (event_id % 89 - 44) / 1000d)", "{'lat': 43.6 + (event_id % 97 - 48) / 1000.0::double, 'lon': 3.9 + (event_id % 89 - 44) / 1000.0::double}"),
    ("maybe", "case when event_id % 3 = 0 then named_struct('lat', 43.6 + (event_id % 97 - 48) / 1000d, 'lon', 3.9 + (event_id % 89 - 44) / 1000d) end", "case when event_id % 3 = 0 then {'lat': 43.6 + (event_id % 97 - 48) / 1000.0::double, 'lon': 3.9 + (event_id % 89 - 44) / 1000.0::double} end"),
)
PLACE = "(event_id * 37 % 1700) / 10.0 - 85", "(event_id * 91 % 3599) / 10.0 - 180"
#: The same points, as the formats that rows may have them in.
FORMATS = both(
    "events", "event_id",
    ("pair_text", f"concat(cast({PLACE[0]} as double), ', ', cast({PLACE[1]} as double))", "null"),
    ("pair", f"array(cast({PLACE[0]} as double), cast({PLACE[1]} as double))", "null"),
    ("wrapped", f"named_struct('latLon', named_struct('lat', cast({PLACE[0]} as double), 'lon', cast({PLACE[1]} as double)))", "null"),
    ("listed", f"named_struct('lat_lon', array(cast({PLACE[0]} as double), cast({PLACE[1]} as double)))", "null"),
    ("strings", f"named_struct('lat', cast(cast({PLACE[0]} as double) as string), 'lon', cast(cast({PLACE[1]} as double) as string))", "null"),
    ("pos", "null", f"{{'lat': {PLACE[0]}, 'lon': {PLACE[1]}}}"),
)
#: Geohashes of four to eight characters; SQL adds up their bits: the even ones halve the longitude, the odd ones the latitude.
HASH = " || ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', (event_id * {m} + {m} * event_id // 37) % 32 + 1, 1)" for m in (7, 11, 13, 17, 19, 23, 29, 31))
HASHED = {
    "frame": derived("events", "event_id", f"substr({HASH.replace('//', 'div')}, 1, 4 + cast(event_id % 5 as int)) as hash"),
    "view": f"""select event_id, {{'lat': -90 + sum(case when g % 2 = 1 then bit * 180 / pow(2, (g + 1) // 2) else 0 end) + 90 / pow(2, (max(n) * 5) // 2),
      'lon': -180 + sum(case when g % 2 = 0 then bit * 360 / pow(2, g // 2 + 1) else 0 end) + 180 / pow(2, (max(n) * 5 + 1) // 2)}} as pos
    from (select event_id, n, g, ((strpos('0123456789bcdefghjkmnpqrstuvwxyz', substr(hash, g // 5 + 1, 1)) - 1) >> (4 - g % 5)) & 1 as bit
      from (select event_id, hash, length(hash) as n, unnest(range(length(hash) * 5)) as g
        from (select event_id, substr({HASH}, 1, 4 + cast(event_id % 5 as int)) as hash from events)))
    group by event_id""",
    "key": "event_id",
}
NESTED = both("events", "event_id", ("payload", "named_struct('kind', event_type, 'inner', named_struct('v', value))", "{'kind': event_type, 'inner': {'v': value}}"), ("opt", "case when event_id % 4 <> 0 then user_id end", "case when event_id % 4 <> 0 then user_id end"))
WORDS = {"frame": derived("documents", "doc_id", "split(text, ' ') as words", "lang", "text"), "view": "select doc_id, string_split(text, ' ') as words, lang, text from documents", "key": "doc_id"}

def distance(lat: float, lon: float, col: str) -> str:
    return f"(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({lat} - {col}.lat) / 2), 2) + cos(radians({col}.lat)) * cos(radians({lat})) * pow(sin(radians({lon} - {col}.lon) / 2), 2)))))"


def box(col: str, bottom: float, top: float, left: float, right: float) -> str:
    return f"({col}.lat between {bottom} and {top} and {col}.lon between {left} and {right})"


def convex(col: str, ring: list[tuple[float, float]]) -> str:
    """Inside or on the border of a convex ring that runs clockwise as seen with longitude to the right."""
    return "(" + " and ".join(f"({x2 - x1}) * ({col}.lat - ({y1})) - ({y2 - y1}) * ({col}.lon - ({x1})) <= 0" for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True)) + ")"


#: Rings that turn inwards: an L, and a square with a notch.
CORNER = [(-40.05, -90.05), (60.05, -90.05), (60.05, -20.05), (0.05, -20.05), (0.05, 80.05), (-40.05, 80.05)]
NOTCH = [(-60.05, -100.05), (60.05, -100.05), (60.05, -30.05), (0.05, -30.05), (0.05, 30.05), (60.05, 30.05), (60.05, 100.05), (-60.05, 100.05)]
RING = [(-31.05, -40.05), (42.05, -40.05), (42.05, 61.05), (-31.05, 61.05)]
TRIANGLE = [(-20.03, 10.07), (50.03, 45.07), (-20.03, 80.07)]

CASES: dict[str, Case] = {
    "flagship": Case(**EVENTS, filters={
        "big_purchase": ({"and": [{"equals": {"event_type": "purchase"}}, {"range": {"value": {"gt": 100}}}]}, "event_type = 'purchase' and value > 100"),
        "error_or_signup": ({"in": {"event_type": ["error", "signup"]}}, "event_type in ('error', 'signup')"),
        "small_view": ({"bool": {"must": [{"equals": {"event_type": "view"}}], "must_not": [{"range": {"value": {"gte": 20}}}]}}, "event_type = 'view' and not value >= 20"),
    }),
    "equals": Case(**EVENTS, filters={
        "string": ({"equals": {"event_type": "click"}}, "event_type = 'click'"),
        "number": ({"equals": {"user_id": 7}}, "user_id = 7"),
        "other_type": ({"equals": {"user_id": "7"}}, "false"),
        "absent": ({"equals": {"nowhere": None}}, "false"),
    }),
    "in": Case(**ORDERS, filters={"urgent": ({"in": {"o_orderpriority": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority in ('1-URGENT', '2-HIGH')"), "done": ({"in": {"o_orderstatus": ["F"]}}, "o_orderstatus = 'F'")}),
    "ids": Case(**both("customer", "c_custkey", ("_id", "cast(c_custkey as string)", "cast(c_custkey as varchar)")), filters={"three": ({"ids": {"values": ["1", "7", "x"]}}, "_id in ('1', '7', 'x')")}),
    "range": Case(**ORDERS, filters={
        "closed": ({"range": {"o_totalprice": {"gte": 1000, "lte": 90000.5}}}, "o_totalprice >= 1000 and o_totalprice <= 90000.5"),
        "open": ({"range": {"o_totalprice": {"gt": 250000}}}, "o_totalprice > 250000"),
        "below": ({"range": {"o_totalprice": {"lt": 5000}}}, "o_totalprice < 5000"),
        "no_number": ({"range": {"o_orderstatus": {"gt": 0}}}, "false"),
    }),
    "regexp": Case(**PARTS, filters={
        "start": ({"regexp": {"p_name": "^red"}}, "regexp_matches(p_name, '^red')"),
        "flag": ({"regexp": {"p_name": {"value": "WIDGET$", "flags": "i"}}}, "regexp_matches(p_name, '(?i)WIDGET$')"),
        "class": ({"regexp": {"p_brand": "[1-3][45]"}}, "regexp_matches(p_brand, '[1-3][45]')"),
        "no_string": ({"regexp": {"p_size": "1"}}, "false"),
    }),
    "exists": Case(**NESTED, filters={"leaf": ({"exists": "opt"}, "opt is not null"), "nested": ({"exists": {"field": "payload.inner.v"}}, "payload.inner.v is not null"), "parent": ({"exists": "payload"}, "payload is not null"), "none": ({"exists": "payload.other"}, "false")}),
    "exists_value": Case(**WORDS, filters={"the": ({"exists": 'words["the"]'}, "list_contains(words, 'the')"), "bracket": ({"exists": 'words["[x]"]'}, "list_contains(words, '[x]')"), "number": ({"exists": "words[1]"}, "false")}),
    "missing": Case(**NESTED, filters={"leaf": ({"missing": "opt"}, "opt is null"), "none": ({"missing": "payload.other"}, "true")}),
    "missing_value": Case(**WORDS, filters={"the": ({"missing": 'words["the"]'}, "not list_contains(words, 'the')"), "no_array": ({"missing": 'lang["en"]'}, "true")}),
    "match": Case(**both("events", "event_id", ("payload", "named_struct('kind', event_type, 'tags', array(event_type, 'x', cast(user_id % 3 as string)))", "{'kind': event_type, 'tags': [event_type, 'x', cast(user_id % 3 as varchar)]}")), filters={
        "part": ({"match": {"payload": {"kind": "click"}}}, "payload.kind = 'click'"),
        "list": ({"match": {"payload": {"tags": ["1", "x"]}}}, "list_contains(payload.tags, '1')"),
        "twice": ({"match": {"payload": {"tags": ["x", "x"]}}}, "false"),
        "path": ({"match": {"payload.kind": "view"}}, "payload.kind = 'view'"),
    }),
    "match_objects": Case(frame=lambda spark, d: spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns")), view="select conv_id, list({'turn': turn, 'role': role} order by turn) as turns from conversations group by conv_id", key="conv_id", filters={
        "one": ({"match": {"turns": [{"role": "system"}]}}, "len(list_filter(turns, lambda t: t.role = 'system')) >= 1"),
        "two": ({"match": {"turns": [{"role": "user"}, {"role": "user"}]}}, "len(list_filter(turns, lambda t: t.role = 'user')) >= 2"),
        "first": ({"match": {"turns": [{"turn": 0, "role": "user"}]}}, "len(list_filter(turns, lambda t: t.role = 'user' and t.turn = 0)) >= 1"),
    }),
    "select": Case(**WORDS, filters={
        "first": ({"select": {"field": "words", "index": 0, "query": {"equals": {"value": "The"}}}}, "words[1] = 'The'"),
        "last": ({"select": {"field": "words", "index": -1, "query": {"regexp": {"value": "a"}}}}, "regexp_matches(words[-1], 'a')"),
        "beyond": ({"select": {"field": "words", "index": 100000, "query": {"exists": "value"}}}, "false"),
        "nested": ({"select": {"field": "words", "index": 1, "query": {"or": [{"in": {"value": ["the", "of"]}}, {"not": {"regexp": {"value": "e"}}}]}}}, "len(words) > 1 and (words[2] in ('the', 'of') or not regexp_matches(words[2], 'e'))"),
    }),
    "select_numbers": Case(**{"frame": table("embeddings", "vec_id", "embedding"), "view": "select vec_id, embedding from embeddings", "key": "vec_id"}, filters={"first": ({"select": {"field": "embedding", "index": 0, "query": {"range": {"value": {"gt": 0.1}}}}}, "embedding[1]::double > 0.1"), "last": ({"select": {"field": "embedding", "index": -2, "query": {"range": {"value": {"lte": 0}}}}}, "embedding[-2]::double <= 0")}),
    "geo_bounding_box": Case(**POINTS, filters={
        "numbers": ({"geoBoundingBox": {"pos": {"top": 42.05, "left": -40.05, "bottom": -31.05, "right": 61.05}}}, box("pos", -31.05, 42.05, -40.05, 61.05)),
        "corners": ({"geoBoundingBox": {"pos": {"top_left": [42.05, -40.05], "bottomRight": "-31.05, 61.05"}}}, box("pos", -31.05, 42.05, -40.05, 61.05)),
        "inverted": ({"geoBoundingBox": {"pos": {"top": -1, "left": 0, "bottom": 1, "right": 5}}}, "false"),
    }),
    "geo_distance": Case(**POINTS, filters={"near": ({"geoDistance": {"home": {"lat": 43.6, "lon": 3.9}, "distance": "2.5 km"}}, f"{distance(43.6, 3.9, 'home')} <= 2500"), "far": ({"geoDistance": {"pos": "10, 20", "distance": "3 000 mi"}}, f"{distance(10, 20, 'pos')} <= 4828020")}),
    "geo_distance_range": Case(**POINTS, filters={"ring": ({"geoDistanceRange": {"home": [43.6, 3.9], "from": "1km", "to": "3 km"}}, f"{distance(43.6, 3.9, 'home')} between 1000 and 3000")}),
    "geo_polygon": Case(**POINTS, filters={"square": ({"geoPolygon": {"pos": {"points": [list(p) for p in RING]}}}, convex("pos", RING)), "triangle": ({"geoPolygon": {"pos": {"points": [{"lat": a, "lon": b} for a, b in TRIANGLE]}}}, convex("pos", TRIANGLE))}),
    "geo_concave": Case(**POINTS, filters={
        "corner": ({"geoPolygon": {"pos": {"points": [list(p) for p in CORNER]}}}, f"({box('pos', -40.05, 60.05, -90.05, -20.05)} or {box('pos', -40.05, 0.05, -90.05, 80.05)})"),
        "notch": ({"geoPolygon": {"pos": {"points": [f"{a}, {b}" for a, b in NOTCH]}}}, f"({box('pos', -60.05, 60.05, -100.05, 100.05)} and not (pos.lat > 0.05 and pos.lon > -30.05 and pos.lon < 30.05))"),
    }),
    "not_polygon": Case(**POINTS, filters={"square": ({"not": {"geoPolygon": {"pos": {"points": [list(p) for p in RING]}}}}, f"not {convex('pos', RING)}"), "corner": ({"not": {"geoPolygon": {"pos": {"points": [list(p) for p in CORNER]}}}}, f"not ({box('pos', -40.05, 60.05, -90.05, -20.05)} or {box('pos', -40.05, 0.05, -90.05, 80.05)})")}),
    "geo_formats": Case(**FORMATS, filters={
        "text": ({"geoDistance": {"pair_text": [10, 20], "distance": "3000km"}}, f"{distance(10, 20, 'pos')} <= 3000000"),
        "list": ({"geoDistance": {"pair": {"lat": 10, "lon": 20}, "distance": "3000 Km"}}, f"{distance(10, 20, 'pos')} <= 3000000"),
        "wrapped": ({"geoDistance": {"wrapped": "10, 20", "distance": "3000000"}}, f"{distance(10, 20, 'pos')} <= 3000000"),
        "wrapped_list": ({"geoDistance": {"listed": {"latLon": [10, 20]}, "distance": "3 000 km"}}, f"{distance(10, 20, 'pos')} <= 3000000"),
        "strings": ({"geoDistance": {"strings": {"lat_lon": "10,20"}, "distance": "3000 kilometres"}}, f"{distance(10, 20, 'pos')} <= 3000000"),
    }),
    "geohash": Case(**HASHED, filters={
        "near": ({"geoDistance": {"hash": "spfb09x0ud5s", "distance": "2000 km"}}, f"{distance(43.60212985426188, 3.8989713042974472, 'pos')} <= 2000000"),
        "box": ({"geoBoundingBox": {"hash": {"topLeft": [70.05, -60.05], "bottomRight": [1.05, 40.05]}}}, box("pos", 1.05, 70.05, -60.05, 40.05)),
        "not": ({"not": {"geoBoundingBox": {"hash": {"top": 70.05, "left": -60.05, "bottom": 1.05, "right": 40.05}}}}, f"not {box('pos', 1.05, 70.05, -60.05, 40.05)}"),
    }),
    "repeated_keys": Case(**ORDERS | {"key": "o_orderpriority"}, filters={
        "plain": ({"range": {"o_totalprice": {"gt": 400000}}}, "o_totalprice > 400000"),
        "either": ({"or": [{"range": {"o_totalprice": {"gt": 300000}}}, {"equals": {"o_orderstatus": "P"}}, {"range": {"o_totalprice": {"gte": 350000, "lt": 360000}}}]}, "o_totalprice > 300000 or o_orderstatus = 'P'"),
    }),
    "dotted_keys": Case(frame=documents_of("events", "event_id", "named_struct('x.y', user_id, 'z', event_type) as a", "named_struct('c', named_struct('d', value)) as `a.b`"), view="select event_id, user_id, event_type, value from events", key="event_id", doc="doc", filters={
        "inner": ({"equals": {"a.x.y": 7}}, "user_id = 7"),
        "outer": ({"range": {"a.b.c.d": {"lt": 20}}}, "value < 20"),
        "both": ({"and": [{"equals": {"a.z": "click"}}, {"exists": "a.b.c"}]}, "event_type = 'click'"),
        "none": ({"exists": "a.x"}, "false"),
    }),
    "nothing_everything": Case(**{"frame": table("nation", "n_nationkey", "n_name"), "view": "select n_nationkey, n_name from nation", "key": "n_nationkey"}, filters={"nothing": ({"nothing": None}, "false"), "everything": ({}, "true"), "not_nothing": ({"not": {"nothing": True}}, "true")}),
    "not_equals": Case(**NESTED, filters={"value": ({"not": {"equals": {"opt": 3}}}, "opt is null or opt <> 3"), "absent": ({"not": {"equals": {"nowhere": 1}}}, "true")}),
    "not_range": Case(**NESTED, filters={"value": ({"not": {"range": {"opt": {"gt": 20, "lt": 60}}}}, "opt is null or not (opt > 20 and opt < 60)"), "no_number": ({"not": {"range": {"payload.kind": {"gt": 0}}}}, "true")}),
    "not_regexp": Case(**both("events", "event_id", ("opt", "case when event_id % 4 <> 0 then event_type end", "case when event_id % 4 <> 0 then event_type end"), ("num", "cast(user_id as int)", "cast(user_id as int)")), filters={"string": ({"not": {"regexp": {"opt": "^c"}}}, "opt is null or not regexp_matches(opt, '^c')"), "coerced": ({"not": {"regexp": {"num": "4"}}}, "not regexp_matches(cast(num as varchar), '4')")}),
    "not_match": Case(**NESTED, filters={"part": ({"not": {"match": {"payload": {"kind": "click"}}}}, "payload.kind <> 'click'")}),
    "not_geo": Case(**POINTS, filters={"circle": ({"not": {"geoDistance": {"maybe": [43.6, 3.9], "distance": "2 km"}}}, f"maybe is null or {distance(43.6, 3.9, 'maybe')} > 2000"), "box": ({"not": {"geoBoundingBox": {"pos": {"top": 42.05, "left": -40.05, "bottom": -31.05, "right": 61.05}}}}, f"not {box('pos', -31.05, 42.05, -40.05, 61.05)}")}),
    "not_select": Case(**WORDS, filters={"first": ({"not": {"select": {"field": "words", "index": 3, "query": {"equals": {"value": "the"}}}}}, "len(words) <= 3 or words[4] <> 'the'")}),
    "and": Case(**PARTS, filters={"both": ({"and": [{"regexp": {"p_name": "red"}}, {"range": {"p_size": {"gte": 10, "lt": 30}}}, {"not": {"equals": {"p_brand": "Brand#1"}}}]}, "regexp_matches(p_name, 'red') and p_size >= 10 and p_size < 30 and p_brand <> 'Brand#1'"), "never": ({"and": [{"equals": {"p_size": 1}}, {"equals": {"p_size": 2}}]}, "false")}),
    "or": Case(**PARTS, filters={"either": ({"or": [{"range": {"p_size": {"lt": 5}}}, {"and": [{"range": {"p_size": {"gt": 40}}}, {"regexp": {"p_name": "blue"}}]}]}, "p_size < 5 or p_size > 40 and regexp_matches(p_name, 'blue')")}),
    "not": Case(**PARTS, filters={"de_morgan": ({"not": {"or": [{"range": {"p_size": {"lt": 25}}}, {"regexp": {"p_name": "e"}}]}}, "not (p_size < 25 or regexp_matches(p_name, 'e'))"), "twice": ({"not": {"not": {"equals": {"p_size": 3}}}}, "p_size = 3")}),
    "bool": Case(**ORDERS, filters={
        "must": ({"bool": {"must": [{"equals": {"o_orderstatus": "O"}}, {"range": {"o_totalprice": {"gt": 1000}}}]}}, "o_orderstatus = 'O' and o_totalprice > 1000"),
        "must_not": ({"bool": {"must_not": [{"equals": {"o_orderstatus": "O"}}, {"range": {"o_totalprice": {"gt": 90000}}}]}}, "not (o_orderstatus = 'O' or o_totalprice > 90000)"),
        "should": ({"bool": {"should": [{"equals": {"o_orderstatus": "P"}}, {"range": {"o_totalprice": {"lt": 9000}}}]}}, "o_orderstatus = 'P' or o_totalprice < 9000"),
        "should_not": ({"bool": {"should_not": [{"equals": {"o_orderstatus": "F"}}, {"range": {"o_totalprice": {"gt": 50000}}}]}}, "not (o_orderstatus = 'F' and o_totalprice > 50000)"),
    }),
    "typed_json": Case(frame=lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", F.try_parse_json("props").alias("doc")), view="select event_id, cast(props::json->>'k' as bigint) as k from events", key="event_id", doc="doc", filters={
        "number": ({"equals": {"k": 42}}, "k = 42"),
        "string": ({"equals": {"k": "42"}}, "false"),
        "range": ({"range": {"k": {"gte": 10, "lt": 20}}}, "k >= 10 and k < 20"),
        "exists": ({"exists": "k"}, "k is not null"),
        "missing": ({"not": {"exists": "other"}}, "true"),
    }),
    "json_nested": Case(frame=documents_of("documents", "doc_id", "named_struct('lang', lang, 'words', split(text, ' ')) as meta"), view="select doc_id, lang, string_split(text, ' ') as words from documents", key="doc_id", doc="doc", filters={
        "path": ({"equals": {"meta.lang": "fr"}}, "lang = 'fr'"),
        "array": ({"exists": 'meta.words["the"]'}, "list_contains(words, 'the')"),
        "match": ({"match": {"meta": {"lang": "en", "words": ["of"]}}}, "lang = 'en' and list_contains(words, 'of')"),
        "select": ({"select": {"field": "meta.words", "index": -1, "query": {"regexp": {"value": "^t"}}}}, "regexp_matches(words[-1], '^t')"),
    }),
}


def many(n: int) -> tuple[list, str]:
    """n filters, an equality and a narrow range each, and their bounds in SQL."""
    types = ["signup", "error", "click", "view", "purchase"]
    given = [{"and": [{"equals": {"event_type": types[i % 5]}}, {"range": {"value": {"gte": (i * 7919 % 48000) / 100, "lt": (i * 7919 % 48000) / 100 + 1.5}}}]} for i in range(n)]
    sql = f"""select event_id, 'f' || i as filter_name from events join range({n}) t(i)
      on event_type = ['signup', 'error', 'click', 'view', 'purchase'][i % 5 + 1]
      and value >= (i * 7919 % 48000) / 100.0::double and value < (i * 7919 % 48000) / 100.0::double + 1.5"""
    return given, sql


def many_filters(n: int) -> Callable[[SparkSession, str], DataFrame]:
    from sluice.operators.percolate import percolate

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Percolator(spark, seed=SEED)
        found = [engine.normalize(g) for g in many(n)[0]]
        names: dict[str, list[str]] = {}
        for i, f in enumerate(found):
            names.setdefault(f.id, []).append(f"f{i}")
        terms = {f.id: f.terms for f in found}
        hits = percolate(EVENTS["frame"](spark, sf_dir), None, list(terms.values()), list(terms), ["event_id"], engine.compiler)
        if all(len(x) == 1 for x in names.values()):
            return hits.select("event_id", F.col("filter_id").alias("filter_id")).join(F.broadcast(spark.createDataFrame([(k, v[0]) for k, v in names.items()], "filter_id string, filter_name string")), "filter_id").select("event_id", "filter_name")
        pairs = spark.createDataFrame([(k, x) for k, v in names.items() for x in v], "filter_id string, filter_name string")
        return hits.join(F.broadcast(pairs), "filter_id").select("event_id", "filter_name")

    return run


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in a named index after a filter was removed."""
    engine = Percolator(spark, seed=SEED)
    keep = engine.register({"equals": {"n_regionkey": 1}}, "named")
    gone = engine.register({"range": {"n_nationkey": {"lt": 10}}}, "named")
    engine.register({}, None)
    engine.remove(gone, "named")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return engine.percolate(rows, ["n_nationkey"], index="named", names={keep: "keep"}).withColumnRenamed("filter_id", "filter_name")


#: Nested documents with all words of the texts.
FLAT = documents_of("documents", "doc_id", "named_struct('lang', lang, 'more', named_struct('source', source, 'words', split(text, ' '))) as meta", "source")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of nested documents."""
    from sluice.functions.flatten import flat_fields

    return flat_fields(FLAT(spark, sf_dir), "doc", ["doc_id"]).select("doc_id", "path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: c.run for name, c in CASES.items()}
ORACLE_SQL: dict[str, str] = {name: c.sql() for name, c in CASES.items()}
QUERIES["registry"] = registry
QUERIES["flatten"] = flat
ORACLE_SQL["flatten"] = "select doc_id, unnest(['meta', 'meta.lang', 'meta.more', 'meta.more.source', 'meta.more.words', 'source']) as path from documents"
ORACLE_SQL["registry"] = "select n_nationkey, 'keep' as filter_name from nation where n_regionkey = 1"
for _n in (100, 2000, 10_000):
    QUERIES[f"filters_{_n}"] = many_filters(_n)
    ORACLE_SQL[f"filters_{_n}"] = many(_n)[1]


def registered(n: int, frame: Callable[[SparkSession, str], DataFrame], key: str, make: Callable[[int], dict]) -> Callable[[SparkSession, str], DataFrame]:
    """n filters, f0 to f(n-1), registered one by one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Percolator(spark, seed=SEED)
        names = {engine.register(make(i)): f"f{i}" for i in range(n)}
        assert len(names) == n
        return engine.percolate(frame(spark, sf_dir), [key], names=names).withColumnRenamed("filter_id", "filter_name")

    return run


#: Events with a user as text and a list of tags; places on a fine grid.
TAGGED = both(
    "events", "event_id",
    ("uid", "concat('u', cast(user_id as string))", "'u' || user_id"),
    ("tags", "array(concat('t', cast(event_id % 10007 as string)), concat('t', cast(user_id as string)))", "['t' || (event_id % 10007), 't' || user_id]"),
    ("value", "value", "value"), ("user_id", "user_id", "user_id"), ("event_type", "event_type", "event_type"),
    ("line", "concat('user ', user_id, ' did ', event_type, ' ', event_id)", "'user ' || user_id || ' did ' || event_type || ' ' || event_id"),
    ("pos", "named_struct('lat', (event_id * 7919 % 160000) / 1000d - 80, 'lon', (event_id * 104729 % 350000) / 1000d - 175)", "{'lat': (event_id * 7919 % 160000) / 1000.0::double - 80, 'lon': (event_id * 104729 % 350000) / 1000.0::double - 175}"),
)


def centre(i: int) -> tuple[float, float]:
    return (i * 5393 % 15800) / 100 - 79.0037, (i * 9857 % 34800) / 100 - 174.0051


CENTRES = "(select i, (i * 5393 % 15800) / 100.0::double - 79.0037 as lat, (i * 9857 % 34800) / 100.0::double - 174.0051 as lon from range(N) t(i)) c"
#: Corners of a pentagon around a centre, clockwise as seen with longitude to the right.
PENTAGON = [(0.5, 0.0), (0.15, 0.47), (-0.4, 0.29), (-0.4, -0.29), (0.15, -0.47)]


def around(inner: float, outer: float) -> str:
    a = "pow(sin(radians(c.lat - pos.lat) / 2), 2) + cos(radians(pos.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - pos.lon) / 2), 2)"
    # a point within the outer circle is within so many degrees of latitude
    return f"abs(c.lat - pos.lat) < {outer / 111000 + 0.01} and 2 * 6371008.8 * asin(least(1.0, sqrt({a}))) between {inner} and {outer}"


def edges() -> str:
    out = []
    for (y1, x1), (y2, x2) in zip(PENTAGON, [*PENTAGON[1:], PENTAGON[0]], strict=True):
        out.append(f"({x2 - x1}) * (pos.lat - c.lat - ({y1})) - ({y2 - y1}) * (pos.lon - c.lon - ({x1})) <= 0")
    return "abs(c.lat - pos.lat) < 1 and " + " and ".join(out)


#: By name: the filter with number i, and the SQL that joins the rows with all numbers.
MANY: dict[str, tuple[Callable[[int], dict], str]] = {
    "many_equals": (lambda i: {"equals": {"uid": f"u{i}"}}, "rows join (select i from range(N) t(i)) c on uid = 'u' || i"),
    "many_in": (lambda i: {"in": {"uid": [f"u{i * 5 + k}" for k in range(5)]}}, "rows join (select i from range(N) t(i)) c on user_id >= i * 5 and user_id < i * 5 + 5"),
    "many_exists": (lambda i: {"exists": f'tags["t{i}"]'}, "(select event_id, unnest(list_distinct(tags)) as tag from rows) r join (select i from range(N) t(i)) c on tag = 't' || i"),
    "many_range": (lambda i: {"range": {"value": {"gte": i * 4.9 / 100, "lt": i * 4.9 / 100 + 2.5}}}, "rows join (select i, i * 4.9::double / 100 as low from range(N) t(i)) c on value >= low and value < low + 2.5"),
    "many_half_open": (lambda i: {"range": {"value": {"gt": 485 + i * 0.0005} if i % 2 else {"lte": 5 - i * 0.0005}}}, "rows join (select i, 485 + i * 0.0005::double as low, 5 - i * 0.0005::double as high from range(N) t(i)) c on case when i % 2 = 1 then value > low else value <= high end"),
    "many_regexp": (lambda i: {"regexp": {"line": f"user {i} did [cv].*"}}, "rows join (select i from range(N) t(i)) c on user_id = i and event_type in ('click', 'view')"),
    "many_boxes": (lambda i: {"geoBoundingBox": {"pos": {"bottom": centre(i)[0], "top": centre(i)[0] + 0.5, "left": centre(i)[1], "right": centre(i)[1] + 0.5}}}, f"rows join {CENTRES} on pos.lat >= c.lat and pos.lat <= c.lat + 0.5 and pos.lon >= c.lon and pos.lon <= c.lon + 0.5"),
    "many_circles": (lambda i: {"geoDistance": {"pos": list(centre(i)), "distance": "40 km"}}, f"rows join {CENTRES} on {around(0, 40000)}"),
    "many_rings": (lambda i: {"geoDistanceRange": {"pos": list(centre(i)), "from": "20 km", "to": "50km"}}, f"rows join {CENTRES} on {around(20000, 50000)}"),
    "many_polygons": (lambda i: {"geoPolygon": {"pos": {"points": [[centre(i)[0] + a, centre(i)[1] + b] for a, b in PENTAGON]}}}, f"rows join {CENTRES} on {edges()}"),
}
for _name, (_make, _join) in MANY.items():
    QUERIES[_name] = registered(10_000, TAGGED["frame"], "event_id", _make)
    ORACLE_SQL[_name] = f"with rows as ({TAGGED['view']}) select event_id, 'f' || i as filter_name from {_join.replace('(N)', '(10000)')}"


#: Documents whose field names differ from row to row.
NAMED = documents_of("events", "event_id", "map(concat('f', event_id % 20011), 1, concat('g', user_id), 2) as tags", "map('x', 1) as other")


def many_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on the existence of a field, each of another name."""
    engine = Percolator(spark, seed=SEED)
    names = {engine.register({"exists": f"tags.f{i * 2}" if i % 2 else f"tags.g{i}"}): f"f{i}" for i in range(10_000)}
    return engine.percolate(NAMED(spark, sf_dir), ["event_id"], doc="doc", names=names).withColumnRenamed("filter_id", "filter_name")


QUERIES["many_exists_name"] = many_names
ORACLE_SQL["many_exists_name"] = """select event_id, 'f' || i as filter_name from events join (select i from range(10000) t(i)) c
on case when i % 2 = 1 then event_id % 20011 = i * 2 else user_id = i end"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a degree, joined by cells."""
    engine = Percolator(spark, seed=SEED)
    names = {}
    for i in range(600):
        bottom, left = i * 53 % 1600 / 10 - 80.05, i * 97 % 3400 / 10 - 175.05
        names[engine.register({"geoBoundingBox": {"pos": {"bottom": bottom, "top": bottom + 3, "left": left, "right": left + 4}}})] = f"b{i}"
    return engine.percolate(POINTS["frame"](spark, sf_dir), ["event_id"], names=names).withColumnRenamed("filter_id", "filter_name")


QUERIES["boxes_600"] = grid
ORACLE_SQL["boxes_600"] = f"""with rows as ({POINTS["view"]}),
boxes as (select i, (i * 53 % 1600) / 10.0::double - 80.05 as bottom, (i * 97 % 3400) / 10.0::double - 175.05 as l from range(600) t(i))
select event_id, 'b' || i as filter_name from rows join boxes on pos.lat >= bottom and pos.lat <= bottom + 3 and pos.lon >= l and pos.lon <= l + 4"""


# the interface: what its calls return, as rows


def told(call: Callable[[], object]) -> str:
    """What a call returns, or is told."""
    try:
        return json.dumps(call(), sort_keys=True)
    except ValueError as e:
        return f"{getattr(e, 'keyword', None)}|{getattr(e, 'path', None)}|{e}"


def calls(make: Callable[[SparkSession], list[tuple[str, Callable[[], object]]]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.createDataFrame([(name, told(call)) for name, call in make(spark)], "call string, result string")


def wrong_filters(spark: SparkSession) -> list:
    engine = Percolator(spark, seed=SEED)
    given = {
        "two_keywords": {"equals": {"a": 1}, "exists": "a"}, "unknown": {"foo": {}}, "empty_and": {"and": []}, "nested": {"and": [{"equals": {"a": 1}}, {"bool": {"must": [{"or": [{"exists": ""}]}]}}]},
        "equals_list": {"equals": {"a": [1]}}, "in_numbers": {"in": {"a": [1]}}, "range_both": {"range": {"a": {"gt": 1, "gte": 1}}}, "range_order": {"range": {"a": {"gt": 2, "lt": 1}}}, "fine": {"range": {"a": {"gt": 1, "lt": 2}}},
    }
    return [(name, lambda f=f: engine.validate(f)) for name, f in given.items()]


def normal_forms(spark: SparkSession) -> list:
    engine = Percolator(spark, seed=SEED)
    pairs = {
        "order": ({"and": [{"equals": {"b": 1}}, {"equals": {"a": 2}}]}, {"and": [{"equals": {"a": 2}}, {"equals": {"b": 1}}]}),
        "de_morgan": ({"not": {"or": [{"exists": "a"}, {"equals": {"b": 1}}]}}, {"and": [{"missing": "a"}, {"not": {"equals": {"b": 1}}}]}),
        "in": ({"in": {"a": ["x", "y"]}}, {"or": [{"equals": {"a": "y"}}, {"equals": {"a": "x"}}]}),
        "absorbed": ({"or": [{"equals": {"a": 1}}, {"and": [{"equals": {"a": 1}}, {"exists": "b"}]}]}, {"equals": {"a": 1}}),
        "numbers": ({"equals": {"a": 1}}, {"equals": {"a": 1.0}}),
        "types": ({"equals": {"a": 1}}, {"equals": {"a": "1"}}),
        "signs": ({"exists": "a"}, {"missing": "a"}),
        "boxes": ({"geoBoundingBox": {"p": {"top_left": [2, 1], "bottom_right": [0, 3]}}}, {"geoBoundingBox": {"p": {"top": 2, "left": 1, "bottom": 0, "right": 3}}}),
    }
    out = [(name, lambda a=a, b=b: engine.normalize(a).id == engine.normalize(b).id) for name, (a, b) in pairs.items()]
    out.append(("index", lambda: engine.normalize({"exists": "a"}).id == engine.normalize({"exists": "a"}, "other").id))
    out.append(("seed", lambda: engine.normalize({"exists": "a"}).id == Percolator(spark, seed=b"1" * 32).normalize({"exists": "a"}).id))
    out.append(("same_seed", lambda: engine.normalize({"exists": "a"}).id == Percolator(spark, seed=SEED).normalize({"exists": "a"}).id))
    terms = lambda f: [[[x.keyword, x.field, x.negated] for x in t] for t in engine.normalize(f).terms]
    out.append(("sorted_terms", lambda: terms({"or": [{"exists": "z"}, {"and": [{"range": {"b": {"gt": 1}}}, {"equals": {"a": 1}}]}, {"not": {"equals": {"a": 2}}}]})))
    out.append(("contradiction", lambda: terms({"and": [{"equals": {"a": 1}}, {"equals": {"a": 2}}]})))
    out.append(("too_many", lambda: terms({"and": [{"exists": f"f{i}"} for i in range(51)]})))
    return out


def stored(spark: SparkSession) -> list:
    engine = Percolator(spark, seed=SEED)
    one = engine.normalize({"equals": {"a": 1}}, "first")
    two, three = {"exists": "b"}, {"in": {"c": ["x", "y"]}}
    return [
        ("stored", lambda: engine.store(one) == one.id), ("stored_twice", lambda: engine.store(one) == one.id), ("not_normalized", lambda: engine.store({"equals": {"a": 1}})),
        ("registered", lambda: [engine.register(two, "second") == engine.normalize(two, "second").id, engine.register(three, "second") == engine.normalize(three, "second").id]),
        ("ids", lambda: [len(engine.get_filter_ids(i)) for i in ("first", "second", "none", None)]), ("indexes", engine.get_indexes),
        ("has", lambda: [engine.has_filter_id(one.id, i) for i in ("first", "second", None, "none")]),
        ("test", lambda: [len(engine.test({"b": None, "c": "x"}, "second")), len(engine.test({"a": 1}, "first")), len(engine.test({"a": "1"}, "first")), engine.test({"a": 1}, "none")]),
        ("removed", lambda: engine.remove(one.id, "first")), ("removed_twice", lambda: engine.remove(one.id, "first")), ("indexes_after", engine.get_indexes), ("has_after", lambda: engine.has_filter_id(one.id, "first")),
        ("relation", lambda: sorted(([r.index_name, json.loads(r.json)] for r in engine.filters().collect()), key=str)),
        ("loaded", lambda: len(Percolator(spark, seed=SEED).load(engine.filters()))),
        ("wrong_index", lambda: engine.normalize({}, 3)), ("wrong_engine", lambda: Percolator(spark, regexp_engine="perl")), ("wrong_seed", lambda: Percolator(spark, seed=b"short")), ("wrong_maximum", lambda: Percolator(spark, max_conditions=-1)),
    ]


def statics(spark: SparkSession) -> list:
    distances = ["1 km", "3 258,55 Ft", "1000", "2 nautical miles", "1.5.2 m", "12 parsecs"]
    points = [[43.6, 3.9], "43.6, 3.9", {"lat": "43.6", "lon": 3.9}, {"latLon": [43.6, 3.9]}, {"lat_lon": {"lat": 43.6, "lon": 3.9}}, {"latLon": "43.6,3.9"}, [1, 2, 3], "x", None]
    near = lambda p: [round(v, 4) for v in p]
    return [(f"distance {d}", lambda d=d: round(Percolator.convert_distance(d), 6)) for d in distances] + [(f"point {n}", lambda p=p: Percolator.convert_geopoint(p)) for n, p in enumerate(points)] + [("geohash", lambda: near(Percolator.convert_geopoint("spfb09x0ud5s")))]


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters in normal form, as a relation."""
    engine = Percolator(spark, seed=SEED)
    engine.register({"and": [{"in": {"kind": ["a", "b"]}}, {"not": {"range": {"n": {"gte": 5}}}}]}, "one")
    engine.register({"bool": {"should": [{"exists": "x"}, {"missing": "y[1]"}]}}, "two")
    return engine.conditions().drop("filter_id")


def values(rows: list[tuple]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


#: What the calls are to return.
RETURNED: dict[str, tuple[Callable, dict[str, str]]] = {
    "api_validate": (wrong_filters, {
        "two_keywords": "equals,exists|None|Invalid filter syntax. Filters must have one keyword only",
        "unknown": 'foo|foo|"foo": unknown keyword',
        "empty_and": 'and|and|"and": cannot be empty',
        "nested": 'exists|and.bool.and.or.exists|"and.bool.and.or.exists": cannot test empty field name',
        "equals_list": 'equals|equals.a|"equals.a": must either be a string, a number, a boolean, or null',
        "in_numbers": 'in|in.a|"in.a": must hold only values of type "string"',
        "range_both": 'range|range.a|"range.a": only 1 lower boundary allowed',
        "range_order": 'range|range.a|"range.a": lower boundary must be strictly inferior to the upper one',
        "fine": "null",
    }),
    "api_normalize": (normal_forms, {
        "order": "true", "de_morgan": "true", "in": "true", "absorbed": "true", "numbers": "true", "types": "false", "signs": "false", "boxes": "true", "index": "false", "seed": "false", "same_seed": "true",
        "sorted_terms": '[[["equals", "a", false], ["range", "b", false]], [["equals", "a", true]], [["exists", "z", false]]]',
        "contradiction": "[]",
        "too_many": "None|None|Filter too complex: exceeds the configured maximum number of conditions (conditions: 51, max: 50)",
    }),
    "api_store": (stored, {
        "stored": "true", "stored_twice": "true",
        "not_normalized": "None|None|Invalid argument: not a normalized filter (use normalize to get one)",
        "registered": "[true, true]", "ids": "[1, 2, 0, 0]", "indexes": '["(default)", "first", "second"]', "has": "[true, false, false, false]", "test": "[2, 1, 0, []]",
        "removed": "null", "removed_twice": "null", "indexes_after": '["(default)", "second"]', "has_after": "false",
        "relation": '[["second", {"exists": "b"}], ["second", {"in": {"c": ["x", "y"]}}]]', "loaded": "2",
        "wrong_index": 'None|None|Invalid "index" argument: must be a string',
        "wrong_engine": 'None|None|Invalid configuration value for "regExpEngine". Supported: re2, js',
        "wrong_seed": "None|None|Invalid seed: expected a 32 bytes long Buffer",
        "wrong_maximum": "None|None|Invalid maxConditions configuration: positive or nul integer expected",
    }),
    "api_statics": (statics, {
        "distance 1 km": "1000.0", "distance 3 258,55 Ft": "993.20604", "distance 1000": "1000.0", "distance 2 nautical miles": "3704.0",
        "distance 1.5.2 m": 'None|None|unable to parse distance value "1.5.2 m"', "distance 12 parsecs": 'None|None|unable to parse distance value "12 parsecs"',
        **{f"point {n}": "[43.6, 3.9]" for n in range(6)}, "point 6": "null", "point 7": "null", "point 8": "null", "geohash": "[43.6021, 3.899]",
    }),
}
for _name, (_make, _found) in RETURNED.items():
    QUERIES[_name] = calls(_make)
    ORACLE_SQL[_name] = f"select * from (values {values(list(_found.items()))}) t(call, result)"
QUERIES["api_conditions"] = conditions
ORACLE_SQL["api_conditions"] = """select index_name, cast(term as integer) as term, keyword, field, args, negated from (values
  ('one', 0, 'equals', 'kind', '"a"', false), ('one', 0, 'range', 'n', '{"gte":5}', true),
  ('one', 1, 'equals', 'kind', '"b"', false), ('one', 1, 'range', 'n', '{"gte":5}', true),
  ('two', 0, 'exists', 'x', '{"array":false,"value":null}', false), ('two', 1, 'exists', 'y', '{"array":true,"value":1}', true)
) t(index_name, term, keyword, field, args, negated)"""
