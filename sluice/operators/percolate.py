"""Rows against many filters, in one pass: as expressions, or as an equi-join with a relation of filters.

A filter in normal form is an or of terms, an and of literals each. Filters whose terms have the same keywords, fields and
signs differ in arguments alone: they are a group. A small group, or one that has a term without a literal that an index
can serve, is one boolean expression for each filter, evaluated in the row. The other groups become rows of one relation,
with columns for the arguments; the anchor of each term, the literal with the fewest expected hits, becomes an equi-join
on keys that both sides compute, and all other literals are tested column against column on the hits. The keys of a row
for all groups are one array, and expressions add theirs, so rows are read once however many filters and groups there are.

Keys. Equality: the value. Ranges and boxes: cells of the size of their own extent, so that an interval touches at most two
cells of its level, a box at most four, and a row has one cell for each level that occurs. Ranges with an open end: the
place of the bound among all of them in order; a row has the places up to its own value, found by halving. Where all
filters are such, what a row meets is the first so many of all ids in order: nothing is joined or tested. Patterns: three
characters that a match must have. Existence of a field: its path, against the paths that a document has.

A row meets a filter once: of a filter's terms that hold the first counts, which is a test on the hit. What a filter finds
does not depend on the other filters, and nothing needs a distinct.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.geo import EARTH_M
from sluice.functions.regex import java_pattern
from sluice.operators.conditions import Compiler, compared
from sluice.operators.values import MOST_PARTS, Absent, Row, Typed, key_of, quoted, step, ways
from sluice.plans.language import Literal

#: Filters of a group from which on it is joined, expressions of an array at most, rows of a filter relation that are
#: broadcast at most, and objects at most whose fields are listed for filters on the existence of fields.
JOIN_FROM, EXPRESSIONS, BROADCAST_ROWS, OBJECTS = 40, 200, 200_000, 64
#: The levels of intervals without an upper or a lower end, and of shapes too large for cells.
UP, DOWN, OPEN = 4096, 4097, 4098
#: The characters of a pattern's key.
GRAM = 3

Terms = tuple[tuple[Literal, ...], ...]


@dataclass(frozen=True)
class Unit:
    """An or of terms that is met once, and the numbers of the filters that it stands for."""

    terms: Terms
    filters: tuple[int, ...]


def units_of(normals: list[Terms]) -> list[Unit]:
    """The distinct units of filters in normal form; filter i is normals[i]. A filter is a unit, but for those whose terms
    exclude each other: these are units each, as no row meets two."""
    owners: dict[Terms, list[int]] = defaultdict(list)
    for i, found in enumerate(normals):
        for unit in [(t,) for t in found] if apart(found) else [tuple(sorted(found, key=lambda t: (shape_of(t), t)))] if found else []:
            owners[unit].append(i)
    return [Unit(t, tuple(o)) for t, o in owners.items()]


def apart(terms: Terms) -> bool:
    """Whether every term asks one field for another value."""
    if not all(len(t) == 1 and t[0].keyword == "equals" and not t[0].negated and t[0].field == terms[0][0].field for t in terms):
        return False
    return len({key_of(t[0].args) for t in terms}) == len(terms)


def shape_of(t: tuple[Literal, ...]) -> tuple:
    """What a term has in common with others: literals whose arguments can't be columns keep theirs."""
    return tuple((x.keyword, x.field, x.negated, _variant(x)) for x in t)


def shape_of_unit(u: Unit) -> tuple:
    """Of a unit that is a test for the existence of a field, and nothing else, the field is an argument too."""
    return ("path",) if by_name(u) else tuple(map(shape_of, u.terms))


def by_name(u: Unit) -> bool:
    return len(u.terms) == 1 and len(u.terms[0]) == 1 and named(u.terms[0][0])


def named(x: Literal) -> bool:
    return x.keyword == "exists" and not x.negated and not x.args["array"]


def _variant(x: Literal) -> str:
    if x.keyword in ("equals", "range"):
        return ""
    if x.keyword == "regexp":
        return "known" if len(required(x.args["value"], x.args["flags"])) >= GRAM else "unknown"
    if x.keyword == "geo":
        return x.args["shape"]
    if x.keyword == "exists" and x.args["array"] and not isinstance(x.args["value"], (dict, list)):
        return "value"
    return x.json


# expressions


def holding(row: Row, units: list[Unit], compiler: Compiler) -> list[tuple[int, Column]]:
    """The number of each filter, and whether one of its units holds."""
    cache: dict[Literal, Column] = {}

    def held(x: Literal) -> Column:
        if x not in cache:
            cache[x] = compiler.condition(row, x)
        return cache[x]

    whole = lambda t: reduce(lambda a, b: a & b, map(held, t)) if t else F.lit(True)
    ways: dict[int, list[Column]] = defaultdict(list)
    for u in units:
        one = reduce(lambda a, b: a | b, map(whole, u.terms))
        for i in u.filters:
            ways[i].append(one)
    return [(i, reduce(lambda a, b: a | b, w)) for i, w in ways.items()]


def arrays(items: list[Column], kind: str) -> Column:
    """One array of many elements, in parts, so that the expressions for its parts stay small."""
    parts = [F.array(*items[at : at + EXPRESSIONS]) for at in range(0, len(items), EXPRESSIONS)]
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.array().cast(f"array<{kind}>")


def never(row: Row, unit: Unit) -> bool:
    """Whether no row can meet a unit, as each term asks something of a field that no row has."""
    return all(any(not x.negated and x.keyword in ("equals", "range", "regexp", "exists", "geo") and isinstance(row.field(x.field), Absent) for x in t) for t in unit.terms)


def necessary(row: Row, units: list[Unit], most: int = 24) -> Column | None:
    """A condition that rows with any hit fulfil, in a form that reaches the scan; None if there is none worth it."""
    terms = list(chain.from_iterable(u.terms for u in units))
    if len(terms) > most:
        return None
    out = None
    for t in terms:
        found = [c for x in t if (c := _plain(row, x)) is not None]
        if not found:
            return None
        one = reduce(lambda a, b: a & b, found)
        out = one if out is None else out | one
    return out


def _plain(row: Row, x: Literal) -> Column | None:
    value = row.field(x.field)
    if x.negated or not isinstance(value, Typed):
        return None
    if x.keyword == "equals" and isinstance(x.args, str) and isinstance(value.kind, T.StringType):
        return value.raw == x.args
    if x.keyword == "equals" and isinstance(x.args, (int, float)) and not isinstance(x.args, bool) and isinstance(value.kind, T.NumericType):
        return value.number == float(x.args)
    if x.keyword == "range" and isinstance(value.kind, T.NumericType):
        return compared(value.number, x.args)
    return value.raw.isNotNull() if x.keyword == "exists" and not x.args["array"] else None


# relations


def columns_of(x: Literal, engine: str) -> dict:
    """The arguments of a literal as values of a relation's columns."""
    a = x.args
    if x.keyword == "equals":
        return {"key": key_of(a)}
    if x.keyword == "range":
        low, high = bounds(x)
        return {"low": low, "low_in": "gte" in a or low == -math.inf, "high": high, "high_in": "lte" in a or high == math.inf}
    if x.keyword == "regexp":
        return {"pattern": java_pattern(a["value"], a["flags"], engine)}
    if x.keyword == "geo":
        return {"ring": [{"lat": float(p), "lon": float(q)} for p, q in a["ring"]]} if a["shape"] == "polygon" else {k: float(v) for k, v in a.items() if k != "shape"}
    return {"key": key_of(a["value"])} if _variant(x) == "value" else {}


KINDS = {"key": "string", "pattern": "string", "low_in": "boolean", "high_in": "boolean", "ring": "ring"}
ARROW = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "ring": pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))}


def bounds(x: Literal) -> tuple[float, float]:
    low, high = x.args.get("gt", x.args.get("gte")), x.args.get("lt", x.args.get("lte"))
    return -math.inf if low is None else float(low), math.inf if high is None else float(high)


def level_of(size: float) -> int:
    """The cells of level l are 2^l wide; an interval takes the level whose cells are at least as wide as it is."""
    return OPEN if not math.isfinite(size) else -1074 if size <= 0 else math.ceil(math.log2(size))


def cells(low: float, high: float) -> tuple[int, list[int]]:
    """The level of an interval, and its cells; one more on either side of a border that rounding may have moved."""
    off = max(abs(low), abs(high)) * 1e-12
    level = max(-40, level_of(high - low + 2 * off))
    first, last = (math.floor(v / 2.0**level) for v in (low - off, high + off))
    return level, list(range(first, last + 1))


#: Keys that are numbers hold the place of the level among all levels, then what tells cells of a level apart, as far as
#: there is room: others are told apart by the tests of a hit.
ROOM, LAT_ROOM, LON_ROOM = 52, 25, 27
_LONG = 1 << 63


def _packed(place: int, *parts: tuple[int, int]) -> int:
    """``parts``: a cell, and the bits it has room for. Cells beyond what a long holds are those at its end, as in Spark."""
    out = place
    for cell, room in parts:
        out = out << room | max(-_LONG, min(_LONG - 1, cell)) & ((1 << room) - 1)
    return out


def boxes(x: Literal) -> list[tuple[float, float, float, float]]:
    """Boxes (bottom, top, left, right) that cover a shape."""
    a = x.args
    if a["shape"] == "box":
        return [(a["bottom"], a["top"], a["left"], a["right"])] if a["bottom"] <= a["top"] and a["left"] <= a["right"] else []
    if a["shape"] == "polygon":
        lat, lon = zip(*a["ring"], strict=True)
        return [(min(lat), max(lat), min(lon), max(lon))]
    reach = a["to"] / EARTH_M * 1.000001
    bottom, top = a["lat"] - math.degrees(reach), a["lat"] + math.degrees(reach)
    if reach >= 1.5 or bottom <= -89.9 or top >= 89.9:
        return [(-math.inf, math.inf, -math.inf, math.inf)]
    wide = math.degrees(math.asin(min(1.0, math.sin(reach) / math.cos(math.radians(a["lat"])))))
    # points may be written a turn to the east or west
    return [(bottom, top, a["lon"] - wide + turn, a["lon"] + wide + turn) for turn in (-360, 0, 360)]


def areas(x: Literal) -> list[tuple[int, int, int]]:
    """Level, and cells of latitude and longitude, of a shape."""
    out = set()
    for bottom, top, left, right in boxes(x):
        level = max(-40, level_of(max(top - bottom, right - left)))
        if level >= 10:
            out.add((OPEN, 0, 0))
            continue
        lat, lon = ([math.floor((v + e) / 2.0**level) for v, e in ((a, -1e-9), (b, 1e-9))] for a, b in ((bottom, top), (left, right)))
        out |= {(level, i, j) for i in range(lat[0], lat[1] + 1) for j in range(lon[0], lon[1] + 1)}
    return sorted(out)


def required(pattern: str, flags: str) -> str:
    """The longest string, of usual characters, that each match of a pattern holds; empty if none is sure. Runs end at
    whatever means more than itself; what may be left out does not count; patterns with branches have none."""
    if "|" in pattern or "(?" in pattern or "i" in flags or "x" in flags:
        return ""
    runs, now, at, depth = [], [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            c, at = pattern[at : at + 2], at + 1
            if c[1:].isalnum() and c[1] not in "dDwWsSbBnrtfv":  # what follows may belong to it
                return ""
        at += 1
        if c == "{":
            at = pattern.find("}", at) + 1
            if not at:
                return ""
        if c == "[":
            close = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]", re.DOTALL).match(pattern, at - 1)
            if close is None or "[" in close[0][1:]:
                return ""
            at = close.end()
        depth += (c == "(") - (c == ")")
        plain = depth == 0 and (len(c) == 1 and c not in "[]().^$*+?{}" or len(c) == 2 and c[1] in "\\.^$*+?{}[]()-/")
        after = pattern[at : at + 1]
        if plain and not (after and after in "*?{"):
            now.append(c[-1])
            if after == "+":
                runs.append("".join(now))
                now = []
        else:
            runs.append("".join(now))
            now = []
    return max([*runs, "".join(now)], key=len)


@dataclass
class Index:
    """How a literal of a group is found: the keys of each of the filters' literals, all strings (``kind`` s) or all numbers
    (y); those of a row, as an array; filters that a row meets, roughly; whether a key found is a literal that holds."""

    kind: str
    keys: list[list]
    row: Callable[[Row], Column | None]
    expected: float
    exact: bool = False
    #: The key of a row, where it has one at most.
    only: Callable[[Row], Column] | None = None


def index(members: list[Literal], paths: bool) -> Index | None:
    """``paths``: whether paths of documents can be listed."""
    x = members[0]
    if x.negated:
        return None
    if x.keyword == "equals":
        keys = [[key_of(m.args)] for m in members]
        return Index("s", keys, lambda row: F.array(row.field(x.field).key), _average(keys), True, lambda row: row.field(x.field).key)
    if x.keyword == "exists" and _variant(x) == "value":
        keys = [[key_of(m.args["value"])] for m in members]
        return Index("s", keys, lambda row: _elements(row.field(x.field)), _average(keys), True)
    if named(x) and paths:
        found = sorted({m.field for m in members})
        if all(f.count(".") < MOST_PARTS for f in found) and len(objects(found)) <= OBJECTS:
            return Index("s", [[m.field] for m in members], lambda row: _paths(row.document, found), 1.0, True)
    if x.keyword == "range":
        return _intervals(members)
    if x.keyword == "geo":
        return _shapes(members)
    return _grams(members) if x.keyword == "regexp" and _variant(x) == "known" else None


def _average(keys: list[list]) -> float:
    return sum(map(len, keys)) / max(1, len(set(chain.from_iterable(keys))))


def _spread(keys: list[list[tuple]]) -> float:
    """Filters that a row meets, roughly: those of an average cell of each level, and all that have none."""
    levels = defaultdict(list)
    for k, n in Counter(chain.from_iterable(keys)).items():
        levels[k[0]].append(n)
    return sum(sum(n) if k == OPEN else sum(n) / len(n) for k, n in levels.items())


def _elements(value) -> Column | None:
    if value.elements() is None:
        return None
    items, of = value.elements()
    return F.array_distinct(F.transform(items, lambda e: of(e).key))


def objects(paths: list[str]) -> list[tuple[str, ...]]:
    """The objects, by the keys that lead there, whose own keys say which of the paths a document has."""
    parents = {tuple(p.split(".")[:n]) for p in paths for n in range(p.count(".") + 1)}
    return sorted({tuple(way) for p in parents for way in ways(list(p))})


def _paths(document: Column, paths: list[str]) -> Column:
    """The paths asked for, and others, that a document has, once each."""
    found = []
    for parent in objects(paths):
        if None not in (way := [step(k) for k in parent]):
            keys = F.coalesce(F.map_keys(F.try_variant_get(document, "$" + "".join(way), "map<string,variant>")), F.array().cast("array<string>"))
            found.append(_under(keys, ".".join([*parent, ""])) if parent else keys)
    return F.array_distinct(F.concat(*found))


def _under(keys: Column, start: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(start), k))


def _cell(v: Column, level: int, room: int) -> Column:
    return F.floor(v / F.lit(2.0**level)).cast("long").bitwiseAND(F.lit((1 << room) - 1))


def _intervals(members: list[Literal]) -> Index:
    field_ = members[0].field
    own: list[tuple[int, list[int]] | None] = [None] * len(members)
    open_: dict[int, list[tuple[float, int]]] = {UP: [], DOWN: []}
    for i, (low, high) in enumerate(map(bounds, members)):
        if math.isnan(low) or math.isnan(high):
            continue
        if math.isfinite(high - low):
            own[i] = cells(low, high)
        elif high == math.inf:
            open_[UP].append((low, i))
        else:
            open_[DOWN].append((-high, i))
    # a row with value v has the bounds that stand before it: those at most v of the lower ones, at least v of the upper
    ends = {}
    for level, found in open_.items():
        found.sort()
        ends[level] = [v for v, _ in found]
        for n, (_, i) in enumerate(found):
            own[i] = level, [n]
    levels = sorted({x[0] for x in own if x})
    place = {level: n for n, level in enumerate(levels)}
    finite = [level for level in levels if level not in ends]
    keys = [[_packed(place[x[0]], (c, ROOM)) for c in x[1]] if x else [] for x in own]
    spread = _spread([[(x[0], c) for c in x[1]] for x in own if x and x[0] not in ends]) + sum(map(len, open_.values())) / 2
    cell = lambda v, level: _cell(v, level, ROOM) + F.lit(place[level] << ROOM)

    def row_keys(row: Row) -> Column:
        v, parts = row.field(field_).number, []
        if finite:
            parts.append(F.when(F.abs(v) < float("inf"), F.array(*[cell(v, n) for n in finite])).otherwise(_none()))  # an infinite value is in no cell
        for level, sign in ((UP, 1), (DOWN, -1)):
            if ends[level]:
                # and one place more, which the tests of a hit refuse
                start = F.lit(place[level] << ROOM)
                parts.append(F.sequence(start, start + _upto(v if sign > 0 else -v, ends[level])))
        return F.when(v.isNotNull() & ~F.isnan(v), F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none())

    # a value beyond all cells has a cell that tests of a hit refuse
    return Index("y", keys, row_keys, spread, only=(lambda row: cell(row.field(field_).number, levels[0])) if len(levels) == 1 and finite else None)


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _upto(v: Column, bounds_: list[float]) -> Column:
    """How many of sorted bounds are at most v, found by halving."""
    bits = max(1, len(bounds_).bit_length())
    text = ",".join("Infinity" if b == math.inf else "-Infinity" if b == -math.inf else repr(b) for b in [*bounds_, *[math.nan] * ((1 << bits) - 1 - len(bounds_))])
    known = F.expr(f"cast(split('{text.replace('nan', 'NaN')}', ',') as array<double>)")  # NaN sorts above all numbers
    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(bits))]), F.lit(0), lambda at, n: F.when(F.element_at(known, at + n) <= v, at + n).otherwise(at))


def one_bound(u: Unit) -> bool:
    """Whether a unit is a range with one bound, and nothing else."""
    return len(u.terms) == 1 and len(u.terms[0]) == 1 and (x := u.terms[0][0]).keyword == "range" and not x.negated and len(x.args) == 1 and not math.isnan(*x.args.values())


def runs(df: DataFrame, row: Row, units: list[Unit], ids: list[str], own: list[Column], name: str) -> DataFrame:
    """The hits of ranges with one bound: of the ids in the order of their bounds, those that stand before a row's value.
    A row may have as many hits as there are filters, so rows with any are dealt to all executors first, however few files
    or row groups they come from."""
    ends: dict[tuple[str, int], list[tuple[float, str]]] = defaultdict(list)
    for u in units:
        x = u.terms[0][0]
        ((kind, bound),) = x.args.items()
        sign = 1 if kind in ("gt", "gte") else -1
        least = sign * float(bound)
        if kind in ("gt", "lt"):
            if least == math.inf:
                continue
            least = math.nextafter(least, math.inf)
        ends[x.field, sign] += [(least, ids[i]) for i in u.filters]
    counts, each, any_ = [], [], F.lit(False)
    for n, ((field_, sign), found) in enumerate(sorted(ends.items())):
        found.sort(key=lambda x: x[0])
        v = row.field(field_).number
        v = v if sign > 0 else -v
        some = v.isNotNull() & ~F.isnan(v) & (v >= found[0][0])
        counts.append(F.when(some, _upto(v, [b for b, _ in found])).otherwise(0).alias(f"__n_{n}"))
        each.append(F.slice(F.from_json(F.lit(json.dumps([i for _, i in found])), "array<string>"), F.lit(1), F.col(f"__n_{n}")))
        any_ = any_ | some
    dealt = df.filter(any_).select("*", *counts).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select(*own, F.explode(F.concat(*each) if len(each) > 1 else each[0] if each else F.array().cast("array<string>")).alias(name))


def _shapes(members: list[Literal]) -> Index:
    own = [areas(m) for m in members]
    levels = sorted({k[0] for x in own for k in x})
    place = {level: n for n, level in enumerate(levels)}
    keys = [list(dict.fromkeys(_packed(place[level], (lat, LAT_ROOM), (lon, LON_ROOM)) for level, lat, lon in x)) for x in own]

    def row_keys(row: Row) -> Column:
        p = row.field(members[0].field).point
        each = [F.lit(place[n] << ROOM) + (F.lit(0) if n == OPEN else F.shiftleft(_cell(p["lat"], n, LAT_ROOM), LON_ROOM) + _cell(p["lon"], n, LON_ROOM)) for n in levels]
        return F.when(p.isNotNull(), arrays(each, "bigint"))

    return Index("y", keys, row_keys, _spread(own))


def _grams(members: list[Literal]) -> Index:
    """Of each pattern the characters, of those that a match must have, that the fewest patterns must have."""
    grams = lambda text: {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
    must = [grams(required(m.args["value"], m.args["flags"])) for m in members]
    count = Counter(chain.from_iterable(must))
    keys = [[min(own, key=lambda g: (count[g], g))] for own in must]
    found = lambda row: F.array_distinct(F.regexp_extract_all(row.field(members[0].field).string, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    # tried on a hit, a pattern is compiled anew: other anchors are better if there are any
    return Index("s", keys, found, 1e6 + _average(keys))


@dataclass
class Group:
    """Units of one shape, and how each of their terms is found."""

    units: list[Unit]
    anchors: list[tuple[int, Index]] = field(default_factory=list)

    @classmethod
    def of(cls, units: list[Unit], paths: bool) -> Group | None:
        found = cls(units)
        for t in range(len(units[0].terms)):
            ways = [(n, i) for n in range(len(units[0].terms[t])) if (i := index([u.terms[t][n] for u in units], paths)) is not None]
            if not ways:
                return None
            found.anchors.append(min(ways, key=lambda w: w[1].expected))
        return found


class Relation:
    """Rows of filters: key columns ``__b`` (branch: a term of a group), ``__s`` and ``__y``, ``__id``, and columns for
    arguments, which the groups share by kind."""

    def __init__(self) -> None:
        self.keys: dict[str, list] = {"b": [], "s": [], "y": []}
        self.ids: list[str] = []
        self.rows: list[dict] = []
        self.kinds: dict[str, str] = {}

    def add(self, branch: int, kind: str, key, id_: str, args: dict) -> None:
        self.keys["b"].append(branch)
        self.keys["s"].append(key if kind == "s" else "")
        self.keys["y"].append(key if kind == "y" else 0)
        self.ids.append(id_)
        self.rows.append(args)

    def column(self, kind: str, number: int) -> str:
        name = f"__{kind}_{number}"
        self.kinds[name] = kind
        return name

    def frame(self, spark) -> DataFrame:
        columns = {f"__{n}": pa.array(c, t) for (n, c), t in zip(self.keys.items(), (pa.int32(), pa.string(), pa.int64()), strict=True)}
        columns["__id"] = pa.array(self.ids, pa.string())
        for name, kind in self.kinds.items():
            columns[name] = pa.array([r.get(name) for r in self.rows], ARROW[kind])
        made = spark.createDataFrame(pa.table(columns))
        return F.broadcast(made) if len(self.rows) <= BROADCAST_ROWS else made


def slots(group: Group, relation: Relation, engine: str) -> list[list[dict[str, str]]]:
    """For each term and literal of a group the columns of its arguments."""
    count: Counter = Counter()

    def one(kind: str) -> str:
        count[kind] += 1
        return relation.column(kind, count[kind])

    return [[{n: one(KINDS.get(n, "double")) for n in columns_of(x, engine)} for x in t] for t in group.units[0].terms]


def joined(row: Row, groups: list[Group], ids: list[str], compiler: Compiler) -> tuple[Relation, list[tuple[int, Index, Column]], Column | None]:
    """The relation of groups; of each branch its number, its index and a row's keys; and the test of a hit."""
    relation, branches, test = Relation(), [], None
    for group in groups:
        where = slots(group, relation, compiler.engine)
        terms = group.units[0].terms
        held = lambda t, but=None: [compiler.condition(row, x, {n: F.col(c) for n, c in where[t][i].items()} or None) for i, x in enumerate(terms[t]) if i != but]  # noqa: B023, E731
        every = [{where[t][i][n]: v for t, own in enumerate(u.terms) for i, x in enumerate(own) for n, v in columns_of(x, compiler.engine).items()} for u in group.units]
        for t, (at, way) in enumerate(group.anchors):
            found, branch = way.row(row), len(branches)
            if found is None:
                continue
            for u, own, args in zip(group.units, way.keys, every, strict=True):
                for k in own:
                    for i in u.filters:
                        relation.add(branch, way.kind, k, ids[i], args)
            branches.append((branch, way, found))
            conditions = held(t, at if way.exact else None) + [~reduce(lambda a, b: a & b, held(before)) for before in range(t)]
            if conditions:
                whole = reduce(lambda a, b: a & b, conditions)
                test = F.when(F.col("__b") == branch, whole) if test is None else test.when(F.col("__b") == branch, whole)
    return relation, branches, test.otherwise(True) if test is not None else None


def with_branch(branch: int, kind: str, found: Column) -> Column:
    """Keys of a branch as structs, which those of all branches can be together."""
    key = lambda k: F.struct(F.lit(branch).alias("b"), (k if kind == "s" else F.lit("")).alias("s"), (k if kind == "y" else F.lit(0).cast("long")).alias("y"))
    return F.coalesce(F.transform(found, key), F.array().cast("array<struct<b:int,s:string,y:bigint>>"))


def fields_of(units: Iterator[Unit]) -> dict[str, bool]:
    """The fields that literals are about, and whether any wants a point."""
    out: dict[str, bool] = {}
    for x in chain.from_iterable(chain.from_iterable(u.terms) for u in units):
        for f in x.args if x.keyword == "match" else [x.field]:
            out[f] = out.get(f, False) or x.keyword == "geo"
    return out


@dataclass
class Prepared:
    """Filters in groups that are joined, and units that are expressions. It holds for any rows of the same kind."""

    groups: list[Group]
    rest: list[Unit]

    @classmethod
    def of(cls, normals: list[Terms], paths: bool, mode: str = "auto", join_from: int = JOIN_FROM) -> Prepared:
        by_shape: dict[tuple, list[Unit]] = defaultdict(list)
        for u in units_of(normals):
            by_shape[shape_of_unit(u)].append(u)
        out = cls([], [])
        for members in by_shape.values():
            found = Group.of(members, paths) if mode == "join" or mode == "auto" and len(members) >= join_from else None
            if found is None:
                out.rest += members
            else:
                out.groups.append(found)
        return out


def percolate(df: DataFrame, doc: str | None, normals: list, ids: list, keys: list[str], compiler: Compiler, *, mode: str = "auto", join_from: int = JOIN_FROM, name: str = "filter_id", prepared: Prepared | None = None) -> DataFrame:
    """``keys`` and the id of each filter that a row fulfils, once for each row and filter. Fields are columns, or those of
    the VARIANT column ``doc``. ``mode``: expression, join or auto. ``prepared``: what was made of the filters before.

    Rows with equal keys are rows of their own, each with its hits. Null keys are ordinary keys. Rows are read once. The
    relation of filters is broadcast up to BROADCAST_ROWS rows; beyond that rows and filters meet by a shuffle of the keys,
    and filters that are expressions take a pass of their own.
    """
    prepared = prepared or Prepared.of(normals, doc is not None, mode, join_from)
    groups, rest = prepared.groups, prepared.rest
    listed = [u for g in groups for u in g.units if not by_name(u)]
    df, row = Row.of(df, doc, fields_of(chain(rest, listed)), keys)
    rest = [u for u in rest if doc is not None or not never(row, u)]
    own = [F.col(quoted(k)) for k in keys]
    hits = holding(row, rest, compiler)
    if groups and not hits and len(listed) == sum(len(g.units) for g in groups) and all(map(one_bound, listed)) and sum(len(u.filters) for u in listed) <= BROADCAST_ROWS:
        return runs(df, row, listed, ids, own, name)
    relation, branches, test = joined(row, groups, ids, compiler)
    if not relation.rows:
        if not hits:
            return df.select(*own, F.lit(None).cast("string").alias(name)).limit(0)
        need = necessary(row, rest)
        source = df.filter(need) if need is not None else df
        made = arrays([F.when(c, F.lit(i)) for i, c in hits], "int")
        return named_ids(source.select(*own, F.explode(made).alias("__filter")).filter("`__filter` is not null"), ids, keys, name)
    apart_ = len(relation.rows) > BROADCAST_ROWS and hits
    if hits and not apart_:
        for i, _ in hits:
            relation.add(-1, "y", i, ids[i], {})
    # the fields of the row are read from the frame's own columns, so these stay until the other literals are tested
    if len(branches) == 1 and (apart_ or not hits):
        _, way, found = branches[0]
        met = df.withColumn("__key", way.only(row) if way.only else F.explode(found))
        on = F.col("__key") == F.col(f"__{way.kind}")
    else:
        each = [with_branch(n, way.kind, found) for n, way, found in branches]
        if hits and not apart_:
            each.append(arrays([F.when(c, F.struct(F.lit(-1).alias("b"), F.lit("").alias("s"), F.lit(i).cast("long").alias("y"))) for i, c in hits], ""))
        met = df.withColumn("__key", F.explode(F.concat(*each) if len(each) > 1 else each[0]))
        on = reduce(lambda a, b: a & b, [F.col(f"__key.{n}") == F.col(f"__{n}") for n in "bsy"])
    met = met.join(relation.frame(df.sparkSession), on)
    if test is not None:
        met = met.filter(test)
    out = met.select(*own, F.col("__id").alias(name))
    if apart_:
        made = arrays([F.when(c, F.lit(i)) for i, c in hits], "int")
        out = out.union(named_ids(df.select(*own, F.explode(made).alias("__filter")).filter("`__filter` is not null"), ids, keys, name))
    return out


def named_ids(out: DataFrame, ids: list, keys: list[str], name: str) -> DataFrame:
    """Numbers of filters replaced by their ids."""
    own = [F.col(quoted(k)) for k in keys]
    if len(ids) <= 2000:
        return out.select(*own, F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("__filter") + 1).alias(name))
    table = out.sparkSession.createDataFrame(pa.table({"__filter": pa.array(range(len(ids)), pa.int32()), "__id": pa.array(ids, pa.string())}))
    return out.join(F.broadcast(table) if len(ids) <= BROADCAST_ROWS else table, "__filter").select(*own, F.col("__id").alias(name))
