"""Conditions as two-valued boolean columns. The arguments are constants, or columns of a relation of filters."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.geo import in_polygon_column, in_polygon_unrolled, metres
from sluice.functions.regex import java_pattern
from sluice.operators.values import Absent, Row, holds
from sluice.plans.language import Literal, Reader


#: Vertices of a polygon that is written out as arithmetic at most.
UNROLLED = 64


class Compiler:
    """``engine``: the dialect of regular expressions."""

    def __init__(self, engine: str = "re2") -> None:
        self.engine = engine

    def tree(self, row: Row, tree: Any) -> Column:
        """A whole tree of the language."""
        from sluice.plans.language import All

        if isinstance(tree, Literal):
            return self.condition(row, tree)
        parts = [self.tree(row, p) for p in tree.parts]
        if isinstance(tree, All):
            return reduce(lambda a, b: a & b, parts, F.lit(True)) if len(parts) != 1 else parts[0]
        return reduce(lambda a, b: a | b, parts, F.lit(False)) if len(parts) != 1 else parts[0]

    def condition(self, row: Row, x: Literal, args: dict[str, Column] | None = None) -> Column:
        """``args``: columns instead of the literal's own arguments (see ``columns_of``)."""
        if x.keyword == "equals":
            value = row.field(x.field)
            return self._signed(holds(value.key == args["key"]) if args else equal(value, x.args), x.negated)
        if x.keyword == "range":
            value = row.field(x.field).number
            return self._signed(holds(within(value, args) if args else bounded(value, x.args)), x.negated)
        if x.keyword == "regexp":
            value = row.field(x.field)
            pattern = args["pattern"] if args else F.lit(java_pattern(x.args["value"], x.args["flags"], self.engine))
            if x.negated:  # tested on any value's text: not the complement
                return F.lit(True) if isinstance(value, Absent) else ~holds(value.present) | holds(~F.regexp_like(value.written, pattern))
            return holds(F.regexp_like(value.string, pattern))
        if x.keyword == "exists":
            value = row.field(x.field)
            if not x.args["array"]:
                return self._signed(holds(value.present), x.negated)
            if args:
                return self._signed(value.any_element(lambda e: holds(e.key == args["key"])), x.negated)
            return self._signed(value.any_element(lambda e: equal(e, x.args["value"])) if not isinstance(x.args["value"], (dict, list)) else F.lit(False), x.negated)
        if x.keyword == "match":
            found = reduce(lambda a, b: a & b, [matching(row.field(k), v) for k, v in x.args.items()])
            return self._signed(found, x.negated)
        if x.keyword == "select":
            value = row.field(x.field).element(x.args["index"])
            inner = self.tree(Row({"value": value}), Reader(self.engine).read(x.args["query"])) if not isinstance(value, Absent) else F.lit(False)
            held = row.field(x.field)
            index = x.args["index"]
            size = F.size(held.elements()[0]) if held.elements() is not None else None
            there = holds(size > index if index >= 0 else size >= -index) if size is not None else F.lit(False)
            return self._signed(there & inner, x.negated)
        if x.keyword == "geo":
            value = row.field(x.field)
            point = value.point
            if x.args["shape"] == "polygon" and not args and len(x.args["ring"]) <= UNROLLED:
                inside = holds(in_polygon_unrolled(point["lat"], point["lon"], x.args["ring"]))
            else:
                inside = holds(in_shape(point["lat"], point["lon"], x.args["shape"], args or shape_columns(x.args)))
            if not x.negated:
                return point.isNotNull() & inside
            return F.when(value.falsy, True).when(point.isNull(), False).otherwise(~inside)
        raise AssertionError(x.keyword)

    @staticmethod
    def _signed(held: Column, negated: bool) -> Column:
        return ~held if negated else held


def equal(value: Any, to: Any) -> Column:
    """Strict: of the same type and equal."""
    if to is None:
        return value.is_null
    if isinstance(to, bool):
        return holds(value.boolean == to)
    return holds(value.string == to) if isinstance(to, str) else holds(value.number == float(to))


def bounded(value: Column, bounds: dict) -> Column:
    return compared(value, bounds) & ~F.isnan(value)


def compared(value: Column, bounds: dict) -> Column:
    """The bounds alone: a NaN, which sorts above all numbers, may pass."""
    tests = {"gt": lambda v: value > v, "gte": lambda v: value >= v, "lt": lambda v: value < v, "lte": lambda v: value <= v}
    return reduce(lambda a, b: a & b, [tests[k](float(v)) for k, v in bounds.items()])


def within(value: Column, args: dict[str, Column]) -> Column:
    low = F.when(args["low_in"], value >= args["low"]).otherwise(value > args["low"])
    high = F.when(args["high_in"], value <= args["high"]).otherwise(value < args["high"])
    return low & high & ~F.isnan(value)


def matching(value: Any, pattern: Any) -> Column:
    """Whether a value holds all of a pattern: objects key by key, arrays element by element, each of the row's elements
    taken by the first of the pattern's that it fits."""
    if isinstance(pattern, dict):
        return reduce(lambda a, b: a & b, [matching(value.field(k), v) for k, v in pattern.items()], holds(value.is_object))
    if not isinstance(pattern, list):
        return equal(value, pattern)
    if value.elements() is None:
        return F.lit(False)
    items, of = value.elements()
    if all(not isinstance(p, (dict, list)) for p in pattern):
        return reduce(lambda a, b: a & b, [holds(F.size(F.filter(items, equals_(of, p))) >= sum(same(p, q) for q in pattern)) for p in pattern], holds(value.is_array))

    def fits(x: Column, k: Column) -> Column:
        out = None
        for i, p in enumerate(pattern):
            test = matching(of(x), p)
            out = F.when(k == i, test) if out is None else out.when(k == i, test)
        return out

    def take(left: Column, k: Column) -> Column:
        # the position is bound by an inner fold, so that it is found once
        at = F.array(F.array_position(F.transform(left, lambda x: fits(x, k)), True).cast("int"))
        return F.aggregate(at, left, lambda rest, i: F.when(i > 0, F.concat(F.slice(rest, F.lit(1), i - 1), F.slice(rest, i + 1, F.size(rest)))))

    order = F.array(*[F.lit(i) for i in range(len(pattern))])
    return holds(value.is_array) & F.aggregate(order, items, take).isNotNull()


def equals_(of: Any, to: Any) -> Any:
    return lambda x: equal(of(x), to)


def same(a: Any, b: Any) -> bool:
    return type(a) is type(b) and a == b or not isinstance(a, bool) and not isinstance(b, bool) and isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b


def shape_columns(args: dict) -> dict[str, Column]:
    if args["shape"] == "polygon":
        return {"ring": F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in args["ring"]])}
    return {k: F.lit(float(v)) for k, v in args.items() if k != "shape"}


def in_shape(lat: Column, lon: Column, shape: str, args: dict[str, Column]) -> Column:
    """Borders are inside."""
    if shape == "box":
        return lat.between(args["bottom"], args["top"]) & lon.between(args["left"], args["right"])
    if shape == "ring":
        return metres(lat, lon, args["lat"], args["lon"]).between(args["from"], args["to"])
    return in_polygon_column(lat, lon, args["ring"])
