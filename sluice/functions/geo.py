"""Geopoints, geohashes and distances: parsers for filters on the driver, and the same as column expressions for rows."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8

#: Metres of each unit name.
UNITS = {
    "m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0,
    "km": 1000.0, "kilometer": 1000.0, "kilometers": 1000.0, "kilometre": 1000.0, "kilometres": 1000.0,
    "dm": 0.1, "cm": 0.01, "centimeter": 0.01, "centimeters": 0.01, "mm": 0.001, "millimeter": 0.001, "millimeters": 0.001,
    "ft": 0.3048, "foot": 0.3048, "feet": 0.3048, "in": 0.0254, "inch": 0.0254, "inches": 0.0254, "yd": 0.9144, "yard": 0.9144, "yards": 0.9144,
    "mi": 1609.34, "mile": 1609.34, "miles": 1609.34, "nmi": 1852.0, "nauticalmile": 1852.0, "nauticalmiles": 1852.0,
}
#: The characters of geohashes, by number, and what a geohash looks like.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
GEOHASH = r"^[0-9a-z]{4,}$"
#: Characters that a number to base 32 holds, and those that a geohash has in their place; others that it may have, its
#: last one a line's end, count as zero.
DIGITS, OTHERS = "0123456789abcdefghijklmnopqrstuv", "ailo\n\r\u0085\u2028\u2029"
#: Characters of a geohash whose bits a long holds, in whole pairs.
SHORT = 12
#: Fixed value: what a text that is no distance is told.
UNKNOWN_DISTANCE = 'unable to parse distance value "{text}"'
#: What a lenient float parser takes from the start of a string.
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def convert_distance(text: str) -> float:
    """Metres of a distance such as ``1 km`` or ``3 258,55 Ft``: a number and a unit, metres if there is none. Signs and
    white space are skipped wherever they stand, a comma is a point, the case of letters is without meaning."""
    kept = "".join("." if c == "," else c for c in text.lower() if c != "-" and not c.isspace())
    unit = kept.lstrip("0123456789.")
    number = kept[: len(kept) - len(unit)]
    if number.count(".") > 1 or not number.strip(".") or unit not in UNITS and unit:
        raise ValueError(UNKNOWN_DISTANCE.format(text=text))
    return float(number) * UNITS.get(unit, 1.0)


def _number(x: Any) -> float | None:
    if isinstance(x, bool) or x is None:
        return None
    if isinstance(x, (int, float)):
        return None if math.isnan(x) else float(x)
    m = re.match(NUMBER, x) if isinstance(x, str) else None
    return float(m[1]) if m else None


def _point(lat: Any, lon: Any) -> tuple[float, float] | None:
    a, b = _number(lat), _number(lon)
    return None if a is None or b is None else (a, b)


def decode_geohash(text: str) -> tuple[float, float]:
    """The middle of a geohash's cell; characters outside the alphabet count as its first."""
    low, size, axis = [-180.0, -90.0], [360.0, 180.0], 0
    for c in text:
        n = max(0, GEOHASH_ALPHABET.find(c))
        for bit in (16, 8, 4, 2, 1):
            size[axis] /= 2
            if n & bit:
                low[axis] += size[axis]
            axis ^= 1
    return low[1] + size[1] / 2, low[0] + size[0] / 2


def convert_geopoint(x: Any) -> tuple[float, float] | None:
    """(latitude, longitude) of a point as a pair, ``"lat, lon"``, a geohash, {lat, lon}, or any of these but a geohash
    under latLon or lat_lon (a geohash too if it is a string there); None for anything else."""
    if isinstance(x, str):
        parts = x.split(",")
        if len(parts) == 2:
            return _point(*parts)
        return decode_geohash(x) if re.match(GEOHASH, x) else None
    if isinstance(x, (list, tuple)):
        return _point(*x) if len(x) == 2 else None
    if not isinstance(x, dict):
        return None
    if "lat" in x and "lon" in x:
        return _point(x["lat"], x["lon"])
    inner = x.get("latLon", x.get("lat_lon"))
    if isinstance(inner, dict):
        return _point(inner["lat"], inner["lon"]) if "lat" in inner and "lon" in inner else None
    return convert_geopoint(inner) if isinstance(inner, (str, list, tuple)) else None


def number_column(text: Column) -> Column:
    return F.regexp_extract(text, NUMBER, 1).try_cast("double")


def point_of(lat: Column, lon: Column) -> Column:
    """A struct of both, or null if either is null or not a number."""
    return F.when(lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon), F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")))


def geohash_column(text: Column) -> Column:
    """The middle of a geohash's cell, as a struct: within generated code up to SHORT characters, beyond by a fold."""
    return F.when(F.length(text) <= SHORT, _short_geohash(text)).otherwise(_long_geohash(text))


def _short_geohash(text: Column) -> Column:
    """Its bits as text, of which every other one is the longitude's."""
    digits = F.rpad(F.translate(text, GEOHASH_ALPHABET + OTHERS, DIGITS + "0" * len(OTHERS)), SHORT, "0")
    bits, known = F.lpad(F.conv(digits, 32, 2), 5 * SHORT, "0"), F.length(text) * 5
    of = lambda pattern: F.conv(F.regexp_replace(bits, pattern, "$1"), 2, 10).cast("double") / F.lit(2.0 ** (5 * SHORT // 2))
    half = lambda n: F.lit(0.5) / F.pow(F.lit(2.0), F.floor(n / 2))
    return F.struct((-90 + 180 * (of(".(.)") + half(known))).alias("lat"), (-180 + 360 * (of("(.).") + half(known + 1))).alias("lon"))


def _long_geohash(text: Column) -> Column:
    code = lambda c: F.greatest(F.lit(0), F.instr(F.lit(GEOHASH_ALPHABET), c) - 1)
    bit = lambda n, k: F.shiftright(n, k).bitwiseAND(F.lit(1)).cast("double")
    three = lambda n: bit(n, 4) / 2 + bit(n, 2) / 4 + bit(n, 0) / 8
    two = lambda n: bit(n, 3) / 2 + bit(n, 1) / 4
    start = F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("w"), F.lit(0.0).alias("y"), F.lit(1.0).alias("h"), F.lit(False).alias("odd"))

    def step(a: Column, c: Column) -> Column:
        # of a character's five bits the first, third and fifth refine one axis, the others the other; the axes then swap
        n = code(c)
        return F.when(a["odd"], F.struct((a["x"] + a["w"] * two(n)).alias("x"), (a["w"] / 4).alias("w"), (a["y"] + a["h"] * three(n)).alias("y"), (a["h"] / 8).alias("h"), F.lit(False).alias("odd"))).otherwise(
            F.struct((a["x"] + a["w"] * three(n)).alias("x"), (a["w"] / 8).alias("w"), (a["y"] + a["h"] * two(n)).alias("y"), (a["h"] / 4).alias("h"), F.lit(True).alias("odd"))
        )

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda a: F.struct((-90 + 180 * (a["y"] + a["h"] / 2)).alias("lat"), (-180 + 360 * (a["x"] + a["w"] / 2)).alias("lon")))


def point_of_string(text: Column) -> Column:
    parts = F.split(text, ",", -1)
    pair = point_of(number_column(F.element_at(parts, 1)), number_column(F.element_at(parts, 2)))
    return F.when(F.size(parts) == 2, pair).when(text.rlike(GEOHASH), geohash_column(text))


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def metres_between(a: tuple[float, float], b: tuple[float, float]) -> float:
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(x)))


def in_polygon(lat: float, lon: float, ring: list) -> bool:
    """Even-odd rule over the closed ring; points on an edge are inside."""
    inside = False
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (x2 - x1) * (lat - y1) == (y2 - y1) * (lon - x1) and min(x1, x2) <= lon <= max(x1, x2) and min(y1, y2) <= lat <= max(y1, y2):
            return True
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def in_polygon_column(lat: Column, lon: Column, ring: Column) -> Column:
    """The same for an array of structs (lat, lon)."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, F.lit(1), F.lit(1))), lambda a, b: F.struct(a["lat"].alias("y1"), a["lon"].alias("x1"), b["lat"].alias("y2"), b["lon"].alias("x2")))
    on = F.exists(edges, lambda e: ((e["x2"] - e["x1"]) * (lat - e["y1"]) == (e["y2"] - e["y1"]) * (lon - e["x1"])) & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
    crossed = F.filter(edges, lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < F.try_divide((e["x2"] - e["x1"]) * (lat - e["y1"]), e["y2"] - e["y1"]) + e["x1"]))
    return on | (F.size(crossed) % 2 == 1)


def in_polygon_unrolled(lat: Column, lon: Column, ring: list) -> Column:
    """The same for a constant ring, edge by edge, behind a test of its box."""
    box = lat.between(min(p[0] for p in ring), max(p[0] for p in ring)) & lon.between(min(p[1] for p in ring), max(p[1] for p in ring))
    on, crossed = F.lit(False), F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        y1, x1, y2, x2 = map(float, (y1, x1, y2, x2))
        on = on | ((x2 - x1) * (lat - y1) == (y2 - y1) * (lon - x1)) & lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2))
        if y1 != y2:
            between = (lat >= min(y1, y2)) & (lat < max(y1, y2))
            crossed = crossed + F.when(between & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return box & (on | (crossed % 2 == 1))
