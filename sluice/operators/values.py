"""What a condition can ask of a field: columns that are null where the field is not of the kind asked for.

Two kinds of rows give fields: typed ones, whose schema decides at planning time (a SQL null is a missing field), and
VARIANT documents, where every row decides for itself (an explicit null is a value).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.geo import number_column, point_of, point_of_string

def holds(x: Column) -> Column:
    """Two-valued: unknown is false."""
    return F.coalesce(x, F.lit(False))


class Absent:
    """A field that no row has."""

    present = property(lambda self: F.lit(False))
    string = property(lambda self: F.lit(None).cast("string"))
    number = property(lambda self: F.lit(None).cast("double"))
    boolean = property(lambda self: F.lit(None).cast("boolean"))
    is_null = property(lambda self: F.lit(False))
    is_object = property(lambda self: F.lit(False))
    is_array = property(lambda self: F.lit(False))
    written = property(lambda self: F.lit(None).cast("string"))
    falsy = property(lambda self: F.lit(True))
    point = property(lambda self: F.lit(None).cast("struct<lat:double,lon:double>"))
    raw = property(lambda self: F.lit(None))

    def field(self, name: str) -> Absent:
        return self

    def any_element(self, test: Callable) -> Column:
        return F.lit(False)

    def elements(self) -> tuple[Column, Callable] | None:
        return None

    def element(self, index: int) -> Absent:
        return self

    @property
    def key(self) -> Column:
        return F.lit(None).cast("string")


class Typed:
    """A field of a typed row."""

    def __init__(self, col: Column, kind: T.DataType, point: Column | None = None) -> None:
        self.raw, self.kind, self._given_point = col, kind, point

    @property
    def present(self) -> Column:
        return self.raw.isNotNull()

    @property
    def string(self) -> Column:
        return self.raw if isinstance(self.kind, T.StringType) else F.lit(None).cast("string")

    @property
    def number(self) -> Column:
        if not isinstance(self.kind, T.NumericType):
            return F.lit(None).cast("double")
        return self.raw if isinstance(self.kind, T.DoubleType) else self.raw.cast("double")

    @property
    def boolean(self) -> Column:
        return self.raw if isinstance(self.kind, T.BooleanType) else F.lit(None).cast("boolean")

    is_null = property(lambda self: F.lit(False))

    @property
    def is_object(self) -> Column:
        return self.raw.isNotNull() if isinstance(self.kind, (T.StructType, T.MapType)) else F.lit(False)

    @property
    def is_array(self) -> Column:
        return self.raw.isNotNull() if isinstance(self.kind, T.ArrayType) else F.lit(False)

    @property
    def written(self) -> Column:
        """The value as text, for patterns that are tested on any value."""
        if isinstance(self.kind, T.ArrayType):
            inner = lambda x: F.coalesce(make(x, self.kind.elementType).written, F.lit(""))
            return F.array_join(F.transform(self.raw, inner), ",")
        if isinstance(self.kind, (T.StructType, T.MapType)):
            return F.when(self.raw.isNotNull(), F.lit("[object Object]"))
        return number_text(self.number) if isinstance(self.kind, T.NumericType) else self.raw.cast("string")

    @property
    def falsy(self) -> Column:
        if isinstance(self.kind, T.StringType):
            return self.raw.isNull() | (self.raw == "")
        if isinstance(self.kind, T.NumericType):
            return self.raw.isNull() | (self.raw == 0) | F.isnan(self.number)
        if isinstance(self.kind, T.BooleanType):
            return self.raw.isNull() | ~self.raw
        return self.raw.isNull()

    @property
    def coordinate(self) -> Column:
        return number_column(self.raw) if isinstance(self.kind, T.StringType) else self.number

    @property
    def point(self) -> Column:
        if self._given_point is not None:
            return self._given_point
        none = F.lit(None).cast("struct<lat:double,lon:double>")
        if isinstance(self.kind, T.StringType):
            return point_of_string(self.raw)
        if isinstance(self.kind, T.ArrayType):
            at = lambda i: make(F.try_element_at(self.raw, F.lit(i)), self.kind.elementType).coordinate
            return F.when(F.size(self.raw) == 2, point_of(at(1), at(2))) if isinstance(self.kind.elementType, (T.NumericType, T.StringType)) else none
        if isinstance(self.kind, (T.StructType, T.MapType)):
            lat, lon = self.field("lat"), self.field("lon")
            if isinstance(lat, Typed) and isinstance(lon, Typed):
                return point_of(lat.coordinate, lon.coordinate)
            for name in ("latLon", "lat_lon"):
                if isinstance(inner := self.field(name), Typed):
                    return inner.point
        return none

    def field(self, name: str) -> Typed | Absent:
        if isinstance(self.kind, T.StructType) and name in self.kind.names:
            return make(self.raw.getField(name), self.kind[name].dataType)
        if isinstance(self.kind, T.MapType) and isinstance(self.kind.keyType, T.StringType):
            return make(F.try_element_at(self.raw, F.lit(name)), self.kind.valueType)
        return Absent()

    def elements(self) -> tuple[Column, Callable] | None:
        return (self.raw, lambda x: make(x, self.kind.elementType)) if isinstance(self.kind, T.ArrayType) else None

    def any_element(self, test: Callable) -> Column:
        return holds(F.exists(self.raw, lambda x: test(make(x, self.kind.elementType)))) if isinstance(self.kind, T.ArrayType) else F.lit(False)

    def element(self, index: int) -> Typed | Absent:
        if not isinstance(self.kind, T.ArrayType):
            return Absent()
        return make(F.try_element_at(self.raw, F.lit(index + 1 if index >= 0 else index)), self.kind.elementType)

    @property
    def key(self) -> Column:
        """The value with its type as one string, equal for equal values; null for what is no scalar."""
        if isinstance(self.kind, T.StringType):
            return F.concat(F.lit("s:"), self.raw)
        if isinstance(self.kind, T.NumericType):
            return F.concat(F.lit("n:"), number_text(self.number))
        return F.concat(F.lit("b:"), self.raw.cast("string")) if isinstance(self.kind, T.BooleanType) else F.lit(None).cast("string")


class Loose:
    """A field of a VARIANT document."""

    def __init__(self, col: Column, kind: Column | None = None, point: Column | None = None) -> None:
        self.raw, self._given_kind, self._given_point = col, kind, point

    @cached_property
    def _kind(self) -> Column:
        return F.schema_of_variant(self.raw) if self._given_kind is None else self._given_kind

    present = cached_property(lambda self: self.raw.isNotNull())
    string = cached_property(lambda self: F.when(self._kind == "STRING", F.try_variant_get(self.raw, "$", "string")))
    boolean = cached_property(lambda self: F.when(self._kind == "BOOLEAN", F.try_variant_get(self.raw, "$", "boolean")))
    is_null = cached_property(lambda self: holds(F.is_variant_null(self.raw)))
    is_object = cached_property(lambda self: holds(self._kind.startswith("OBJECT")))
    is_array = cached_property(lambda self: holds(self._kind.startswith("ARRAY")))

    @cached_property
    def _numeric(self) -> Column:
        return self._kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | self._kind.startswith("DECIMAL")

    @cached_property
    def number(self) -> Column:
        return F.when(self._numeric, F.try_variant_get(self.raw, "$", "double"))

    @cached_property
    def _items(self) -> Column:
        return F.when(self._kind.startswith("ARRAY"), F.try_variant_get(self.raw, "$", "array<variant>"))

    @cached_property
    def written(self) -> Column:
        each = F.transform(self._items, lambda x: F.when(x.isNull() | F.is_variant_null(x), F.lit("")).otherwise(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))))
        return (
            F.when(self.is_null, F.lit("null")).when(self._kind.startswith("ARRAY"), F.array_join(each, ",")).when(self._kind.startswith("OBJECT"), F.lit("[object Object]"))
            .when(self._numeric, number_text(F.try_variant_get(self.raw, "$", "double"))).otherwise(F.try_variant_get(self.raw, "$", "string"))
        )

    @cached_property
    def falsy(self) -> Column:
        return self.raw.isNull() | self.is_null | holds(self.string == "") | holds(self.number == 0) | holds(~self.boolean)

    @cached_property
    def coordinate(self) -> Column:
        return F.coalesce(self.number, number_column(self.string))

    @cached_property
    def point(self) -> Column:
        if self._given_point is not None:
            return self._given_point
        lat, lon, inner = self.field("lat"), self.field("lon"), Loose(F.coalesce(self.field("latLon").raw, self.field("lat_lon").raw))
        pair = lambda v: F.when(F.size(v._items) == 2, point_of(v.element(0).coordinate, v.element(1).coordinate))
        below = F.coalesce(point_of(inner.field("lat").coordinate, inner.field("lon").coordinate), pair(inner), point_of_string(inner.string))
        return F.when(self.is_array, pair(self)).when(self._kind == "STRING", point_of_string(self.string)).when(self.is_object, F.when(lat.present & lon.present, point_of(lat.coordinate, lon.coordinate)).otherwise(below))

    def field(self, name: str) -> Loose | Absent:
        path = step(name)
        return Absent() if path is None else Loose(F.try_variant_get(self.raw, "$" + path, "variant"))

    def elements(self) -> tuple[Column, Callable]:
        return self._items, Loose

    def any_element(self, test: Callable) -> Column:
        return holds(F.exists(self._items, lambda x: test(Loose(x))))

    def element(self, index: int) -> Loose:
        return Loose(F.try_element_at(self._items, F.lit(index + 1 if index >= 0 else index)))

    @cached_property
    def key(self) -> Column:
        return (
            F.when(self._kind == "STRING", F.concat(F.lit("s:"), F.try_variant_get(self.raw, "$", "string"))).when(self._numeric, F.concat(F.lit("n:"), number_text(F.try_variant_get(self.raw, "$", "double"))))
            .when(self._kind == "BOOLEAN", F.concat(F.lit("b:"), F.try_variant_get(self.raw, "$", "string"))).when(self.is_null, F.lit("z"))
        )


def number_text(x: Column) -> Column:
    """A double as text; whole ones without a fraction, as the language has one kind of number."""
    return F.when((F.abs(x) < 2**53) & (x == F.floor(x)), F.floor(x).cast("string")).otherwise(x.cast("string"))


def key_of(value) -> str:
    """The key of a filter's scalar."""
    if value is None:
        return "z"
    if isinstance(value, bool):
        return f"b:{str(value).lower()}"
    if isinstance(value, str):
        return f"s:{value}"
    return f"n:{int(value)}" if float(value).is_integer() and abs(value) < 2**53 else f"n:{java_double(float(value))}"


def java_double(x: float) -> str:
    """A double as Spark writes it."""
    text = repr(abs(x))
    mantissa, _, exponent = text.partition("e")
    digits = mantissa.replace(".", "")
    point = mantissa.index(".") if "." in mantissa else len(mantissa)
    power = point + int(exponent or 0)
    lead = len(digits) - len(digits.lstrip("0"))
    digits, power = digits.lstrip("0").rstrip("0") or "0", power - lead
    if 1e-3 <= abs(x) < 1e7:
        digits = digits.ljust(power, "0") if power > 0 else "0" * (1 - power) + digits
        power = max(power, 1)
        out = f"{digits[:power]}.{digits[power:] or '0'}"
    else:
        out = f"{digits[0]}.{digits[1:] or '0'}E{power - 1}"
    return "-" + out if x < 0 else out


def step(name: str) -> str | None:
    """A key in the notation of variant paths; None if it can't be written there."""
    if "'" not in name:
        return f"['{name}']"
    return f'["{name}"]' if '"' not in name else None


def make(col: Column, kind: T.DataType) -> Typed | Loose:
    return Loose(col) if isinstance(kind, T.VariantType) else Typed(col, kind)


def parsed(kind: T.DataType) -> bool:
    """Whether a point of this kind may be made of texts, or of a document, which takes long."""
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.valueType] if isinstance(kind, T.MapType) else []
    return isinstance(kind, (T.StringType, T.VariantType)) or any(map(parsed, inner))


class Row:
    """Fields by path. ``field("a.b")`` is the top-level key ``a.b`` if there is one, else ``b`` below ``a``."""

    def __init__(self, roots: dict[str, Typed | Loose | Absent] | None = None, whole: bool = False, document: Column | None = None, points: dict[str, Column] | None = None) -> None:
        self.roots, self.whole, self.document, self.points = roots or {}, whole, document, points or {}

    @classmethod
    def of(cls, df: DataFrame, doc: str | None, fields: dict[str, bool], keys: list[str]) -> tuple[DataFrame, Row]:
        """The frame to test and its fields: its columns, or those of its VARIANT column ``doc``. ``fields``: the paths
        asked for, and whether as points. Of a document, each field asked for becomes columns (the value, its kind, its
        point), so that many conditions on it share the work; of typed rows, the points that are parsed."""
        if doc is None:
            row = cls({f.name: make(F.col(quoted(f.name)), f.dataType) for f in df.schema.fields})
            found = {p: x.point for p in sorted(fields) if fields[p] and (isinstance(x := row.field(p), Loose) or isinstance(x, Typed) and parsed(x.kind))}
            row.points = {p: F.col(f"__point_{i}") for i, p in enumerate(found)}
            return df.select("*", *[c.alias(f"__point_{i}") for i, c in enumerate(found.values())]) if found else df, row
        paths = sorted(fields)
        found = {f"v_{i}": c for i, p in enumerate(paths) if (c := at_path(F.col(quoted(doc)), p)) is not None}
        df = df.select(*[F.col(quoted(k)) for k in keys], F.col(quoted(doc)).alias("v_doc"), *[c.alias(n) for n, c in found.items()])
        df = df.select("*", *[F.schema_of_variant(n).alias(f"{n}_kind") for n in found])
        points = [f"v_{i}" for i, p in enumerate(paths) if fields[p] and f"v_{i}" in found]
        if points:
            df = df.select("*", *[Loose(F.col(n), F.col(f"{n}_kind")).point.alias(f"{n}_point") for n in points])
        return df, cls({p: Loose(F.col(f"v_{i}"), F.col(f"v_{i}_kind"), F.col(f"v_{i}_point") if f"v_{i}" in points else None) if f"v_{i}" in found else Absent() for i, p in enumerate(paths)}, True, F.col("v_doc"))

    def field(self, path: str) -> Typed | Loose | Absent:
        if path in self.roots or self.whole:
            found = self.roots[path]
        else:
            found = below(lambda name: self.roots.get(name, Absent()), path.split("."))
        if path in self.points:
            return Loose(found.raw, point=self.points[path]) if isinstance(found, Loose) else Typed(found.raw, found.kind, self.points[path])
        return found


def below(get: Callable[[str], Typed | Loose | Absent], parts: list[str]) -> Typed | Loose | Absent:
    """A field by the parts of its path; a key may hold dots and so stand for several parts, the longest key first."""
    for n in range(len(parts), 0, -1):
        value, rest = get(".".join(parts[:n])), parts[n:]
        if rest and isinstance(value, Loose):
            inner = at_path(value.raw, ".".join(rest))
            return Absent() if inner is None else Loose(inner)
        if rest and isinstance(value, Typed):
            # any key may be in a map: there the shortest first, as long as it leads on
            found = below(value.field, rest) if not isinstance(value.kind, T.MapType) else next((x for k in range(1, len(rest) + 1) if not isinstance(x := below(value.field(".".join(rest[:k])).field, rest[k:]) if rest[k:] else value.field(".".join(rest[:k])), Absent)), Absent())
            if not isinstance(found, Absent):
                return found
        elif not rest and not isinstance(value, Absent):
            return value
    return Absent()


#: Parts of a path up to which a key may stand for any of them together; longer paths are one key, or one for each part.
MOST_PARTS = 6


def ways(parts: list[str]) -> list[list[str]]:
    """The keys that a path may be made of: a key may hold dots. The longest keys first."""
    if len(parts) > MOST_PARTS:
        return [[".".join(parts)], parts]
    if not parts:
        return [[]]
    return [[".".join(parts[:n]), *rest] for n in range(len(parts), 0, -1) for rest in ways(parts[n:])]


def at_path(document: Column, path: str) -> Column | None:
    """The value of a VARIANT document at a path; None for paths that can't be written."""
    steps = [[step(k) for k in way] for way in ways(path.split("."))]
    found = [F.try_variant_get(document, "$" + "".join(way), "variant") for way in steps if None not in way]
    return F.coalesce(*found) if len(found) > 1 else found[0] if found else None


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
