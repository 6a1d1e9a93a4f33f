"""Flat documents: every field by its dotted path, parents included, arrays whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.values import quoted


def flatten(document: dict) -> dict:
    """Of one document. A key that holds a dot stands beside the path that reads the same; the later one wins."""
    out, left = {}, [("", document)]
    while left:
        prefix, part = left.pop()
        for key, value in part.items():
            path = f"{prefix}.{key}" if prefix else key
            out[path] = value
            if isinstance(value, dict):
                left.append((path, value))
    return out


def flat_fields(df: DataFrame, doc: str, keys: list[str], depth: int | None = None) -> DataFrame:
    """``keys``, ``path`` and ``value`` (VARIANT) of each field of the documents, at any depth; null documents and those that
    are no objects have none. A key that holds a dot stands beside the path that reads the same. Keys may be called
    anything, ``path`` too.

    ``depth``: the levels that documents have at most, if known; a deeper one is an error. Else a pass over the documents
    finds it. One pass over the documents for the fields, no shuffle.
    """
    names = [f"key_{i}" for i in range(len(keys))]
    df = df.select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names, strict=True)], F.col(quoted(doc)).alias("doc"))
    if depth is None:
        depth = df.agg(F.max(_levels(F.to_json("doc")))).first()[0] or 0
    level, levels = _entries(F.col("doc"), F.lit("")), []
    df = df.withColumn("level_0", level)
    for n in range(1, depth):
        df = df.withColumn(f"level_{n}", F.flatten(F.transform(f"level_{n - 1}", lambda e: _entries(e["value"], F.concat(e["path"], F.lit("."))))))
    levels = [F.coalesce(f"level_{n}", F.array().cast(ENTRIES)) for n in range(max(1, depth))]
    deeper = F.exists(levels[-1], lambda e: F.size(_entries(e["value"], F.lit(""))) > 0)
    found = F.when(deeper, F.raise_error(F.lit(f"a document has more than {depth} levels")).cast(ENTRIES)).otherwise(F.concat(*levels))
    return df.select(*names, F.inline(found)).toDF(*keys, "path", "value")


ENTRIES = "array<struct<path:string,value:variant>>"


def _entries(value: Column, start: Column) -> Column:
    """The fields of an object; none of anything else."""
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    fields = F.when(F.schema_of_variant(value).startswith("OBJECT"), fields)
    return F.coalesce(F.transform(fields, lambda f: F.struct(F.concat(start, f["key"]).alias("path"), f["value"].alias("value"))), F.array().cast(ENTRIES))


def _levels(json: Column) -> Column:
    """How deep brackets of objects nest in a JSON text: what is escaped goes, then strings do, then all but the brackets."""
    bare = F.regexp_replace(F.regexp_replace(json, r"\\.", ""), '"[^"]*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, zero, step, lambda acc: acc["most"])
