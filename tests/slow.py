"""A plain evaluator of the filter language on one document, to hold the columns against."""

import math
import re

from sluice.functions.geo import convert_geopoint, in_polygon, metres_between
from sluice.operators.conditions import same
from sluice.plans.language import All, Literal, Reader

GONE = object()


def flatten(doc, prefix=""):
    out = {}
    for k, v in doc.items():
        name = f"{prefix}.{k}" if prefix else k
        out[name] = v
        if isinstance(v, dict):
            out.update(flatten(v, name))
    return out


def number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def equal(v, to):
    return v is not GONE and (same(v, to) if number(v) and number(to) else type(v) is type(to) and v == to)


def match(v, p):
    if v is GONE:
        return False
    if isinstance(p, dict):
        return isinstance(v, dict) and all(match(v.get(k, GONE), x) for k, x in p.items())
    if isinstance(p, list):
        if not isinstance(v, list):
            return False
        left = list(v)
        for x in p:
            at = next((i for i, y in enumerate(left) if match(y, x)), None)
            if at is None:
                return False
            del left[at]
        return True
    return not isinstance(v, (dict, list)) and equal(v, p)


def text(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return ",".join("" if x is None else text(x) for x in v)
    if isinstance(v, dict):
        return "[object Object]"
    return str(int(v)) if number(v) and float(v).is_integer() else str(v)


def positive(x, flat):
    a = x.args
    v = flat.get(x.field, GONE)
    if x.keyword == "equals":
        return equal(v, a)
    if x.keyword == "range":
        return number(v) and not math.isnan(v) and all({"gt": v > b, "gte": v >= b, "lt": v < b, "lte": v <= b}[k] for k, b in a.items())
    if x.keyword == "regexp":
        flags = re.A * ("i" not in a["flags"])
        return isinstance(v, str) and bool(re.search(a["value"].replace("$", r"\Z"), v, flags | re.I * ("i" in a["flags"])))
    if x.keyword == "exists":
        return v is not GONE if not a["array"] else isinstance(v, list) and any(equal(e, a["value"]) for e in v if not isinstance(a["value"], (dict, list)))
    if x.keyword == "match":
        return all(match(flat.get(k, GONE), p) for k, p in a.items())
    if x.keyword == "select":
        i = a["index"]
        if not isinstance(v, list) or not -len(v) <= i < len(v):
            return False
        return tree(Reader("js").read(a["query"]), {"value": v[i]})
    raise AssertionError(x.keyword)


def geo(x, v):
    p, a = (convert_geopoint(v), x.args) if v is not GONE else (None, x.args)
    if not x.negated:
        return p is not None and inside(p, a)
    falsy = v is GONE or v is None or v is False or v == "" or number(v) and v == 0
    return True if falsy else p is not None and not inside(p, a)


def inside(p, a):
    if a["shape"] == "box":
        return a["bottom"] <= p[0] <= a["top"] and a["left"] <= p[1] <= a["right"]
    if a["shape"] == "ring":
        return a["from"] <= metres_between(p, (a["lat"], a["lon"])) <= a["to"]
    return in_polygon(*p, a["ring"])


def tree(t, doc):
    if isinstance(t, Literal):
        flat = flatten(doc)
        if t.keyword == "geo":
            return geo(t, flat.get(t.field, GONE))
        if t.keyword == "regexp" and t.negated:
            v = flat.get(t.field, GONE)
            return v is GONE or not re.search(t.args["value"], text(v), re.I * ("i" in t.args["flags"]))
        return positive(t, flat) != t.negated
    return (all if isinstance(t, All) else any)(tree(p, doc) for p in t.parts)
