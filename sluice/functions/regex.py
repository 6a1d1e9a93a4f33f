"""Filters' regular expressions as Java ones, which Spark runs."""

from __future__ import annotations

import re

FLAGS = {"i": "iu", "m": "m", "s": "s", "g": "", "y": "", "u": ""}


def java_pattern(value: str, flags: str | None = None, engine: str = "re2") -> str:
    """The Java pattern that finds what ``value`` finds. ``engine`` re2 refuses look-around and back-references, which js
    allows; flags g and y are without effect, as a search has no state. Raises ValueError for what can't be a pattern."""
    unknown = [f for f in flags or "" if f not in FLAGS]
    if unknown or len(set(flags or "")) < len(flags or ""):
        raise ValueError(f"invalid flags: {flags}")
    out, i, in_class, multiline = [], 0, False, "m" in (flags or "")
    while i < len(value):
        c, two = value[i], value[i : i + 2]
        if c == "\\":
            if len(two) < 2:
                raise ValueError("trailing backslash at end of expression")
            if two[1] in "123456789" and not in_class and engine == "re2":
                raise ValueError(f"invalid escape sequence: {two}")
            out.append(two)
            i += 2
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\[" if c == "[" and value[i : i + 2] != "[:" else "\\&" if two == "&&" else c)
        elif c == "[":
            in_class = True
            if two == "[]":  # matches nothing
                out.append("(?!)")
                in_class, i = False, i + 2
                continue
            if value[i : i + 3] == "[^]":  # matches anything
                out.append(r"[\s\S]")
                in_class, i = False, i + 3
                continue
            out.append(c)
        elif two == "(?":
            if m := re.match(r"\(\?(=|!|<=|<!)", value[i:]):
                if engine == "re2":
                    raise ValueError(f"invalid perl operator: {m[0]}")
                out.append(m[0])
                i += len(m[0])
                continue
            if value.startswith("(?P<", i):
                out.append("(?<")
                i += 4
                continue
            out.append(c)
        elif c == "$" and not multiline:
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise ValueError("missing closing ]")
    found = "".join(out)
    try:
        re.compile(found.replace(r"\z", r"\Z").replace("(?<", "(?P<") if "(?<=" not in found and "(?<!" not in found else found.replace(r"\z", r"\Z"))
    except re.error as e:
        if not re.search(r"\\[pPxk]|[+*?}]\+|\[:", found):  # what Java knows and Python doesn't
            raise ValueError(str(e)) from None
    named = "d" + "".join(FLAGS[f] for f in flags or "")
    return f"(?{named}){found}"
