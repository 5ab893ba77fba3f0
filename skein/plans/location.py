"""Locations at the end of a query: ``file:12``, ``file:12:4``, ``file:12-40``, ``file:12:4-20``, ``file:12:4-14:20``, ``file(12)``, ``file(12,4)``."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Location:
    """``kind`` is line, position or range; columns are 0 where a range names lines alone."""

    kind: str
    start: tuple[int, int]
    end: tuple[int, int] | None = None


_N = r"([+-]?\d+)"
_SHAPES = [
    (re.compile(rf"{_N}:{_N}-{_N}:{_N}"), lambda a, b, c, d: Location("range", (a, b), (c, d)) if (c, d) >= (a, b) else Location("position", (a, b))),
    (re.compile(rf"{_N}:{_N}-{_N}"), lambda a, b, c: Location("range", (a, b), (a, c)) if c >= b else Location("line", (a, 0))),
    (re.compile(rf"{_N}-{_N}"), lambda a, b: Location("range", (a, 0), (b, 0)) if b >= a else Location("line", (a, 0))),
    (re.compile(rf"{_N}:{_N}"), lambda a, b: Location("position", (a, b))),
    (re.compile(_N), lambda a: Location("line", (a, 0))),
]
_PAREN = [(re.compile(_N), _SHAPES[4][1]), (re.compile(rf"{_N},{_N}"), _SHAPES[3][1])]


def _shape(text: str, shapes) -> Location | None:
    for pattern, build in shapes:
        if m := pattern.fullmatch(text):
            values = [int(x) for x in m.groups()]
            return build(*values) if all(-(2**31) <= v < 2**31 for v in values) else None
    return None


def parse_location(query: str) -> tuple[str, Location | None]:
    """The query without its location, and the location; without trailing ``:``, ``-`` and ``(`` in any case.

    A range that runs backwards degrades to its first line or position.
    """
    query = query.rstrip(":-(")
    path, colon, rest = query.partition(":")
    if colon and (found := _shape(rest, _SHAPES)):
        return path, found
    if query.endswith(")") and "(" in query:
        path, _, rest = query.rpartition("(")
        if found := _shape(rest.rstrip(")"), _PAREN):
            return path, found
    return query, None
