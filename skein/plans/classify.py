"""What a raw query asks for, and the call that answers it."""

from __future__ import annotations

import re
from collections.abc import Callable

from skein.plans.dsl import has_wildcards
from skein.plans.location import parse_location


def classify(raw: str, exists: Callable[[str], bool]) -> str:
    """``location``, ``path``, ``glob``, ``symbol``, ``concept`` or ``other``, tried in this order."""
    text = raw.strip()
    path, location = parse_location(text)
    if location and location.kind != "range" and exists(path):
        return "location"
    if text and exists(text):
        return "path"
    if has_wildcards(text) and " " not in text:
        return "glob"
    if re.fullmatch(r"[A-Za-z_$][\w$]*(?:(?:::|\.)[A-Za-z_$][\w$]*)*", text):
        return "symbol"
    return "concept" if " " in text else "other"


def dispatch(raw: str, exists: Callable[[str], bool], symbols: Callable, prefix: Callable, globs: Callable, read: Callable, content: Callable):
    """``(kind, result)``; a symbol that isn't known is tried as a prefix, then as content."""
    kind = classify(raw, exists)
    if kind in ("location", "path"):
        return kind, read(*parse_location(raw.strip()) if kind == "location" else (raw.strip(), None))
    if kind == "glob":
        return kind, globs(raw.strip())
    if kind == "symbol":
        for name, find in (("symbol", symbols), ("prefix", prefix)):
            found = find(raw.strip())
            if found is not None:
                return name, found
    return "content", content(raw.strip())


class Cursors:
    """Opaque page marks; the oldest of more than ``most`` are forgotten."""

    def __init__(self, most: int = 20) -> None:
        self.most, self.offsets, self.next = most, {}, 1

    def put(self, offset: int) -> str:
        mark = f"c{self.next}"
        self.next += 1
        self.offsets[mark] = offset
        while len(self.offsets) > self.most:
            del self.offsets[next(iter(self.offsets))]
        return mark

    def get(self, mark: str) -> int | None:
        return self.offsets.get(mark)
