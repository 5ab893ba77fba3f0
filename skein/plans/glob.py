"""Globs to regular expressions, once per query on the driver."""

from __future__ import annotations

import re


def glob_regex(pattern: str, star_crosses: bool = True) -> str:
    """A whole-path expression that Java, Python and RE2 read alike.

    ``star_crosses`` lets ``*`` and ``?`` match ``/`` (constraints); without it only ``**`` crosses directories (file globs).
    Braces are alternatives and may be nested; an unclosed bracket or brace is literal.
    """
    one = "." if star_crosses else "[^/]"
    out, i, depth = [], 0, 0
    closes = pattern.count("}") >= pattern.count("{")
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            run = len(pattern) - i - len(pattern[i:].lstrip("*"))
            before, after = i == 0 or pattern[i - 1] == "/", pattern[i + run : i + run + 1]
            if run >= 2 and before and after == "/":
                out.append("(?:.*/)?")
                i += run + 1
                continue
            out.append(".*" if run >= 2 and before and not after else f"{one}*")
            i += run
            continue
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "?":
            out.append(one)
        elif c == "[" and end > 0:
            inner = pattern[i + 1 : end]
            negated = inner[0] in "!^"
            inner = (inner[1:] if negated else inner).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' if negated else ''}{inner}]")
            i = end
        elif c == "{" and closes:
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"
