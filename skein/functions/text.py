"""Text expressions: ASCII folding, lines, sizes, budgets, comment filters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(c: Column) -> Column:
    """Only A-Z change; other capitals stay, as in byte-wise matching."""
    return F.translate(c, UPPER, LOWER)


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def smart_case(*needles: str) -> bool:
    """Whether to match without regard to case: no needle has a capital."""
    return not any(c.isupper() for n in needles for c in n)


def line_array(content: Column) -> Column:
    """Lines without their ends; what follows the last newline is a line only if it isn't empty."""
    parts = F.split(content, "\n")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    bare = F.transform(kept, lambda x: F.when(x.endswith("\r"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))
    return F.when(content.contains("\r"), bare).otherwise(kept)


def estimated_tokens(byte_count: Column) -> Column:
    """Four bytes a token, rounded up."""
    return F.ceil(byte_count / 4).cast("long")


def percent_budget(total: int, percent: int) -> int:
    """``percent`` of ``total``, rounded down, exact below 100 as well."""
    return total * percent // 100


def split_budget(total: int) -> dict[str, int]:
    """Header 2, body 85, footer 10 and emergency 3 percent."""
    return {k: percent_budget(total, p) for k, p in (("header", 2), ("body", 85), ("footer", 10), ("emergency", 3))}


def cut_bytes(text: str, most: int) -> str:
    """The longest prefix of whole characters within ``most`` bytes."""
    return text.encode()[:most].decode(errors="ignore")


def truncate_lines(text: str, most: int) -> tuple[str, int, int]:
    """Whole lines within ``most`` bytes, then how many are missing: ``(text, kept lines, dropped lines)``."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    if len(text.encode()) <= most:
        return text, len(lines), 0
    size = 0
    for i, line in enumerate(lines):
        footer = f"[{len(lines) - i} more lines]\n"
        if size + len(line.encode()) + 1 + len(footer) > most:
            return "".join(x + "\n" for x in lines[:i]) + footer, i, len(lines) - i
        size += len(line.encode()) + 1
    return "".join(x + "\n" for x in lines), len(lines), 0


def truncate_with_footer(payload: str, most: int, footer: str) -> str:
    return cut_bytes(payload, max(0, most - len(footer.encode()))) + footer


_COMMENT = re.compile(r"""("(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?)|(//|#(?=.))""", re.S)


def _comment_at(line: str) -> int:
    """Where a line comment starts outside quotes, or -1."""
    return next((m.start() for m in _COMMENT.finditer(line) if m[2]), -1)


def _each_line(text: str, f) -> str:
    out = []
    for line in text.splitlines(keepends=True) if "\n" in text else [text]:
        body = line.rstrip("\n").removesuffix("\r") if line.endswith("\n") else line
        out.append(f(body) + line[len(body) :])
    return "".join(out)


def _minimal(body: str) -> str:
    at = _comment_at(body)
    doc = at >= 0 and body[at : at + 3] in ("///", "//!") or body[at : at + 2] in ("#:", "#!")
    return (body if at < 0 or doc else body[:at]).rstrip()


def filter_text(text: str, level: str) -> str:
    """``none``; ``minimal``: no line comments but documentation ones; ``aggressive``: no comments, blank lines collapsed."""
    if level == "minimal":
        return _each_line(text, _minimal)
    if level == "aggressive":
        bare = _each_line(re.sub(r"/\*.*?\*/", "", text, flags=re.S), lambda b: b if _comment_at(b) < 0 else b[: _comment_at(b)].rstrip())
        return re.sub(r"(?m)(^[ \t]*\r?\n)(?:[ \t]*\r?\n)+", r"\1", bare)
    return text


def snippet(line: str, start: int, most: int = 180) -> str:
    """At most ``most`` characters around ``start``, a third of them before it."""
    if len(line) <= most:
        return line
    first = max(0, min(start - most // 3, len(line) - most))
    return ("…" if first else "") + line[first : first + most] + ("…" if first + most < len(line) else "")
