"""Approximate matching with an affine-gap alignment, run over Arrow batches behind a cheap filter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# 12 for a character and 4 for the same case, gaps, bonus for capitals, bonus for an exact match.
MATCH, SAME_CASE, GAP_OPEN, GAP_EXTEND, CAPITAL, EXACT, MISMATCH = 12, 4, 4, 2, 8, 100, 6


def align(needle: str, text: str, max_typos: int) -> tuple[int, int, list[int]] | None:
    """``(score, end, matched positions)`` of the best local alignment of the whole needle; None if more characters are missing than allowed."""
    if not needle:
        return 0, 0, []
    low, low_needle = text.lower() if len(text.lower()) == len(text) else text, needle.lower()
    if low_needle in low:
        at = low.find(low_needle)
        score = sum(MATCH + SAME_CASE * (a == b) for a, b in zip(needle, text[at:], strict=False))
        return score + (EXACT if text == needle else 0), at + len(needle) - 1, list(range(at, at + len(needle)))
    n, m, minus = len(needle), len(text), -(10**9)
    # best[t][j]: best score with the needle's characters so far matched up to text position j, t of them missing
    rows = [[0] * (m + 1) if t == 0 else [minus] * (m + 1) for t in range(max_typos + 1)]
    back = []
    for i in range(n):
        new = [[minus] * (m + 1) for _ in rows]
        trace = [[0] * (m + 1) for _ in rows]
        for t, row in enumerate(rows):
            run, run_at = minus, -1
            for j in range(1, m + 1):
                if row[j - 1] > minus:
                    here = row[j - 1] - (0 if i == 0 else GAP_OPEN)
                    if here > run - GAP_EXTEND:
                        run, run_at = here, j - 1
                    else:
                        run -= GAP_EXTEND if i else 0
                elif run > minus:
                    run -= GAP_EXTEND if i else 0
                if low[j - 1] != low_needle[i]:
                    continue
                gain = MATCH + SAME_CASE * (text[j - 1] == needle[i]) + CAPITAL * (text[j - 1].isupper() and j > 1 and text[j - 2].islower())
                straight = row[j - 1] if row[j - 1] > minus else minus
                best, prev = (straight, j - 1) if straight >= run else (run, run_at)
                if best > minus and best + gain > new[t][j]:
                    new[t][j], trace[t][j] = best + gain, prev + 1
            if t:
                for j in range(m + 1):
                    skipped = rows[t - 1][j] - MISMATCH if rows[t - 1][j] > minus else minus
                    if skipped > new[t][j]:
                        new[t][j], trace[t][j] = skipped, -(j + 1)
        rows, back = new, [*back, trace]
    score, t, j = max((row[j], -t, -j) for t, row in enumerate(rows) for j in range(m + 1))
    if score <= 0:
        return None
    t, j, end, hits = -t, -j, -j - 1, []
    for i in reversed(range(n)):
        step = back[i][t][j]
        if step < 0:
            t -= 1
        else:
            hits.append(j - 1)
            j = step - 1
    return score, end, hits[::-1]


def line_match(line: Column, needle: str) -> Column:
    """``struct<score, positions>`` where the line matches closely enough: spread and density of the matched characters are bounded."""
    typos, n = min(len(needle) // 3, 2), len(needle)

    @F.pandas_udf("struct<score:int,positions:array<int>>")
    def match(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            m = align(needle, t, typos) if t else None
            if m:
                span, gaps = m[2][-1] - m[2][0] + 1, sum(1 for a, b in zip(m[2], m[2][1:], strict=False) if b > a + 1)
                dense = len(m[2]) * 100 >= (45 if n >= 8 else 65) * span
                if span > 3 * n or gaps > max(n // 3, 2) or not dense:
                    m = None
            out.append((m[0], m[2]) if m else (None, None))
        return pd.DataFrame({"score": pd.array([x[0] for x in out], dtype="Int32"), "positions": [x[1] for x in out]})

    m = match(line)
    return F.when(m["score"].isNotNull(), m)


def path_score(path: Column, needle: str, max_typos: int) -> Column:
    """``struct<score, end, exact>`` of one needle on a path, null where it doesn't match."""

    @F.pandas_udf("struct<score:int,end_col:int,exact:boolean>")
    def score(paths: pd.Series) -> pd.DataFrame:
        out = [(m[0], m[1], p.lower() == needle.lower()) if p and (m := align(needle, p, max_typos)) else (None, None, None) for p in paths]
        return pd.DataFrame({"score": pd.array([x[0] for x in out], dtype="Int32"), "end_col": pd.array([x[1] for x in out], dtype="Int32"), "exact": pd.array([x[2] for x in out], dtype="boolean")})

    m = score(path)
    return F.when(m["score"].isNotNull(), m)


def longest_run(needle: str, text: str) -> int:
    """The longest piece of the needle that occurs in the text, without regard to case."""
    needle, text = needle.lower(), text.lower()
    return max((j - i for i in range(len(needle)) for j in range(i + 1, len(needle) + 1) if needle[i:j] in text), default=0)
