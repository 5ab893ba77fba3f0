"""Budgeted reading, mentions in prompts, and result text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.paths import is_generated, name_of
from skein.functions.text import estimated_tokens, filter_text, fold_ascii, fold_text, split_budget, truncate_lines, truncate_with_footer

MOST_BYTES = 64 * 1024
MENTIONS = 15


def budgeted(content: Column, total_tokens: int, level: str = "none") -> Column:
    """``struct<body, kept_lines, dropped_lines>``: filtered and cut to whole lines within the body's share of the budget."""
    most = min(split_budget(total_tokens)["body"] * 4, MOST_BYTES)

    @F.pandas_udf("struct<body:string,kept_lines:int,dropped_lines:int>")
    def read(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([truncate_lines(filter_text(c or "", level), most) for c in contents], columns=["body", "kept_lines", "dropped_lines"])

    return read(content)


def level_for(path: str, level: str) -> str:
    """Test files are never filtered."""
    return "none" if re.search(r"\.test\.|\.spec\.|__tests__/", path) else level


def lines_within(lines: DataFrame, total_tokens: int) -> DataFrame:
    """Lines of each file that fit the body's share of the budget: a running sum per file, for many files at once."""
    from pyspark.sql import Window as W

    most = split_budget(total_tokens)["body"] * 4
    w = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("upto", F.sum(F.octet_length("text") + 1).over(w)).where(F.col("upto") <= most)


def section(text: str, start: int, end: int | None = None) -> str:
    """Lines ``start`` to ``end``, from 1; a range that runs backwards is its first line, 0 counts as 1."""
    rows = [x.removesuffix("\r") for x in text.split("\n")]
    start = max(1, start)
    end = start if end is None or end < start else end
    return "\n".join(rows[start - 1 : end])


def cascade(full: str, outline: str, signatures: str, most: int) -> tuple[str, str]:
    """The richest of full text, outline and signatures that fits, else the signatures cut to whole lines."""
    for kind, text in (("full", full), ("outline", outline), ("signatures", signatures)):
        if len(text.encode()) <= most:
            return kind, text
    return "truncated", truncate_lines(signatures, most)[0]


def views(files: DataFrame, structures: DataFrame, mode: str = "outline", total_tokens: int = 25_000) -> DataFrame:
    """``path, view, body``: code files as outlines or as ``signatures``, within the body's share of the budget.

    An outline that doesn't fit gives way to the signatures, these to as many bytes of the outline as fit. Generated files are marked.
    """
    most = split_budget(total_tokens)["body"] * 4 or total_tokens * 4
    place = lambda e: F.concat(F.repeat(F.lit("  "), e["depth"]), F.lit("["), e["start_line"].cast("string"), F.lit("-"), e["end_line"].cast("string"), F.lit("] "))
    line = lambda e: F.concat(place(e), e["signature"], F.when(F.coalesce(e["doc"], F.lit("")) != "", F.concat(F.lit("  // "), e["doc"])).otherwise(""))
    text = lambda one: F.array_join(F.transform("s.entries", one), "\n")
    mark = F.when(is_generated(F.col("path"), F.col("content")), "[generated file]\n").otherwise("")
    joined = structures.join(files.select("path", "content"), "path")
    f = joined.select("path", F.concat(mark, text(line)).alias("outline"), text(lambda e: e["signature"]).alias("signatures"))
    fits = lambda c: F.octet_length(c) <= most
    if mode == "signatures":
        return f.select("path", F.lit("signatures").alias("view"), F.col("signatures").alias("body"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else truncate_with_footer(t, most, "[truncated to budget]\n"))

    view = F.when(fits("outline"), "outline").when(fits("signatures"), "signatures").otherwise("truncated")
    f = f.withColumn("view", view)
    long = cut(F.when(F.col("view") == "truncated", F.col("outline")))
    return f.select("path", "view", F.when(F.col("view") == "outline", F.col("outline")).when(F.col("view") == "signatures", F.col("signatures")).otherwise(long).alias("body"))


def sections(files: DataFrame, structures: DataFrame, points: DataFrame) -> DataFrame:
    """``path, line, name, kind, start_line, end_line, body``: the deepest definition around each of ``points(path, line)``; points outside any are left out."""
    entries = structures.select("path", F.explode("s.entries").alias("e"))
    around = points.select("path", "line").distinct().join(entries, "path").where(F.col("line").between(F.col("e.start_line"), F.col("e.end_line")))
    deepest = around.groupBy("path", "line").agg(F.max(F.struct("e.depth", "e.start_line", "e.end_line", "e.name", "e.kind")).alias("e"))
    rows = F.slice(F.split("content", "\n"), F.col("e.start_line"), F.col("e.end_line") - F.col("e.start_line") + 1)
    return deepest.join(files.select("path", "content"), "path").select("path", "line", "e.name", "e.kind", "e.start_line", "e.end_line", F.array_join(rows, "\n").alias("body"))


def mentioned(files: DataFrame, text: str, total_tokens: int = 4000, level: str = "minimal") -> DataFrame:
    """``path, body, tokens`` of files whose path holds any of the words in ``text``, case matters, each filtered and cut to the budget."""
    words = list(dict.fromkeys(text.split()))
    if not words:
        return files.select("path", F.lit("").alias("body"), F.lit(0).cast("long").alias("tokens")).limit(0)
    named = files.where(reduce(or_, (F.col("path").contains(w) for w in words)))
    read = named.select("path", budgeted(F.col("content"), total_tokens, level)["body"].alias("body"))
    return read.withColumn("tokens", estimated_tokens(F.octet_length("body")).cast("long")).orderBy("path")


def stream_lines(lines: list[str], *steps: Callable[[str], str | None]) -> list[str]:
    """Lines through a chain of functions; None drops a line."""
    out = []
    for line in lines:
        for step in steps:
            line = step(line)
            if line is None:
                break
        else:
            out.append(line)
    return out


def resolve_name(files: DataFrame, name: str, most: int = 5) -> list[str]:
    """Paths with that file name (case matters, else it doesn't), shortest first: one if it clearly leads, else up to ``most``."""
    exact = files.where(name_of(F.col("path")) == name)
    found = exact if exact.limit(1).count() else files.where(fold_ascii(name_of(F.col("path"))) == fold_text(name))
    paths = [r["path"] for r in found.select("path").orderBy(F.length("path"), "path").limit(most).collect()]
    return paths[:1] if len(paths) > 1 and len(paths[1]) - len(paths[0]) >= 10 else paths


@dataclass(frozen=True)
class Trigger:
    """A mention being typed: ``input[start:end]``, in characters."""

    start: int
    end: int
    query: str
    quoted: bool = False
    line_range: tuple[int, int] | None = None


def detect_trigger(text: str, cursor: int) -> Trigger | None:
    """The mention that the cursor is in: an ``@`` at the start or after a blank, bracket or quote, not escaped, with no blank since."""
    cursor = min(cursor, len(text))
    for i in range(cursor - 1, -1, -1):
        c = text[i]
        if c == "@":
            if i and not (text[i - 1].isspace() or text[i - 1] in "([{<\"'"):
                return None
            return Trigger(i, cursor, *_suffix(text[i + 1 : cursor]))
        if c.isspace() or c in ")]}>\"'":
            return None
    return None


def _suffix(raw: str) -> tuple[str, bool, tuple[int, int] | None]:
    if raw.startswith('"'):
        body, close, _ = raw[1:].partition('"')
        return (body, True, None) if close else (raw, False, None)
    path, _, rest = raw.partition("#")
    if not rest.startswith("L"):
        return raw, False, None
    m = re.fullmatch(r"L(\d+)(?:-(\d*))?", rest)
    return path, False, (int(m[1]), int(m[2] or m[1])) if m else None


MENTION = r"(?:^|[\s(\[{<\"'])@([^\s)\]}>\"']+)"


def mentions(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with one row for each mention in a text, as ``mention``."""
    return rows.withColumn("mention", F.explode(F.regexp_extract_all(F.col(text), F.lit(MENTION), F.lit(1))))


class Provider(Protocol):
    """A source of mentions beyond files."""

    kind: str
    is_local: bool

    def suggest(self, query: str) -> list[str]: ...

    def resolve(self, name: str) -> str | None: ...


class Providers:
    """Providers by kind, and what each turn already resolved; turn 0 remembers nothing."""

    def __init__(self) -> None:
        self.by_kind: dict[str, Provider] = {}
        self.memo: dict[tuple, str | None] = {}
        self.turn = 0

    def add(self, provider: Provider) -> None:
        self.by_kind[provider.kind] = provider

    def resolve(self, turn: int, kind: str, name: str) -> str | None:
        if turn != self.turn:
            self.memo, self.turn = {}, turn
        if turn == 0:
            return self.by_kind[kind].resolve(name)
        if (kind, name) not in self.memo:
            self.memo[kind, name] = self.by_kind[kind].resolve(name)
        return self.memo[kind, name]


IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}


def mention_search(files: DataFrame, text: str, most: int = MENTIONS) -> DataFrame:
    """``path, kind, total``: the best files and folders for what is typed after the sign; what ends in ``/`` asks for folders alone."""
    from skein.operators.find import mixed

    return mixed(files, text, 0, most).select("path", "kind", "total")


def resolve_mention(files: DataFrame, trigger: Trigger, total_tokens: int, level: str = "none") -> dict:
    """What a mention stands for: a directory's listing (100 names), an image's type, or a file's lines, filtered and cut, with a token audit."""
    path = trigger.query.rstrip("/")
    rows = files.where(F.col("path") == path).select("content").head(1)
    if not rows:
        listing = [r["path"] for r in files.where(F.col("path").startswith(path + "/")).select("path").orderBy("path").limit(100).collect()]
        return {"kind": "directory" if listing else "missing", "path": path, "entries": listing}
    ext = path.rpartition(".")[2].lower()
    if ext in IMAGES:
        return {"kind": "image", "path": path, "mime": IMAGES[ext]}
    content = rows[0]["content"]
    if "\0" in content[:8192]:
        return {"kind": "binary", "path": path}
    if trigger.line_range:
        content = section(content, *trigger.line_range)
    body, kept, dropped = truncate_lines(filter_text(content, level_for(path, level)), split_budget(total_tokens)["body"] * 4)
    return {"kind": "file", "path": path, "text": body, "kept_lines": kept, "dropped_lines": dropped, "tokens": -(-len(body.encode()) // 4)}
