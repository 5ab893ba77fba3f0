"""Content search: literal, regular-expression, multi-pattern and fuzzy line matching, with context, caps and pages.

Whole contents are filtered before they are cut into lines, so files without a match never reach the line explosion. Every result
has a total order that ends with path and line.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import fuzzy
from skein.functions.paths import name_of
from skein.functions.text import fold_ascii, fold_text, smart_case
from skein.plans.dsl import GREP, Dialect, Query, parse
from skein.plans.predicates import conjunction
from skein.sources.corpus import lines as lines_of

MAX_FILE_SIZE = 10 * 1024 * 1024
MATCHES_PER_FILE = 200
PAGE = 50
DISPLAY_BYTES = 512

# Words before a definition, definition words, import lines.
_MODIFIERS = r"(?:pub\([^)]*\)\s*|(?:pub|export|default|async|abstract|unsafe|static|protected|private|public)\s+)*"
DEFINITION = rf"^\s*{_MODIFIERS}(?:struct|fn|enum|trait|impl|class|interface|function|def|func|type|module|object)(?:[^A-Za-z0-9_]|$)"
IMPORT = r"""^\s*(?:import[ \t]|from ['"]|use[ \t]|require ?\(|#\s*include[ \t])"""
REGEX_CHARS = frozenset(".+*?^$[(|\\")


def is_definition_line(line: Column) -> Column:
    return line.rlike(DEFINITION)


def is_import_line(line: Column) -> Column:
    return line.rlike(IMPORT)


def looks_like_regex(pattern: str) -> bool:
    return any(c in REGEX_CHARS for c in pattern)


def spans_lines(pattern: str) -> bool:
    """Whether the pattern holds an unescaped ``\\n``."""
    return re.search(r"(?<!\\)(?:\\\\)*\\n", pattern) is not None or "\n" in pattern


def searchable(files: DataFrame, most: int = MAX_FILE_SIZE) -> DataFrame:
    """Files with content that is neither empty, too large, nor binary (a NUL anywhere)."""
    size = F.octet_length("content")
    return files.where((size > 0) & (size <= most) & ~F.col("content").contains("\0"))


def literal(column: Column, needle: str, ignore_case: bool) -> Column:
    """Whether the column holds the needle. Java's case-insensitive match folds A-Z alone and beats folding the column first."""
    return column.rlike("(?i)" + re.escape(needle)) if ignore_case else column.contains(needle)


def regex(column: Column, pattern: str, ignore_case: bool) -> Column:
    return column.rlike(("(?im)" if ignore_case else "(?m)") + engine_regex(pattern))


def engine_regex(pattern: str) -> str:
    """The pattern with named groups as the JVM's engine writes them."""
    return re.sub(r"(?<!\\)\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"(?<!\\)\(\?P<", "(?<", pattern))


def valid_regex(spark: SparkSession, pattern: str) -> str | None:
    """The error of a pattern that doesn't compile, by the engine that runs it; the search then takes it literally."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(engine_regex(pattern))
    except IllegalArgumentException as e:  # what a PatternSyntaxException is
        return str(e)
    return None


def word_pattern(needle: str, is_regex: bool) -> str:
    return rf"\b(?:{needle if is_regex else re.escape(needle)})\b"


def literal_lines(files: DataFrame, needle: str, ignore_case: bool | None = None) -> DataFrame:
    """``path, line, text`` of lines that hold ``needle``; smart case unless told otherwise."""
    ignore = smart_case(needle) if ignore_case is None else ignore_case
    hits = searchable(files).where(literal(F.col("content"), needle, ignore))
    return lines_of(hits).where(literal(F.col("text"), needle, ignore))


def regex_lines(files: DataFrame, pattern: str, ignore_case: bool | None = None) -> DataFrame:
    """As :func:`literal_lines` for a regular expression; one that doesn't compile is a literal."""
    if valid_regex(files.sparkSession, pattern):
        return literal_lines(files, pattern, ignore_case)
    ignore = smart_case(pattern) if ignore_case is None else ignore_case
    hits = searchable(files).where(regex(F.col("content"), pattern, ignore))
    return lines_of(hits).where(regex(F.col("text"), pattern, ignore))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _starts(texts: pd.Series, needles: pd.Series) -> pd.Series:
    def starts(text, needle):
        out, at = [], text.find(needle) if text is not None and needle else -1
        while at >= 0:
            out.append(at)
            at = text.find(needle, at + 1)
        return out

    return pd.Series([starts(t, n) for t, n in zip(texts, needles, strict=True)])


def literal_offsets(line: Column, needle: str, ignore_case: bool) -> Column:
    """0-based character starts of all occurrences, overlapping ones too."""
    return _starts(fold_ascii(line), F.lit(fold_text(needle))) if ignore_case else _starts(line, F.lit(needle))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _byte_ranges(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    def ranges(text, pattern):
        if text is None:
            return None
        return [{"start": len(text[: m.start()].encode()), "end": len(text[: m.end()].encode())} for m in re.finditer(pattern, text) if m.end() > m.start()]

    return pd.Series([ranges(t, p) for t, p in zip(texts, patterns, strict=True)])


def byte_ranges(line: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as byte ranges."""
    return _byte_ranges(line, F.lit(pattern))


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def multiline_spans(files: DataFrame, pattern: str, ignore_case: bool) -> DataFrame:
    """``path, first_line, last_line, text``: matches of a pattern over several lines, overlapping line spans merged."""

    @F.pandas_udf("array<struct<first:int,last:int,text:string>>")
    def spans(contents: pd.Series) -> pd.Series:
        flags = re.M | (re.I if ignore_case else 0)

        def one(text):
            found = [(text.count("\n", 0, m.start()) + 1, text.count("\n", 0, max(m.start(), m.end() - 1)) + 1) for m in re.finditer(pattern, text, flags)]
            merged: list[list[int]] = []
            for a, b in found:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            rows = text.split("\n")
            return [{"first": a, "last": b, "text": "\n".join(rows[a - 1 : b])} for a, b in merged]

        return contents.map(one)

    found = searchable(files).select("path", F.explode(spans("content")).alias("s"))
    return found.select("path", F.col("s.first").alias("first_line"), F.col("s.last").alias("last_line"), F.col("s.text").alias("text"))


def multiline_lines(files: DataFrame, pattern: str, ignore_case: bool | None = None) -> DataFrame:
    """``path, line, text`` of matches that can run over lines, each at its first line with all the lines that it touches."""
    ignore = smart_case(pattern) if ignore_case is None else ignore_case
    hits = files.where(regex(F.col("content"), pattern, ignore))
    return multiline_spans(hits, pattern, ignore).select("path", F.col("first_line").alias("line"), "text")


def _runs_over_lines(spark: SparkSession, pattern: str) -> bool:
    """Whether the pattern asks for line breaks and both engines, which find files and spans, can read it."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return spans_lines(pattern) and valid_regex(spark, pattern) is None


def multi_lines(files: DataFrame, needles: list[str], ignore_case: bool | None = None) -> DataFrame:
    """``path, line, text, matched``: lines that hold any needle, with the needles that they hold, in the order given."""
    ignore = smart_case(*needles) if ignore_case is None else ignore_case
    any_of = lambda c: reduce(or_, (literal(c, n, ignore) for n in needles))
    hits = lines_of(searchable(files).where(any_of(F.col("content")))).where(any_of(F.col("text")))
    marks = F.array_compact(F.array(*(F.when(literal(F.col("text"), n, ignore), F.lit(n)) for n in needles)))
    return hits.withColumn("matched", marks)


def first_match(line: Column, needles: list[str], ignore_case: bool) -> Column:
    """The leftmost needle on the line, the first listed if several start together."""
    low = fold_ascii(line) if ignore_case else line
    at = [F.locate(fold_text(n) if ignore_case else n, low) for n in needles]
    found = F.array(*(F.when(p > 0, F.struct(p.alias("p"), F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, (p, n) in enumerate(zip(at, needles, strict=True))))
    return F.array_min(F.array_compact(found))["n"]


def fuzzy_lines(files: DataFrame, needle: str) -> DataFrame:
    """``path, line, text, score``: lines where the needle matches with few typos, best score first."""
    n = fold_text(needle)
    typos = min(len(n) // 3, 2)
    letters = sorted(set(n.replace(" ", "")))
    present = reduce(lambda a, b: a + b, (fold_ascii(F.col("text")).contains(c).cast("int") for c in letters), F.lit(0))
    candidates = lines_of(searchable(files)).where(present >= len(letters) - typos)
    m = fuzzy.line_match(F.col("text"), needle)
    scored = candidates.withColumn("m", m).where(F.col("m").isNotNull()).select("path", "line", "text", F.col("m.score").alias("score"))
    return scored.where(F.col("score") * 2 >= 16 * len(n))


def with_context(hits: DataFrame, files: DataFrame, before: int, after: int) -> DataFrame:
    """``hits`` with the lines before and after them. Only files with hits are read for context."""
    whole = lines_of(files.join(hits.select("path").distinct(), "path", "left_semi"))
    near = hits.select("path", F.col("line").alias("hit"), F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("line"))
    text = near.join(whole, ["path", "line"]).groupBy("path", "hit").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("around"))
    side = lambda keep: F.transform(F.filter("around", keep), lambda x: x["text"])
    text = text.select("path", F.col("hit").alias("line"), side(lambda x: x["line"] < F.col("hit")).alias("context_before"), side(lambda x: x["line"] > F.col("hit")).alias("context_after"))
    return hits.join(text, ["path", "line"])


def cap_per_file(hits: DataFrame, most: int = MATCHES_PER_FILE) -> DataFrame:
    return hits.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy("line"))).where(F.col("_n") <= most).drop("_n")


def grouped(hits: DataFrame, most: int = MATCHES_PER_FILE) -> DataFrame:
    """``path, n, lines``: each file once, with its number of hits and the first of them in line order. Hits are capped before they are gathered."""
    counts = hits.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    listed = cap_per_file(hits, most).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    return counts.join(listed, "path")


def output(hits: DataFrame, mode: str = "content") -> DataFrame:
    """``hits`` as they are asked for: ``content`` (lines), ``files`` (each path once), ``count`` (a number for each path) or ``usage`` (with the kind of line)."""
    if mode == "files":
        return hits.select("path").distinct()
    if mode == "count":
        return hits.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    if mode == "usage":
        text = F.col("text")
        return hits.withColumn("kind", F.when(is_definition_line(text), "definition").when(is_import_line(text), "import").otherwise("usage"))
    if mode != "content":
        raise ValueError(f"unknown mode {mode}")
    return hits


def scan_counters(files: DataFrame, needle: str, ignore_case: bool = True, most: int = MAX_FILE_SIZE) -> DataFrame:
    """One row: ``files, empty, too_large, binary, searched, matched``, what a search over ``files`` passes over and finds. One pass."""
    size, c = F.octet_length("content"), F.col("content")
    kind = F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > most, "too_large").when(c.contains("\0"), "binary").otherwise("searched")
    n = lambda x: F.count_if(x)
    f = files.select(kind.alias("kind"), literal(c, needle, ignore_case).alias("hit"))
    counts = [n(F.col("kind") == k).alias(k) for k in ("empty", "too_large", "binary", "searched")]
    return f.agg(F.count(F.lit(1)).alias("files"), *counts, n((F.col("kind") == "searched") & F.col("hit")).alias("matched"))


def soft_page(hits: DataFrame, page: int = PAGE, file_offset: int = 0, ranks: DataFrame | None = None) -> DataFrame:
    """Whole files until a page is full: the file that fills it is finished. Counts per file are summed, not lines.

    Files come in path order, or with ``ranks(path, frecency, modified)`` the most used first, then the last changed.
    """
    counts = hits.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("path")]
    if ranks is not None:
        counts = counts.join(ranks.select("path", "frecency", "modified"), "path", "left")
        order = [F.desc(F.coalesce("frecency", F.lit(0))), F.desc_nulls_last("modified"), F.col("path")]
    # Only as many files as hits on a page can be on it.
    head = counts.orderBy(*order).limit(file_offset + page)
    ranked = head.withColumn("rank", F.row_number().over(W.orderBy(*order))).where(F.col("rank") > file_offset)
    before = F.coalesce(F.sum("n").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chosen = ranked.withColumn("before", before).where(F.col("before") < page)
    return hits.join(F.broadcast(chosen.select("path")), "path", "left_semi")  # a page's files at most


def trim_lines(hits: DataFrame) -> DataFrame:
    """Leading white space off, with how much went, so ranges can be shifted."""
    bare = F.regexp_replace("text", r"^\s+", "")
    return hits.withColumn("shift", F.length("text") - F.length(bare)).withColumn("text", bare)


def display(line: Column, most: int = DISPLAY_BYTES) -> Column:
    """Lines of up to ``most`` bytes as they are, longer ones cut between characters."""
    chars = F.transform(F.split(F.substring(line, 1, most), ""), lambda c: F.octet_length(c))
    fits = F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit(0).alias("b")), lambda a, x: F.when(a["b"] + x <= most, F.struct((a["n"] + 1).alias("n"), (a["b"] + x).alias("b"))).otherwise(F.struct(a["n"].alias("n"), F.lit(most + 1).alias("b"))))
    return F.when(F.octet_length(line) <= most, line).otherwise(F.substring(line, F.lit(1), fits["n"]))


def output_budget(hits: DataFrame) -> DataFrame:
    """Definitions, usages, imports, within a number of characters that depends on how many files have hits; the first line always stays.

    Imports go where a definition was found. ``hits`` is a page (its size is bounded), so the running sum may be in one task.
    """
    kind = F.when(is_definition_line(F.col("text")), 0).when(is_import_line(F.col("text")), 2).otherwise(1)
    ranked = hits.withColumn("kind", kind)
    total = ranked.agg(F.countDistinct("path").alias("files"), F.min("kind").alias("best"))
    ranked = ranked.crossJoin(F.broadcast(total)).where((F.col("kind") < 2) | (F.col("best") > 0))  # one row
    most = F.when(F.col("files") <= 3, 5000).when(F.col("files") <= 8, 3500).otherwise(2500)
    order = W.orderBy("kind", "path", "line").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = ranked.withColumn("upto", F.sum(F.length("text")).over(order)).withColumn("first", F.row_number().over(W.orderBy("kind", "path", "line")) == 1)
    return ranked.where(F.col("first") | (F.col("upto") <= most)).drop("files", "best", "upto", "first")


def search(files: DataFrame, query: str, dialect: Dialect = GREP, mode: str = "auto", page: int | None = None, status: Column | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """A query in the search language over ``files(path, content, ...)``. A regular expression with a line break in it matches over lines.

    Retries as a user would expect: if a file constraint selects no file it is dropped, and if constraints leave nothing to
    find, the raw query is searched as text.
    """
    q = parse(query, dialect)
    scope = files.where(conjunction(q.constraints, F.col("path"), status))
    if any(c.kind == "file" for c in q.constraints) and scope.limit(1).count() == 0:
        q = Query(q.raw, tuple(c for c in q.constraints if c.kind != "file"), q.parts, q.location)
        scope = files.where(conjunction(q.constraints, F.col("path"), status))
    text = q.search_text()
    if not text:
        return literal_lines(files, query.strip())
    find = {"literal": literal_lines, "regex": regex_lines, "fuzzy": fuzzy_lines}.get(mode) or (regex_lines if looks_like_regex(text) else literal_lines)
    if find is regex_lines and _runs_over_lines(files.sparkSession, text):
        find = multiline_lines
    hits = cap_per_file(find(scope, text))
    if q.constraints and mode != "fuzzy" and hits.limit(1).count() == 0:
        hits = cap_per_file(literal_lines(files, query.strip()))
    return soft_page(hits, page, ranks=ranks) if page else hits


def ladder(files: DataFrame, query: str) -> tuple[str, DataFrame]:
    """Exact; with ten hits or fewer and several words, without the first word; then fuzzy, best three; then file names."""
    exact = search(files, query)
    found = exact.limit(11).count()
    if found > 10 or (found and " " not in query.strip()):
        return "exact", exact
    words = query.split()
    if len(words) > 1:
        rest = search(files, " ".join(words[1:]))
        if rest.limit(1).count() and not found:
            return "without first word", rest
    if found:
        return "exact", exact
    near = fuzzy_lines(files, query.strip()).orderBy(F.desc("score"), "path", "line").limit(3)
    if near.count():
        return "fuzzy", near
    named = files.where(fold_ascii(name_of(F.col("path"))).contains(fold_text(words[-1]) if words else "")).select("path")
    return "file names", named.orderBy("path").limit(3)
