"""Bigram postings: which files can hold a literal, a regular expression or a fuzzy needle.

Postings cover whole contents. A key is a pair of lower-case printable ASCII characters, next to each other (gap 0) or with one
character between (gap 1). Candidates are a superset of the files with matches; files are scanned afterwards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

try:
    from re import _parser as sre
except ImportError:  # older Pythons
    import sre_parse as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import LOWER, UPPER, fold_text

_TO_LOWER = str.maketrans(UPPER, LOWER)

_KEYS = pa.array([chr(32 + i) + chr(32 + j) for i in range(95) for j in range(95)])


def _codes(content: str, gap: int) -> np.ndarray:
    """Numbers of the content's keys, each once: a mark per possible key, no sorting."""
    c = np.frombuffer(content.translate(_TO_LOWER).encode("utf-32-le"), "<u4").astype(np.int64) - 32
    a, b = c[: -1 - gap], c[1 + gap :]
    fine = (a >= 0) & (a < 95) & (b >= 0) & (b < 95)
    seen = np.zeros(95 * 95, bool)
    seen[a[fine] * 95 + b[fine]] = True
    return np.nonzero(seen)[0]


def build(files: DataFrame, skip: bool = True) -> DataFrame:
    """``key, gap, path``, each once; cluster by key when writing, so a probe reads few row groups. One pass, no shuffle."""
    gaps = (0, 1) if skip else (0,)

    def run(batches):
        for batch in batches:
            found = [[_codes(c or "", g) for c in batch.column(1).to_pylist()] for g in gaps]
            for g, codes in zip(gaps, found, strict=True):
                files_at = np.repeat(np.arange(len(codes)), [len(x) for x in codes])
                keys = np.concatenate(codes) if codes else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([_KEYS.take(pa.array(keys)), pa.array(np.full(len(keys), g, np.int8)), batch.column(0).take(pa.array(files_at))], names=["key", "gap", "path"])

    return files.select("path", "content").mapInArrow(run, "key string, gap tinyint, path string")


def prune(postings: DataFrame, n_files: int, least: float = 0.031, least_skip: float = 0.12, most: float = 0.9) -> DataFrame:
    """Keys that tell files apart: neither too rare to pay for themselves nor nearly everywhere."""
    share = postings.groupBy("key", "gap").agg((F.count(F.lit(1)) / F.lit(float(n_files))).alias("share"))
    kept = share.where((F.col("share") >= F.when(F.col("gap") == 0, least).otherwise(least_skip)) & (F.col("share") < most))
    return postings.join(kept.select("key", "gap"), ["key", "gap"], "left_semi")


def keys_of(literal: str) -> list[tuple[str, int]]:
    """The keys of a literal, pairs that the index doesn't hold left out."""
    s = fold_text(literal)
    found = [(s[i] + s[i + 1 + g], g) for g in (0, 1) for i in range(len(s) - 1 - g)]
    return list(dict.fromkeys((k, g) for k, g in found if all(" " <= c <= "~" for c in k)))


@dataclass(frozen=True)
class Plan:
    """``any`` (no information), ``key``, ``and``, ``or``, or ``count`` (at least ``least`` of the parts)."""

    kind: str
    key: tuple[str, int] | None = None
    parts: tuple = field(default=())
    least: int = 0


ANY = Plan("any")


def both(parts) -> Plan:
    flat = tuple(dict.fromkeys(q for p in parts for q in (p.parts if p.kind == "and" else (p,)) if q.kind != "any"))
    return ANY if not flat else flat[0] if len(flat) == 1 else Plan("and", parts=flat)


def either(parts) -> Plan:
    parts = tuple(dict.fromkeys(parts))
    return ANY if not parts or ANY in parts else parts[0] if len(parts) == 1 else Plan("or", parts=parts)


def literal_plan(literal: str) -> Plan:
    return both(Plan("key", key=k) for k in keys_of(literal))


def many_plan(literals: list[str]) -> Plan:
    """Any of the literals; one without keys means that every file is a candidate."""
    return either(literal_plan(x) for x in literals)


def fuzzy_plan(needle: str, typos: int) -> Plan:
    """Up to seven spread-out pairs, of which each typo can spoil two."""
    keys = [k for k in keys_of(needle) if k[1] == 0]
    keys = [keys[i * (len(keys) - 1) // 6] for i in range(7)] if len(keys) > 7 else keys
    least = len(keys) - 2 * typos
    return Plan("count", parts=tuple(Plan("key", key=k) for k in keys), least=least) if least > 0 else ANY


def fuzzy_lines_plan(needle: str, typos: int, gaps: int) -> Plan:
    """What any line that a fuzzy search accepts must hold: a missing character spoils two pairs, a gap one. Nothing is lost, short needles ask nothing."""
    keys = [k for k in keys_of(needle) if k[1] == 0]
    least = len(keys) - 2 * typos - gaps
    return Plan("count", parts=tuple(Plan("key", key=k) for k in keys), least=least) if least > 0 else ANY


def _chars(node) -> set[str] | None:
    """The characters that one position can be, if there are up to 16 plain ones."""
    op, arg = node
    if op is sre.LITERAL:
        return {fold_text(chr(arg))}
    if op is sre.IN:
        out: set[str] = set()
        for o, a in arg:
            if o is sre.LITERAL:
                out.add(fold_text(chr(a)))
            elif o is sre.RANGE and a[1] - a[0] < 16:
                out |= {fold_text(chr(x)) for x in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 16 else None
    return None


def regex_plan(pattern: str) -> Plan:
    """What any match must hold: pairs of neighbouring positions, joined over alternatives and repetitions."""
    if "&&" in pattern or re.search(r"\[[^\]]*\[", pattern):  # classes within classes, which the two engines read differently
        return ANY
    try:
        return _sequence(list(sre.parse(pattern)))
    except Exception:  # a pattern that doesn't compile tells nothing about its matches
        return ANY


def _sequence(nodes: list) -> Plan:
    parts: list[Plan] = []
    window: list[set[str] | None] = []

    def pairs() -> None:
        for i, a in enumerate(window):
            for gap in (0, 1):
                b = window[i + 1 + gap] if i + 1 + gap < len(window) else None
                if a and b and len(a) * len(b) <= 64 and all(" " <= c <= "~" for c in a | b):
                    parts.append(either(Plan("key", key=(x + y, gap)) for x in sorted(a) for y in sorted(b)))
        window.clear()

    def walk(nodes) -> None:
        for op, arg in nodes:
            if op in (sre.LITERAL, sre.IN, sre.ANY, sre.NOT_LITERAL):
                window.append(_chars((op, arg)))
            elif op is sre.AT:
                continue
            elif op is sre.SUBPATTERN:
                walk(list(arg[-1]))
            elif op is sre.BRANCH:
                pairs()
                parts.append(either(_sequence(list(x)) for x in arg[1]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, inner = arg
                if low:
                    for _ in range(min(low, 3)):
                        walk(list(inner))
                    if high != low or low > 3:
                        pairs()
                        if len(inner) == 1 and inner[0][0] in (sre.LITERAL, sre.IN):
                            window.append(_chars(inner[0]))  # the last repetition stands before what follows
                else:
                    pairs()
            else:
                pairs()

    walk(nodes)
    pairs()
    return both(parts)


def _keys(plan: Plan) -> list[tuple[str, int]]:
    return list(dict.fromkeys([plan.key] if plan.kind == "key" else [k for p in plan.parts for k in _keys(p)]))


def _holds(plan: Plan, has) -> Column:
    if plan.kind == "key":
        return has(plan.key)
    parts = [_holds(p, has) for p in plan.parts]
    if plan.kind == "count":
        return sum((p.cast("int") for p in parts), F.lit(0)) >= plan.least
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if plan.kind == "and" else (out | p)
    return out


def candidates(postings: DataFrame, plan: Plan) -> DataFrame | None:
    """``path`` of files that can match, one shuffle of the few keys' postings; None means all files."""
    found = _counted(postings, plan)
    return None if found is None else found.select("path")


def _counted(postings: DataFrame, plan: Plan) -> DataFrame | None:
    """Candidates with ``held``, the number of the plan's keys that each holds."""
    if plan.kind == "any":
        return None
    keys = _keys(plan)
    wanted = F.concat("key", F.col("gap").cast("string")).isin(*(k + str(g) for k, g in keys))
    flags = [F.bool_or((F.col("key") == k) & (F.col("gap") == g)).alias(f"_{i}") for i, (k, g) in enumerate(keys)]
    per_file = postings.where(F.col("key").isin(*sorted({k for k, _ in keys})) & wanted).groupBy("path").agg(F.count(F.lit(1)).alias("held"), *flags)
    at = {k: f"_{i}" for i, k in enumerate(keys)}
    return per_file.where(_holds(plan, lambda k: F.col(at[k]))).select("path", "held")


def probe(files: DataFrame, postings: DataFrame, plan: Plan) -> DataFrame:
    """``files`` that can match, with the contents of candidates alone: a filter on them runs after the index was used."""
    found = _counted(postings, plan)
    if found is None:
        return files
    # The content depends on a column of the other side, so the optimizer can't search it below the join.
    joined = files.join(found.select("path", F.col("held").alias("_held")), "path")
    return joined.withColumn("content", F.when(F.col("_held") > 0, F.col("content"))).select(*files.columns)


def save(postings: DataFrame, where: str) -> None:
    """Write postings clustered by key, so a probe reads the row groups of its keys, and how many files each key has."""
    postings.repartitionByRange("key", "gap", "path").sortWithinPartitions("key", "gap", "path").write.option("parquet.block.size", 1 << 20).parquet(f"{where}/postings")
    saved = postings.sparkSession.read.parquet(f"{where}/postings")
    saved.groupBy("key", "gap").agg(F.count(F.lit(1)).alias("files")).coalesce(1).write.parquet(f"{where}/counts")


def load_counts(spark: SparkSession, where: str) -> dict[tuple[str, int], int]:
    """Files for each key: two numbers for every pair of printable characters at most, whatever the corpus."""
    return {(r["key"], r["gap"]): r["files"] for r in spark.read.parquet(f"{where}/counts").collect()}


def thinned(plan: Plan, counts: dict[tuple[str, int], int], most: int = 4) -> Plan:
    """A plan that asks for the rarest keys only, where all of several are needed: more candidates, fewer postings to read."""
    if plan.kind != "and" or any(p.kind != "key" for p in plan.parts) or len(plan.parts) <= most:
        return plan
    return Plan("and", parts=tuple(sorted(plan.parts, key=lambda p: counts.get(p.key, 0))[:most]))


def with_overlay(base: DataFrame, tombstones: DataFrame, delta: DataFrame) -> DataFrame:
    """Postings or files of a base without what was changed or deleted since, and what it is now. ``tombstones`` and ``delta`` hold paths."""
    touched = tombstones.select("path").union(delta.select("path")).distinct()
    return base.join(touched, "path", "left_anti").unionByName(delta)
