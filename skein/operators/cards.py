"""Symbol queries, detailed calls, expanded bodies and flow cards."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import truncate_lines
from skein.operators import graph
from skein.plans.glob import glob_regex


def symbol_query(symbols: DataFrame, query: str) -> DataFrame:
    """``asked, name, path, line, ...``: an exact name, ``prefix*``, or several with commas, in the order asked, each once."""
    asked = list(dict.fromkeys(q.strip() for q in query.split(",") if q.strip()))
    found = None
    for i, q in enumerate(asked):
        match = F.col("name").startswith(q[:-1]) if q.endswith("*") else F.col("name") == q
        part = symbols.where(match).select(F.lit(i).alias("ord"), F.lit(q).alias("asked"), "*")
        found = part if found is None else found.unionByName(part)
    return symbols.limit(0) if found is None else found.orderBy("ord", F.desc("weight"), "path", "line").drop("ord")


def substring_symbols(symbols: DataFrame, piece: str) -> DataFrame:
    return symbols.where(F.col("name").contains(piece)).select("name").distinct().orderBy("name")


def glob_files(files: DataFrame, pattern: str, most: int = 1000) -> DataFrame:
    """Paths that match a file glob: stars stay within a directory, ``**`` crosses."""
    return files.where(F.col("path").rlike(glob_regex(pattern, False))).select("path").orderBy("path").limit(most)


def presence(texts: DataFrame, patterns: list[str], text: str = "content") -> DataFrame:
    """``texts`` with the patterns that occur, by first occurrence."""
    at = F.array_compact(F.array(*(F.when(F.instr(text, p) > 0, F.struct(F.instr(text, p).alias("at"), F.lit(p).alias("p"))) for p in patterns)))
    return texts.withColumn("present", F.transform(F.array_sort(at), lambda x: x["p"]))


def split_arguments(text: str) -> list[str]:
    """Arguments at every comma; long ones are cut."""
    parts = [a.strip() for a in text.split(",") if a.strip()]
    return [a if len(a) <= 40 else a[:37] + "..." for a in parts]


_DEFINES = re.compile(r"\b(?:fn|def|function|class|struct|func|enum|trait|interface|type)\s+$")
DETAIL = "array<struct<line:int,callee:string,args:array<string>,target:string,returned:boolean>>"


def callees_detailed(files: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """``path, line, callee, args, target, returned``: known names that are called, by text, in the bodies of ``name``, each once per line.

    The words of the bodies are joined with the known names; what is joined is as large as the bodies, not the corpus.
    """
    own = symbols.where(F.col("name") == name).select("path", F.col("line").alias("start"), "end_line")
    body = files.select("path", "content").join(own, "path")

    @F.pandas_udf(DETAIL)
    def calls(contents: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        def one(content, start, end):
            out = []
            for i, line in enumerate(content.split("\n")[start - 1 : end], start):
                seen = set()
                for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\(([^()]*)", line):
                    if m[1] in seen or _DEFINES.search(line[: m.start()]):
                        continue
                    seen.add(m[1])
                    before = line[: m.start()]
                    t = re.match(r"\s*(?:let\s+(?:mut\s+)?|const\s+|var\s+|val\s+)?([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)", before)
                    out.append({"line": i, "callee": m[1], "args": split_arguments(m[2]), "target": t[1] if t else None, "returned": before.strip().startswith("return")})
            return out

        return pd.Series([one(*r) for r in zip(contents, starts, ends, strict=True)])

    found = body.select("path", F.explode(calls("content", "start", "end_line")).alias("c")).select("path", "c.*")
    known = symbols.where(F.col("name") != name).select(F.col("name").alias("callee")).distinct()
    return found.join(known, "callee", "left_semi")


def bodies(files: DataFrame, symbols: DataFrame, name: str, total_tokens: int) -> DataFrame:
    """``path, line, kind, body``: the source of each definition, cut to an equal share of the budget, 256 tokens at least."""
    own = symbols.where(F.col("name") == name)
    share = max(total_tokens // max(own.count(), 1), 256) * 4

    @F.pandas_udf("string")
    def body(contents: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([truncate_lines("\n".join(c.split("\n")[a - 1 : b]), share)[0] for c, a, b in zip(contents, starts, ends, strict=True)])

    joined = own.join(files.select("path", "content"), "path")
    return joined.select("path", "line", "kind", body("content", "line", "end_line").alias("body")).orderBy("path", "line")


def expanded(files: DataFrame, symbols: DataFrame, calls: DataFrame, name: str, total_tokens: int) -> DataFrame:
    """Bodies with the names that they call and where the last definition of each is."""
    own = symbols.where(F.col("name") == name).select("path", F.col("line").alias("start"), "end_line")
    inside = calls.join(own, "path").where(F.col("line").between(F.col("start"), F.col("end_line"))).select("path", "start", "callee").distinct()
    place = symbols.groupBy(F.col("name").alias("callee")).agg(F.max(F.struct("path", "line")).alias("at"))
    listed = inside.join(place, "callee", "left").groupBy("path", "start").agg(F.array_sort(F.collect_set(F.struct("callee", F.col("at.path").alias("path"), F.col("at.line").alias("line")))).alias("calls"))
    return bodies(files, symbols, name, total_tokens).join(listed.withColumnRenamed("start", "line"), ["path", "line"], "left")


def flow(files: DataFrame, symbols: DataFrame, calls: DataFrame, callers: DataFrame, name: str, total_tokens: int, most: int = 10) -> DataFrame:
    """A card for each definition: its body, its first callees and its callers."""
    own = bodies(files, symbols, name, total_tokens)
    called = graph.callees(calls, symbols, name).select("callee").distinct().orderBy("callee").limit(most).agg(F.collect_list("callee").alias("callees"))
    top = callers.where(F.col("depth") == 1).orderBy("path", "line").limit(most).agg(F.collect_list(F.struct("path", "line", "caller")).alias("callers"))
    return own.crossJoin(F.broadcast(called)).crossJoin(F.broadcast(top))  # one row each, of `most` entries


def ranked_symbols(symbols: DataFrame, name: str, frecency: DataFrame | None = None) -> DataFrame:
    """Symbols that begin with ``name``, best first: exact definitions, then by weight and frecency of their files."""
    from skein.operators.find import symbol_score

    found = symbols.where(F.col("name").startswith(name))
    found = found.withColumn("f", F.lit(0)) if frecency is None else found.join(frecency.select("path", F.col("access_frecency").alias("f")), "path", "left").fillna(0, ["f"])
    score = symbol_score(F.lit(True), F.col("weight"), F.col("name") == name, F.lit(False), F.col("f"))
    return found.withColumn("score", score).drop("f").orderBy(F.desc("score"), "name", "path", "line")
